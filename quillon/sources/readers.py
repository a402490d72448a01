"""Readers: tables, JSON documents, manifests, files and binary documents."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "source string, title string, page_number int, page_url string, pdf_url string, local_path string, downloaded_at timestamp, size_bytes bigint, collection string, decree string, category string, catalog_match string"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of source that done does not hold yet."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def json_documents(spark: SparkSession, path: str, wrapper: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON list, or of an object that holds the list under wrapper; both shapes may be mixed."""
    both = T.StructType([T.StructField(wrapper, T.ArrayType(schema)), *schema.fields])
    raw = spark.read.schema(both).json(path, multiLine=True)
    listed = raw.where(F.col(wrapper).isNotNull()).select(F.explode(wrapper).alias("d")).select("d.*")
    return listed.unionByName(raw.where(F.col(wrapper).isNull()).drop(wrapper))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are left out."""
    return spark.read.schema(MANIFEST).json(path, mode="DROPMALFORMED").where("coalesce(pdf_url, local_path, title) is not null")


def file_pairs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(base, card, certificate): files whose names share what stands before _pagN or _FRes_."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    base = F.regexp_replace(F.regexp_replace("name", r"\.\w+$", ""), r"_(?:pag\d+|FRes_).*$", "")
    return names.groupBy(base.alias("base")).agg(F.max(F.when(~F.col("name").contains("TipoCertificado"), F.col("path"))).alias("card"), F.max(F.when(F.col("name").contains("TipoCertificado"), F.col("path"))).alias("certificate"))


def binary_text(spark: SparkSession, path: str, parser: Callable[[bytes], str], glob: str = "*", magic: bytes = b"") -> DataFrame:
    """(path, text) by a parser that is given each file's bytes; files without the magic, or that the parser refuses, have a null text."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                return parser(bytes(raw)) if bytes(raw).startswith(magic) else None
            except Exception:  # noqa: BLE001  one broken file must not end the scan
                return None

        return s.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", read("content").alias("text"))


def catalog(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the current database and its temporary views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


# The document types and sources that a new store is seeded with.
DOCUMENT_TYPES = ["ley", "codigo", "decreto", "reglamento", "acuerdo", "convenio", "tratado", "constitucion", "resolucion"]


def seed(spark: SparkSession, values: list[str], column: str = "codigo") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")
