"""Sinks: Parquet and JSON exports, swaps, manifests."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def export(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet; an existing folder is refused unless overwrite."""
    out = df.write.mode("overwrite" if overwrite else "errorifexists")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def export_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def summary(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, distinct labels, rows without a label."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(label).alias("labels"), F.count_if(F.col(label).isNull()).alias("unlabelled"))


def swap(df: DataFrame, path: str) -> None:
    """Replace a Parquet folder by rows that may come from it: written beside it, then renamed. If the new one cannot take its place the old one goes back."""
    spark = df.sparkSession
    new, old = f"{path}__new_{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, p, make = _files(spark, path)
    if fs.exists(p):
        fs.rename(p, make(old))
    if not fs.rename(make(new), p):
        if fs.exists(make(old)):
            fs.rename(make(old), p)
        raise OSError(f"{path} could not be replaced; the new rows are in {new}")
    fs.delete(make(old), True)


def truncate(spark: SparkSession, path: str) -> None:
    """An empty table of the same schema."""
    swap(spark.read.parquet(path).limit(0), path)


def new_manifest_rows(known: DataFrame, found: DataFrame) -> DataFrame:
    """Found rows of which neither the URL nor the path is known."""
    by_url = found.join(known.select("pdf_url").where("pdf_url is not null"), "pdf_url", "left_anti")
    return by_url.join(known.select("local_path").where("local_path is not null"), "local_path", "left_anti").select(*found.columns)


def with_search_column(df: DataFrame, text: str, out: str = "lexemes") -> DataFrame:
    """The derived full-text column, computed where rows are written."""
    from quillon.functions.text import STOPWORDS_ES, latin_fold, tokens

    return df.withColumn(out, F.array_distinct(tokens(latin_fold(F.coalesce(F.col(text), F.lit(""))), STOPWORDS_ES)))
