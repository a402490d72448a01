"""The query catalogue: a Spark plan and, where SQL can express it, DuckDB SQL under one name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.readers import table

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables by attribute: t.documents."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a plan under its function's name, or under another."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or plan.__name__
        QUERIES[key] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return plan

    return add


def vector_of(t: Tables, vec_id: int = 0) -> list[float]:
    """The query vector, one row."""
    return list(t.embeddings.where(f"vec_id = {vec_id}").first()["embedding"])


def tok_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[a-zA-Z0-9_]+'), lambda z: lower(z))"


#: The character references that SQL decodes: those that occur in the tables.
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def strip_sql(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '(?is)<script\b.*?</script>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?is)<style\b.*?</style>', ' ', 'g')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def clean_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({strip_sql(f'coalesce({x}, {chr(39) * 2})')}, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')))"


def sim_sql(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
