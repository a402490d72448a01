"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in edges (a long, b long); component is the smallest node reachable.

    Minima are taken with partial aggregation and come back by equi-joins, so a
    node with very many links is never gathered in one task. Edges with a null
    are ignored; an empty input gives an empty result.
    """
    edges = written(edges.where("a is not null and b is not null and a != b").select("a", "b"))
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("component").alias("component"))
        seen = mark
        moved = written(_small_star(_large_star(edges)))
        discard(edges)
        edges = moved
