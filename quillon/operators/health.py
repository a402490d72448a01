"""The state of a vector table, groups of vectors by fixed rounds, and counters that come with a write."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine
from quillon.operators.ml import seeded_order
from quillon.operators.relational import numbered


def covariance(df: DataFrame, embedding: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of the vectors: sums of vectors and of their products a partition, added up by place."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[embedding].tolist(), np.float64)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    parts = df.select(embedding).where(F.col(embedding).isNotNull()).mapInPandas(sums, "i int, row array<double>")
    added = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # the square of the dimensions
    size = max((r["i"] for r in added), default=0) + 1
    total = np.zeros((size, size))
    for r in added:
        total[r["i"], r["j"]] = r["x"]
    n = int(round(total[-1, -1]))
    mean = total[-1, :-1] / max(n, 1)
    return n, mean, total[:-1, :-1] / max(n, 1) - np.outer(mean, mean)


def spectrum(df: DataFrame, embedding: str = "embedding") -> np.ndarray:
    """Shares of the variance along its main directions, largest first."""
    values = np.maximum(np.linalg.eigvalsh(covariance(df, embedding)[2])[::-1], 0)
    return values / max(values.sum(), 1e-300)


def dimensions_for(shares: np.ndarray, part: float) -> int:
    """How many main directions hold that part of the variance."""
    return int(np.searchsorted(np.cumsum(shares), part - 1e-12) + 1)


def norms(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: vectors, zero ones, least, mean and greatest length, and its deviation."""
    length = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.where(F.col(embedding).isNotNull()).select(length.alias("l")).agg(F.count("l").alias("vectors"), F.count_if(F.col("l") == 0).alias("zeros"), F.round(F.min("l"), 6).alias("least"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.max("l"), 6).alias("greatest"), F.round(F.stddev_pop("l"), 6).alias("deviation"))


def random_pairs(df: DataFrame, seed: str, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b, sim): all rows with a vector in pairs, neighbours in an order by hash; an odd last one stays alone."""
    ranked = numbered(df.where(F.col(embedding).isNotNull()).select(id_col, embedding), [seeded_order(seed, id_col), F.col(id_col)], "n")
    side = lambda odd, name, v: ranked.where(F.col("n") % 2 == odd).select(F.expr("(n + 1) div 2").alias("pair"), F.col(id_col).alias(name), F.col(embedding).alias(v))
    return side(1, "a", "va").join(side(0, "b", "vb"), "pair").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("sim"))


def spherical_kmeans(df: DataFrame, seeds: list[list[float]], rounds: int = 10, id_col: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster), centres): each round every row goes to the centre of greatest cosine (ties: the first), each centre to the mean direction of its rows.

    Centres are few and go to every task; a partition sends one sum a centre. A
    centre without rows stays where it is. Rows without a vector, or with a zero
    one, are left out.
    """
    rows = df.where(F.col(embedding).isNotNull() & F.exists(embedding, lambda x: x != 0)).select(id_col, embedding)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = unit(np.array(seeds, np.float64))

    def nearest(pdf: pd.DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(np.array(pdf[embedding].tolist(), np.float64))
        return x, np.round(x @ centres.T, 9).argmax(axis=1)

    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(centres)
            for pdf in batches:
                if len(pdf):
                    x, own = nearest(pdf, centres)
                    np.add.at(total, own, x)
            yield pd.DataFrame({"cluster": np.arange(len(total)), "row": list(total)})

        parts = rows.mapInPandas(sums, "cluster int, row array<double>").select("cluster", F.posexplode("row").alias("j", "x"))
        moved = np.zeros_like(centres)
        for r in parts.groupBy("cluster", "j").agg(F.sum("x").alias("x")).collect():  # centres times dimensions
            moved[r["cluster"], r["j"]] = r["x"]
        held = np.linalg.norm(moved, axis=1) > 1e-12
        centres = np.where(held[:, None], unit(moved), centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({id_col: pdf[id_col], "cluster": nearest(pdf, centres)[1]})

    return rows.mapInPandas(assign, f"{id_col} long, cluster int"), centres


def write_counted(df: DataFrame, path: str, **counters: Column) -> dict[str, object]:
    """Write df as Parquet and return the counters (aggregates by name), taken from the rows as they are written: no second scan."""
    seen = Observation("written")
    df.observe(seen, *(c.alias(n) for n, c in counters.items())).write.parquet(path)
    return seen.get


def counted_stream(df: DataFrame, path: str, state: str, **counters: Column) -> list[dict]:
    """Append a stream's new rows to path, resuming where its state ends; the counters of every batch, taken as it is written."""
    from pyspark.sql.streaming import StreamingQueryListener

    seen: list[tuple[str, dict]] = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None: ...

        def onQueryProgress(self, event) -> None:
            if (row := event.progress.observedMetrics.get("counted")) is not None:
                seen.append((str(event.progress.id), row.asDict()))

        def onQueryTerminated(self, event) -> None: ...

    spark, listener = df.sparkSession, Listener()
    observed = df.observe("counted", *(c.alias(n) for n, c in counters.items()))
    spark.streams.addListener(listener)
    try:
        query = observed.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return [row for own, row in seen if own == str(query.id)]
