"""A vector index that is kept: cells as partitions, short codes to scan, whole vectors for what the codes leave.

Building fits cell centres and, for each pair of dimensions, sixteen code values
on a bounded hash sample of the rows (SAMPLE); every row is then indexed. There
are as many cells as the square root of the rows asks for. A cell is a folder;
one with more than FILE rows is several files, whatever it holds, so equal
vectors are no obstacle. A row's code is that of what its cell's centre leaves
of it, half a byte a pair of dimensions.

A search reads the codes of the nearest cells' folders only, keeps `shortlist`
rows a query by the codes' cosine, and compares whole vectors for those, from
the folders that hold them. How many rows and cells a search takes for the
wanted recall is measured against exact search as the index is built, on up to
TRIALS of its rows, and kept with it: vectors with clusters need few cells,
others many.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.vectors import cosine
from quillon.operators.search import QUERY_BLOCK, knn
from quillon.operators.store import discard, written
from quillon.sources import versions

SAMPLE, MOST_CELLS, FILE, TRIALS, LEVELS = 20_000, 4096, 500_000, 100, 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, near, rounds: int = 15) -> np.ndarray:
    """k-means on a few rows; a centre without rows stays."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = near(x, centres)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


class Codes:
    """Centres of cells and code values; small, and sent to tasks whole."""

    def __init__(self, centres: np.ndarray, books: np.ndarray) -> None:
        self.centres, self.books = centres, books

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int) -> "Codes":
        rng, x = np.random.default_rng(seed), _unit(sample)
        centres = _unit(_means(x, min(cells, len(x)), rng, lambda a, c: (a @ _unit(c).T).argmax(axis=1)))
        pairs = cls._pairs(x - centres[cls(centres, None).cell(x)[:, 0]])
        books = np.stack([np.resize(_means(pairs[:, m], min(LEVELS, len(x)), rng, _closest), (LEVELS, 2)) for m in range(pairs.shape[1])])
        return cls(centres, books)

    @staticmethod
    def _pairs(x: np.ndarray) -> np.ndarray:
        """Dimensions two by two, in an even number of pairs."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)

    def cell(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> list[bytes]:
        pairs = self._pairs(unit - self.centres[cell])
        own = np.stack([_closest(pairs[:, m], self.books[m]) for m in range(pairs.shape[1])], axis=1).astype(np.uint8)
        return [r.tobytes() for r in own[:, ::2] << 4 | own[:, 1::2]]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """For each query, pair of dimensions and code value: its share of the cosine."""
        return np.einsum("qmd,mld->qml", self._pairs(unit), self.books)

    @staticmethod
    def scores(tables: np.ndarray, codes: pd.Series) -> np.ndarray:
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        out = np.zeros((len(tables), len(codes)))
        for m in range(raw.shape[1]):
            out += tables[:, 2 * m, raw[:, m] >> 4] + tables[:, 2 * m + 1, raw[:, m] & 15]
        return out


def build(root: str, df: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", cells: int | None = None, k: int = 5, recall: float = 0.95, seed: int = 42) -> dict:
    """Index df (rows without a vector, or with a zero one, are left out) under root. Returns what was measured: rows, cells, probes, shortlist, recall."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("v is not null and exists(v, x -> x != 0)")
    n = rows.count()
    if not n:
        raise ValueError("nothing to index")
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 3 * SAMPLE / n) * (1 << 30))).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
    codes = Codes.fit(np.array([r["v"] for r in chosen.select("v").toLocalIterator()], np.float64), cells or min(MOST_CELLS, max(1, round(n**0.5))), seed)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(_matrix(pdf["v"]))
                cell = codes.cell(unit)[:, 0]
                yield pdf.assign(cell=cell.astype(np.int32), code=codes.encode(unit, cell))

    placed = written(rows.mapInPandas(coded, "id long, v array<float>, cell int, code binary"))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    files = {c: -(-s // FILE) for c, s in sizes.items()}
    split = F.broadcast(spark.createDataFrame(list(files.items()), "cell int, files int"))  # a row a cell
    dealt = placed.join(split, "cell").repartition(sum(files.values()) // 4 + 1, "cell", F.pmod(F.xxhash64("id"), F.col("files"))).sortWithinPartitions("cell", "id")
    model = spark.createDataFrame([(n, codes.centres.tolist(), codes.books.tolist())], "rows long, centres array<array<double>>, books array<array<array<double>>>")
    each = {"codes": dealt.select("cell", "id", "code"), "vectors": dealt.select("cell", "id", "v"), "model": model}
    versions.publish(spark, root, each, {"codes": ["cell"], "vectors": ["cell"]}, only=True)
    discard(placed)
    asked = written(rows.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(TRIALS).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    exact = written(knn(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), asked, k).select("query_id", "id"))
    wanted = max(exact.count(), 1)

    def measured(probes: int, keep: int) -> float:
        return search(spark, root, asked, k, probes, keep).join(exact, ["query_id", "id"]).count() / wanted

    probes, keep = len(codes.centres), 4 * k
    while (got := measured(probes, keep)) < recall and keep < n:
        keep *= 2
    for share in (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4):
        if (few := max(1, round(share * probes))) < probes and (less := measured(few, keep)) >= recall:
            probes, got = few, less
            break
    versions.publish(spark, root, {"trial": spark.createDataFrame([(probes, keep, got)], "probes int, shortlist int, recall double")})
    discard(asked)
    discard(exact)
    return {"rows": n, "cells": len(codes.centres), "probes": probes, "shortlist": keep, "recall": got}


def shortlisted(spark: SparkSession, root: str, queries: DataFrame, probes: int | None = None, shortlist: int | None = None, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, q, cell, id): the rows that each query compares whole. Queries are a stated, small set, taken in blocks."""
    model = versions.load(spark, root, "model").first()
    codes = Codes(np.array(model["centres"]), np.array(model["books"]))
    trial = versions.load(spark, root, "trial").first() if probes is None or shortlist is None else None
    probes, keep = probes or trial["probes"], shortlist or trial["shortlist"]
    asked = [(r[id_col], r[embedding]) for r in queries.select(id_col, embedding).where(F.col(embedding).isNotNull()).orderBy(id_col).toLocalIterator()]
    out = None
    for a in range(0, max(1, len(asked)), QUERY_BLOCK):
        block = asked[a : a + QUERY_BLOCK]
        ids = np.array([r[0] for r in block], np.int64)
        unit = _unit(np.array([r[1] for r in block], np.float64).reshape(len(block), -1)) if block else np.empty((0, codes.centres.shape[1]))
        near, tables = codes.cell(unit, probes), codes.tables(unit)
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

        def scan(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, unit: np.ndarray = unit, tables: np.ndarray = tables, by_cell: dict = by_cell) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, part in pdf.groupby("cell"):
                    q = by_cell[int(cell)]
                    own = part["id"].to_numpy()
                    scores = np.where(ids[q][:, None] == own[None, :], -np.inf, unit[q] @ codes.centres[int(cell)][:, None] + codes.scores(tables[q], part["code"]))
                    best = np.lexsort((np.broadcast_to(own, scores.shape), -scores))[:, :keep]
                    flat = np.take_along_axis(scores, best, axis=1).ravel()
                    yield pd.DataFrame({"query_id": np.repeat(ids[q], best.shape[1]), "cell": np.int32(cell), "id": own[best].ravel(), "near": flat})[flat > -np.inf]

        part = versions.load(spark, root, "codes").where(F.col("cell").isin(list(by_cell))).select("cell", "id", "code").mapInPandas(scan, "query_id long, cell int, id long, near double")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).select("query_id", "cell", "id")


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, sim, rank): approximate knn from the index, similarities exact."""
    few = shortlisted(spark, root, queries, probes, shortlist, id_col, embedding)
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(embedding).alias("q"))
    whole = versions.load(spark, root, "vectors").join(F.broadcast(few), ["cell", "id"])  # at most shortlist rows a query
    sims = whole.join(asked, "query_id").select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("sim"))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return sims.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
