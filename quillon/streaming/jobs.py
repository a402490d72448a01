"""Resumable micro-batch jobs on file sources."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.dedup import JACCARD, TOKEN_GAP, prepared
from quillon.operators.ml import hash_embed


def pending_job(source: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Do work on every file not seen before and append the results; what a run has done the next one skips."""

    def write(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again replaces itself

    source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """A stream of the files in a folder; of a path that is one file, of that file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))
    return reader.parquet(path)


def vectorize(spark: SparkSession, path: str, out: str, checkpoint: str, schema: T.StructType) -> None:
    """Embed texts as they arrive."""
    pending_job(stream(spark, path, schema), out, checkpoint, lambda df: hash_embed(df.where("text is not null")))


#: Representatives: their ids, hashes, sizes and shingle hashes.
LEADERS = "ids array<bigint>, hashes array<string>, sizes array<int>, shingles array<array<bigint>>"


class Leaders:
    """A key's representatives, any number. Those that a row may be near to are found by its shingles' parities, which differ in at most as many bits as the sets do in shingles."""

    BITS = 512

    def __init__(self, sizes: list[int], shingles: list) -> None:
        self.sizes, self.shingles = [], []
        self.known = np.zeros((2, 16), np.int64), np.zeros((16, self.BITS // 64), np.uint64)
        for n, sh in zip(sizes, shingles, strict=True):
            self.add(n, np.asarray(sh, np.int64))

    def parity(self, sh: np.ndarray) -> np.ndarray:
        return np.packbits(np.bincount(sh & (self.BITS - 1), minlength=self.BITS).astype(np.uint8) & 1).view(np.uint64)

    def add(self, n: int, sh: np.ndarray) -> None:
        at = len(self.sizes)
        if at == self.known[1].shape[0]:
            self.known = np.concatenate([self.known[0], np.zeros_like(self.known[0])], axis=1), np.concatenate([self.known[1], np.zeros_like(self.known[1])])
        self.known[0][:, at], self.known[1][at] = (n, len(sh)), self.parity(sh)
        self.sizes.append(int(n))
        self.shingles.append(sh)

    def first(self, n: int, sh: np.ndarray) -> int | None:
        """The first that is near, or None."""
        (sizes, counts), parities = (x[..., : len(self.sizes)] for x in self.known[0]), self.known[1][: len(self.sizes)]
        most = (counts + len(sh)) * ((1 - JACCARD) / (1 + JACCARD)) + 1e-6  # shingles in which near sets differ
        close = np.flatnonzero((np.abs(sizes - n) <= TOKEN_GAP) & (np.abs(counts - len(sh)) <= most))
        differ = np.bitwise_count(parities[close] ^ self.parity(sh)).sum(axis=1, dtype=np.int64)
        own = set(sh.tolist())
        for j in close[differ <= most[close]].tolist():
            common = len(own.intersection(self.shingles[j].tolist()))
            union = len(own) + int(counts[j]) - common
            if not union or common / union >= JACCARD:
                return j
        return None


def incremental_dedup(source: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, duplicate_of) as rows arrive: state per near key holds all its representatives, and a row is compared with each of them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, hashes, sizes, shingles = ([list(x) for x in state.get] if state.exists else [[], [], [], []])
        less = len(ids) - len(sizes)  # a state of the time when only the first forty were kept whole: the others are near to nothing
        leaders, by_hash = Leaders(sizes + [-TOKEN_GAP - 1] * less, shingles + [[]] * less), dict(zip(hashes, ids, strict=True))
        for pdf in batches:
            pdf = pdf.sort_values(id_col)
            out = []
            for i, h, n, sh in zip(pdf[id_col], pdf["clean_hash"], pdf["n_tokens"], pdf["sh"], strict=True):
                of = by_hash.get(h)
                if of is None and (near := leaders.first(n, sh)) is not None:
                    of = ids[near]
                if of is None:
                    ids.append(int(i))
                    hashes.append(h)
                    by_hash[h] = int(i)
                    leaders.add(n, sh)
                out.append(of)
            yield pd.DataFrame({id_col: pdf[id_col], "duplicate_of": pd.array(out, "Int64")})
        state.update((ids, hashes, leaders.sizes, [sh.tolist() for sh in leaders.shingles]))

    return prepared(source, id_col).groupBy("near_key").applyInPandasWithState(run, f"{id_col} bigint, duplicate_of bigint", LEADERS, "append", GroupStateTimeout.NoTimeout)


def failure_runs(events: DataFrame, order: str, failed: str, least: int) -> DataFrame:
    """(first, last, n) of runs of consecutive failures of at least `least`: where a crawler would have stopped."""
    from pyspark.sql.window import Window

    every = F.row_number().over(Window.partitionBy("group").orderBy(order))
    same = F.row_number().over(Window.partitionBy("group", failed).orderBy(order))
    return events.withColumn("run", every - same).where(F.col(failed)).groupBy("group", "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("run")
