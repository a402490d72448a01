"""The corpus pipeline: documents in, token ids out.

Each stage works on all that the one before it kept and returns the columns
of documents; the last returns the encoded rows. Rows without a doc_id are
never dropped as duplicates; of several rows with one doc_id the first by a
hash of the row stays. Null and empty texts pass every stage (as one group of
near duplicates), and so do empty tables. Further columns of documents, whatever
their names, come out of every stage as they are. What a stage writes for itself
goes when the next has been written.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.llm._store import discard, scratch, written
from quillon.llm.bpe_codec import bpe_codec
from quillon.llm.leaks import flag_leaks
from quillon.llm.similar import group_leaders
from quillon.llm.substring import substring_dedup

#: Columns that stages read or change; others are put aside under names that clash with nothing.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def aside(stage: Stage) -> Stage:
    """A stage that sees further columns under other names and returns the columns of docs."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"further_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run


@aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.5 or more."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, index).where("score < 0.5")


@aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by 0.8 or more of five-word shingles (SimHash and min-hash candidates, verified); of several rows with that id, one."""
    rows = docs.where("doc_id is not null").withColumn("row_hash", F.xxhash64(*docs.columns))
    first = rows.groupBy("doc_id").agg(F.min("row_hash").alias("row_hash")).join(group_leaders(docs), "doc_id", "left_semi")
    # equal rows become one before they are shuffled
    kept = rows.dropDuplicates(["doc_id", "row_hash"]).join(first, ["doc_id", "row_hash"], "left_semi").drop("row_hash")
    return kept.unionByName(docs.where("doc_id is null"))


@aside
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start elsewhere out of the texts; every document stays."""
    cut = substring_dedup(docs, layout="original").withColumn("text", F.col("kept_text"))
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed)


@aside
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return flag_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") == 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text in place of text."""
    return bpe_codec(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Nearest examples, fingerprints and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's result written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = written(stage(spark, docs, sf_dir))
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
