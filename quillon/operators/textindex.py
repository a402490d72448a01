"""A full-text index that is kept: postings with places, read by the query's terms alone.

An index is segments under one root, published with sources.versions. A segment
holds its texts' postings (term, id, length of the text, count, places) in
folders by bucket of the term, sorted by term, so a search opens the folders of
its terms' buckets and skips row groups of others; and the identifiers and
lengths of its texts. A text that is added again replaces the one before: rows
of an identifier count only in the last segment that has it. compact makes one
segment of all.

A stem hook maps a token to its stem, for texts and queries alike.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators.search import bm25_scores, covers
from quillon.operators.store import discard, written
from quillon.sources import versions

BUCKETS = 64
#: Postings of a bucket that go into one file.
FILE = 4_000_000
#: Texts that are grouped at once.
TEXTS = 256
Hook = Callable[[Column], Column]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, posts) of (id, dl, toks): each text's terms with their places from 0, ascending; null terms have a place but no posting."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            lists = part.column(2)
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            coded = lists.flatten().dictionary_encode()
            term = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = (np.arange(len(row)) - start[row])[term >= 0].astype(np.int32)
            row, term = row[term >= 0], term[term >= 0]
            order = np.lexsort((term, row))  # stable, so places stay ascending
            row, term, place = row[order], term[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.empty(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(place))
            posts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(term[new])), places], names=["term", "places"])
            ends = np.searchsorted(row[new], np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), posts)], names=["id", "dl", "posts"])


def add_texts(root: str, df: DataFrame, id_col: str = "doc_id", text: str = "text", stem: Hook | None = None) -> int:
    """Index the texts of df (a row an identifier) as a new segment of the index under root; returns the state's number.

    A text's places are grouped by term where the text is, so words are not
    shuffled, only postings. A bucket is dealt over as many files as it needs,
    whatever terms it holds. df is read once.
    """
    spark = df.sparkSession
    toks = tokens(F.col(text))
    rows = df.select(F.col(id_col).alias("id"), toks.alias("toks"))  # a null text has neither terms nor a length
    rows = rows.select("id", F.size("toks").alias("dl"), F.transform("toks", stem).alias("toks") if stem else F.col("toks"))
    kind = rows.schema["id"].dataType.simpleString()
    grouped = written(rows.mapInArrow(_grouped, f"id {kind}, dl int, posts array<struct<term: string, places: array<int>>>"))
    texts = grouped.select("id", "dl")
    postings = grouped.select("id", "dl", F.explode("posts").alias("p")).select("id", F.col("p.term").alias("term"), "dl", F.size("p.places").alias("tf"), F.col("p.places").alias("places"))
    words = texts.agg(F.sum("dl")).first()[0] or 0
    files = max(1, words // (BUCKETS * FILE) + 1)
    dealt = postings.withColumn("bucket", _bucket(F.col("term"))).repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", "term", "id")
    nth = len(_segments(spark, root))
    number = versions.publish(spark, root, {f"postings{nth}": dealt, f"texts{nth}": texts}, {f"postings{nth}": ["bucket"]})
    discard(grouped)
    return number


def _segments(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix("texts")) for n in versions.current(spark, root)[1] if n.startswith("texts"))


def _live(spark: SparkSession, root: str, table: str, chosen: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of a table over all segments, chosen in each, without those of texts that a later segment has."""
    out, later = None, None
    folders = versions.current(spark, root)[1]
    for nth in reversed(_segments(spark, root)):
        read = lambda name, nth=nth: spark.read.parquet(f"{root}/{folders[f'{name}{nth}']}")
        rows = chosen(read(table))
        rows = rows if later is None else rows.join(later, "id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
        later = read("texts").select("id") if later is None else later.union(read("texts").select("id"))
    if out is None:
        raise FileNotFoundError(f"{root} holds no index")
    return out


def _stems(spark: SparkSession, query: list[str], stem: Hook | None) -> list[str]:
    words = F.array(*(F.lit(q.lower()) for q in query))
    row = spark.range(1).select(F.array_sort(F.array_distinct(F.transform(words, stem) if stem else words)).alias("w")).first()
    return row["w"]


def postings_of(spark: SparkSession, root: str, terms: list[str]) -> DataFrame:
    """(term, id, dl, tf, places) of the terms, from their buckets' folders."""
    row = spark.range(1).select(F.array_distinct(F.array(*(_bucket(F.lit(t)) for t in terms))).alias("b")).first()
    return _live(spark, root, "postings", lambda df: df.where(F.col("bucket").isin(row["b"]) & F.col("term").isin(terms)).drop("bucket"))


def bm25_search(spark: SparkSession, root: str, query: list[str], k: int, id_col: str = "doc_id", stem: Hook | None = None) -> DataFrame:
    """(id, score): the scores of search.bm25, from the index."""
    terms = _stems(spark, query, stem)
    found = postings_of(spark, root, terms)
    counts = F.array(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in terms))
    per = found.groupBy("id").agg(F.first("dl").alias("dl"), counts.alias("tf"))
    sizes = _live(spark, root, "texts").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    often = found.agg(*(F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)))
    return bm25_scores(per, sizes.crossJoin(often), terms, "id").orderBy(F.desc("score"), "id").limit(k).withColumnRenamed("id", id_col)  # one row each


def cover_search(spark: SparkSession, root: str, query: list[str], id_col: str = "doc_id", stem: Hook | None = None, weight: float = 0.1) -> DataFrame:
    """(id, score): the scores of search.cover_density, from the index."""
    terms = _stems(spark, query, stem)
    at = postings_of(spark, root, terms).select(F.col("id").alias(id_col), F.explode("places").alias("pos"), F.col("term").alias("tok"))
    return covers(at, terms, id_col, weight)


def compact(spark: SparkSession, root: str) -> int:
    """One segment in place of all, without texts that were replaced."""
    postings = _live(spark, root, "postings")
    texts = _live(spark, root, "texts")
    words = texts.agg(F.sum("dl")).first()[0] or 0
    files = max(1, words // (BUCKETS * FILE) + 1)
    dealt = postings.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", "term", "id")
    return versions.publish(spark, root, {"postings0": dealt, "texts0": texts}, {"postings0": ["bucket"]}, only=True)
