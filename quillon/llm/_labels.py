"""Labelled rows for fitting: a bounded sample of each class, chosen by a hash of the id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; rows with 0 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def hash_sample(rows: DataFrame, most: int, total: int, *key: str) -> DataFrame:
    """At most `most` rows, those least by a hash of the key columns.

    A share of the hash range that holds about three times as many is taken
    first, so that what meets in one place to be ordered is bounded too.
    """
    if total > 3 * most:
        rows = rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(3 * most / total * (1 << 30)))
    return rows.orderBy(F.xxhash64(*key), *key).limit(most)


def fit_rows(labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id long, label int) with at most per_class rows of each class, and how many rows of each class there are to learn from.

    Held-out rows, rows without an id or a label, and all but one row of an id
    (the highest label) are left out.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (fold(doc_id) != 0))
    usable = usable.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = [hash_sample(usable.where(F.col("label") == c), per_class, counts.get(c, 0), "doc_id") for c in (0, 1)]
    return chosen[0].union(chosen[1]), {c: counts.get(c, 0) for c in (0, 1)}
