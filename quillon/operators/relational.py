"""Relational operators that Spark has no single call for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.store import free_names, written


#: Rows that a task takes at most where rows are dealt by tasks_for.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for a shuffle of df, a plain table: the session's number, or more if each would have over TASK_ROWS rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // TASK_ROWS))


def distinct_on(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ties need a last column that breaks them."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def first_seen(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n keys in order, each with its best row."""
    return distinct_on(df, [key], order).orderBy(*order).limit(n)


def upsert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of new whose key is not in old are added; of several new rows with a key the first in order."""
    return old.unionByName(distinct_on(new.join(old.select(*key), key, "left_anti"), key, order))


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """A row of new replaces that of old; of several new rows with a key the last in order (give it descending)."""
    last = distinct_on(new, key, order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def upsert_combine(old: DataFrame, new: DataFrame, key: list[str], combine: dict[str, Column]) -> DataFrame:
    """One row a key over both sides; combine gives an aggregate per column (greatest: max, or: bool_or)."""
    return old.unionByName(new).groupBy(*key).agg(*(c.alias(n) for n, c in combine.items()))


def update_from(old: DataFrame, values: DataFrame, key: list[str], columns: list[str], invalidate: list[str] | None = None) -> DataFrame:
    """UPDATE .. FROM (VALUES ..): new values by key; columns in invalidate become null where something changed."""
    v = values.select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    out = old.join(v, key, "left")
    changed = F.coalesce(F.col("__hit"), F.lit(False)) & F.lit(False)
    for c in columns:
        changed = changed | (F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {c: F.when(changed, None).otherwise(F.col(c)) for c in invalidate or []}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in old.columns))


def delete_keys(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def top_categories(df: DataFrame, column: str, n: int, other: str) -> DataFrame:
    """df with column's values outside its n most frequent (ties: by name) turned to other. The n values are few, so they go to every task."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(F.col(column).alias("__top"))
    joined = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")
    return joined.withColumn(f"{column}_bucket", F.when(F.col("__top").isNotNull(), F.col(column)).otherwise(F.lit(other))).drop("__top")


def positional_join(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """The i-th row of left beside the i-th of right. Numbering is in parallel: ranges are sorted, counted and offset, not brought into one partition."""
    return numbered(left, left_order, "__n").join(numbered(right, right_order, "__n"), "__n").drop("__n")


def numbered(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """df with its row number (from 1) in a total order, in all or within each value of some columns.

    Rows are dealt out by ranges of the order, numbered in each range, and
    moved by the sizes of the ranges before, so neither the table nor a value
    that most rows share is brought into one task. The borders of ranges are
    sampled, so the dealt rows are written once and both sides read the same.
    """
    keys = within or []
    part, size, at, offset, own = free_names(df, "__part", "__size", "__at", "__offset", "__own")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = written(df.repartitionByRange(parts, *keys, *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and value in it
    offsets = sizes.select(F.col(part).alias(at), *(F.col(k).alias(f"{at}{i}") for i, k in enumerate(keys)), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    counted = ranged.withColumn(own, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)))
    same = F.col(part) == F.col(at)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{at}{i}"))
    return counted.join(offsets, same).withColumn(name, F.col(offset) + F.col(own)).select(*df.columns, name)


def build_dimension(df: DataFrame, name: Column, order: list[Column]) -> DataFrame:
    """(key, name, first): natural keys are upper-case; of several spellings the first in order stays."""
    named = df.withColumn("key", F.upper(name)).withColumn("name", name).where("key is not null and key != ''")
    return distinct_on(named, ["key"], order)
