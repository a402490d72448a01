"""Running sums over range-sorted rows, exact over partition borders, and dense names of keys."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import HOT, discard, written


#: A key with no more rows than this is never dealt over tasks.
FEW = 1000


def _within(key: str | None, values: list[str]):
    """A mapInArrow step: rows with their partition and the sums of the values before them, of their key in that partition."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, totals = TaskContext.get().partitionId(), None, [0] * len(values)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(n, np.int64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            more = [pa.array(np.full(n, part, np.int32))]
            for i, value in enumerate(values):
                before = np.concatenate([[0], np.cumsum(pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
                base = before[starts]
                base[0] -= totals[i] if keys[0] == last else 0
                more.append(pa.array(before[:-1] - np.repeat(base, np.diff(np.append(starts, n)))))
                totals[i] = int(before[-1] - base[-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__part", *(f"__before{i}" for i in range(len(values)))])

    return step


def running(df: DataFrame, key: str | None, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df, written, with a column for each of sums (name: value, a long): the sum over the earlier rows of the row's key (a long without nulls), or of all rows.

    Rows are sorted by key and order in ranges, so a key with very many rows is
    dealt over many tasks: each sums its own part, and what lies before a part
    is added from the sums of the parts, which are a row a part, or two for keys
    that lie in several. Rows equal in key and order stay in one task; their
    order among themselves is any. df is evaluated twice, since its ranges are
    sampled first.
    """
    spark, by, n = df.sparkSession, [*([key] if key else []), *order], len(sums)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    befores = ", ".join(f"__before{i} long" for i in range(n))
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_within(key, list(sums.values())), f"{kinds}, __part int, {befores}"))
    split: list = [None]
    if key:
        ends = rows.groupBy("__part").agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("__part").collect()
        split = [y["a"] for x, y in zip(ends, ends[1:], strict=False) if x["b"] == y["a"]]
        if not split:
            return rows.select(*df.columns, *(F.col(f"__before{i}").alias(name) for i, name in enumerate(sums)))
    chosen = rows.where(F.col(key).isin(*set(split))) if key else rows
    groups = [F.col(key).alias("__key")] if key else [F.lit(None).cast("long").alias("__key")]
    parts = chosen.groupBy(*groups, "__part").agg(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(sums.values()))).orderBy("__key", "__part").collect()
    offsets, at, total = [], None, [0] * n
    for r in parts:
        total = [0] * n if r["__key"] != at else total
        offsets.append((r["__key"], r["__part"], *total))
        at, total = r["__key"], [t + (r[f"s{i}"] or 0) for i, t in enumerate(total)]
    table = F.broadcast(spark.createDataFrame(offsets, f"__key long, __at int, {', '.join(f'__o{i} long' for i in range(n))}"))
    same = (F.col("__part") == F.col("__at")) & (F.col(key) == F.col("__key") if key else F.lit(True))
    added = (F.col(f"__before{i}") + F.coalesce(f"__o{i}", F.lit(0)) for i in range(n))
    return rows.join(table, same, "left").select(*df.columns, *(c.alias(name) for c, name in zip(added, sums, strict=True)))


def dense_names(rows: DataFrame, keys: list[str], name: str, first: int = 0) -> tuple[DataFrame, int]:
    """(rows, written, with name in place of keys: a number for each distinct key, dense from first; the next free number).

    Distinct keys are counted with partial sums and written, numbered in their
    partitions and moved by the sizes of those before. Keys that many rows have,
    fewer than HOT, meet their rows in HOT tasks.
    """
    spark = rows.sparkSession
    counted = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__id", F.monotonically_increasing_id()))
    part, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = counted.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("size"), F.sum("__n").alias("rows"), F.max("__n").alias("most")).orderBy("__part").collect()
    limit = max(sum(r["rows"] for r in sizes) / HOT, FEW)
    offsets, at = [], first
    for r in sizes:
        offsets.append((r["__part"], at))
        at += r["size"]
    moved = F.broadcast(spark.createDataFrame(offsets, "__part long, __offset long"))
    table = counted.join(moved, part == F.col("__part")).select(*keys, (own + F.col("__offset")).alias(name), "__n")
    if any(r["most"] > limit for r in sizes):
        hot = F.broadcast(counted.where(F.col("__n") > limit).select(*keys, F.lit(True).alias("__hot")))
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT)).cast("int")
        rows = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
        table = table.withColumn("__salt", F.explode(F.when(F.col("__n") > limit, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))))
        keys = [*keys, "__salt"]
    out = written(rows.join(table.drop("__n"), keys).drop(*keys))
    discard(counted)
    return out, at
