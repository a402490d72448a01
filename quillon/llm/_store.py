"""Tables written in the shared folder: they cut lineage, and are deleted when they are no longer read."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written and not deleted yet, those of the innermost open scope last.
_scopes: list[list[str]] = [[]]
#: Keys with more than one in so many rows are dealt over as many tasks.
HOT = 256


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one only where none is set and the session is local (tests)."""
    sc = spark.sparkContext
    if (path := sc.getCheckpointDir()) is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="quillon-checkpoint-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def _delete(path: str) -> None:
    if (gateway := SparkContext._gateway) is not None:
        jvm = gateway.jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        sc = SparkContext._active_spark_context
        conf = sc._jsc.hadoopConfiguration() if sc is not None and sc._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
        folder.getFileSystem(conf).delete(folder, True)


@atexit.register
def _clear() -> None:
    for folders in _scopes:
        while folders:
            try:
                _delete(folders.pop())
            except Exception:  # noqa: BLE001  the JVM may be gone at exit
                return


def written(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it again; the folder goes with discard, its scope or the process."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def temporary(spark: SparkSession, name: str) -> str:
    """The URI of a new folder's place in the shared folder, deleted with its scope or the process."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def discard(*frames: DataFrame) -> None:
    """Delete the folders of written frames."""
    for df in frames:
        path = df.folder
        for folders in _scopes:
            if path in folders:
                folders.remove(path)
                _delete(path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes what was written inside at the end, except the frames put in the list."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        stay = {df.folder for df in kept}
        for path in _scopes.pop():
            if path in stay:
                _scopes[-1].append(path)
            else:
                _delete(path)


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to the one row of table (key, count, ..) that has its key. count: how many rows have it.

    The few keys of over one row in HOT are dealt over HOT tasks, each with a
    copy of the table's row; there are fewer than HOT such keys.
    """
    total = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = [r[0] for r in table.where(F.col(count) > max(total / HOT, 1000)).select(key).collect()]
    if not hot:
        return rows.join(table.drop(count), key)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT)).cast("int")
    left = rows.withColumn("__salt", F.when(F.col(key).isin(hot), salt).otherwise(0))
    right = table.drop(count).withColumn("__salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def reduced(parts: DataFrame, step, key: str, keys: int) -> DataFrame:
    """parts added up by key with a mapInArrow step that streams and returns rows of the same kind.

    A task a key adds the rows of many tasks as they stream in; where there are
    many tasks, groups of them are added first, so no task reads them all.
    """
    groups = max(1, shuffles(parts.sparkSession) // 16)
    salted = parts.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(groups)))
    first = salted.repartition(keys * groups, key, "__salt").drop("__salt").mapInArrow(step, parts.schema)
    return first if groups == 1 else first.repartition(keys, key).mapInArrow(step, parts.schema)
