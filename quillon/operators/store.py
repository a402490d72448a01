"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and the session is local (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) under the session's own access settings."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def temporary(spark: SparkSession, name: str) -> str:
    """The place of a new folder in the shared folder, deleted with the process."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


@atexit.register
def _clear() -> None:
    while _folders:
        try:
            _delete(_folders.pop())
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def written(df: DataFrame) -> DataFrame:
    """Write a frame once and read it again; the folder goes with discard or the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a written frame that is not read any more."""
    if df.folder in _folders:
        _folders.remove(df.folder)
        _delete(df.folder)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df begins with them."""
    out = []
    for name in names:
        while any(c.lower().startswith(name) for c in df.columns):
            name += "_"
        out.append(name)
    return out
