"""Several tables that change together: all of them in the new state, or none.

A publish writes each table to a folder of its own and then a pointer that
names the folder of every table. Pointers are numbered; the one rename that
gives the new pointer its number is the commit. A load that dies at any step
before leaves the old state, with folders that no pointer names; readers open
what one pointer names, so they never see two states. Old folders stay until
vacuum, for readers that began on them.

One writer publishes at a time; of two that begin on the same state the second
fails, where the file system refuses to rename onto an existing file.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.store import hadoop

POINTERS, DATA = "_versions", "data"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = hadoop(spark, f"{root}/{POINTERS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))


def current(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """(number, folder of each table) of the newest state, or of another; (0, {}) before the first."""
    numbers = _numbers(spark, root)
    if number is None:
        number = numbers[-1] if numbers else 0
    if not number:
        return 0, {}
    lines = spark.read.text(f"{root}/{POINTERS}/{number:08d}.json", wholetext=True).first()
    return number, json.loads(lines[0])


def load(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root, number)[1][name]}")


def _point(spark: SparkSession, root: str, number: int, folders: dict[str, str]) -> None:
    """The commit: the pointer under a temporary name, then its number."""
    fs, temp = hadoop(spark, f"{root}/{POINTERS}/_{uuid.uuid4().hex}.json")
    out = fs.create(temp)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    final = hadoop(spark, f"{root}/{POINTERS}/{number:08d}.json")[1]
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise OSError(f"{root} was published by another writer")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, only: bool = False) -> int:
    """Write the tables and commit them together; tables of the state before that are not given stay, unless `only` these are to be. Tables may be made of that state. Returns the new number."""
    number, folders = current(spark, root)
    new = {name: f"{DATA}/{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        keys = (partition_by or {}).get(name, [])
        (df.write.partitionBy(*keys) if keys else df.write).parquet(f"{root}/{new[name]}")
    _point(spark, root, number + 1, new if only else folders | new)
    return number + 1


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the pointers before the last `keep` and the folders that no other names; returns how many folders went. Not while a publish runs."""
    numbers = _numbers(spark, root)
    used = {f for n in numbers[-keep:] for f in current(spark, root, n)[1].values()}
    fs, data = hadoop(spark, f"{root}/{DATA}")
    for n in numbers[:-keep]:
        fs.delete(hadoop(spark, f"{root}/{POINTERS}/{n:08d}.json")[1], False)
    gone = [s.getPath() for s in fs.listStatus(data) if f"{DATA}/{s.getPath().getName()}" not in used] if fs.exists(data) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
