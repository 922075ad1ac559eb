"""What the operators of this subpackage share: words, scratch tables, lookups."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Lookups of up to this many rows are broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a purely local session (tests) gets a default of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/weir-{os.getpid()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Scratch tables that have not been deleted, and whom they were made for.
_open: dict[str, str] = {}
_owner: list[str] = [""]
_later: list[tuple[str, Callable[[], None]]] = []


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that cut() makes meanwhile are deleted by sweep(owner)."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs no recomputation of what came before. done() deletes the table, and so
    does sweep() unless keep is set.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.weir_path = path
    if not keep:
        _open[path] = _owner[-1]
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _open.pop(path, None)


def done(*tables: DataFrame) -> None:
    """Deletes tables made by cut(). Whatever was derived from them must have been written."""
    for table in tables:
        _delete(table.sparkSession, table.weir_path)
    free(tables[0].sparkSession)


def sweep(spark: SparkSession, owner: str) -> None:
    """Deletes the tables made for owner so far. What was derived from them must have been written."""
    for path in [path for path, of in _open.items() if of == owner]:
        _delete(spark, path)
    for of, work in [x for x in _later if x[0] == owner]:
        work()
        _later.remove((of, work))
    free(spark)


def at_sweep(work: Callable[[], None]) -> None:
    """Has work done by the sweep() that deletes the tables made now; nothing for those that no one sweeps."""
    if _owner[-1]:
        _later.append((_owner[-1], work))


def row_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def words(text: Column) -> Column:
    """array<string>; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """Inner join of rows with table, which has one row for each key (null included).

    table should be a written one, as its rows are counted: few rows are broadcast;
    many are repeated SALTS times and joined by a shuffle in which spread, a column
    that varies within a key, splits a hot key over SALTS tasks.
    """
    table = table.withColumnRenamed(key, "_key")
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), rows[key].eqNullSafe(table["_key"])).drop("_key")
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(table, rows[key].eqNullSafe(table["_key"]) & (rows["_salt"] == table["_salt"])).drop(table["_salt"]).drop("_key", "_salt")


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases now, not at the driver's next collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
