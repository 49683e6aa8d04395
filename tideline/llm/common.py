"""Helpers that several text operators share.

Rows are documents: a repeated row is a further document.  A null text counts
as an empty one.  Columns that an operator does not know are never read, so
their names cannot clash with its own.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text contracts name: tab to carriage return, and space.
WHITE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key counts as heavy when it holds more than 1 / HEAVY of all rows, so there are at most HEAVY heavy keys.
HEAVY = 4096


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def strip_white(c: Column) -> Column:
    """Without the white space of the contracts at both ends."""
    return F.btrim(c, F.lit(WHITE))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a folder under the warehouse serves, on a single
    machine only: a cluster's executors would each write into a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tideline"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders that each application has made and not yet released.
_made: dict[str, list[str]] = {}


def folders(spark: SparkSession) -> set[str]:
    """The folders that this application has made and not released."""
    return set(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: set[str], keep: DataFrame | None = None) -> None:
    """Deletes those of ``paths`` that this application made, but for those that ``keep`` reads.

    For the end of a stage whose result is written: a frame that is still to be
    computed from them would fail.
    """
    used = [] if keep is None else keep.inputFiles()
    for path in folders(spark) & paths:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _made[spark.sparkContext.applicationId].remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan needs any more; it does so as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers, unless the session has a lower bound.

    The row bound alone (10,000 by default) says nothing of long texts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("bB")) <= size:
        spark.conf.set(name, str(size))


def split_heavy(keys: DataFrame, count: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Splits a table with one row per key into heavy keys and the rest.

    At most HEAVY keys can hold more than total / HEAVY rows each, which is the
    bound that lets the first part be broadcast whatever the input's size.
    """
    floor = max(total // HEAVY, 1)
    return keys.where(F.col(count) > floor), keys.where(F.col(count) <= floor)


def join_skewed(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with keys (one row per key, ``count``: its rows).

    Heavy keys are broadcast (their number is bounded), so their rows stay where
    they are; the rest is dealt by key, none of which is large.
    """
    heavy, light = split_heavy(keys, count, total)
    others = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(others.join(light.hint("merge"), on))
