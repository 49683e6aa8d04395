"""A volume of observations on disk, and its index.

A volume is a folder of Parquet tables partitioned by session and observation,
with one row per observation in ``index``.  Selecting is SQL over the index; the
chosen names then prune the partitions that are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select_observations(index: DataFrame, tail: str = "") -> DataFrame:
    """select * from the index, followed by the text of ``tail`` (where, order by, limit)."""
    return index.sparkSession.sql(f"select * from {{index}} {tail}", index=index)


def quantize(df: DataFrame, quanta: Mapping[str, float]) -> DataFrame:
    """Columns rounded to multiples of a step, so that they compress."""
    return df.withColumns({c: F.round(F.col(c) / q) * q for c, q in quanta.items()})


def save(stream: DataFrame, path: str, quanta: Mapping[str, float] | None = None, index_fields: Mapping[str, str] | None = None, verify: bool = False) -> None:
    """Writes a stream (session, obs, det, i, ...) and its index; ``index_fields`` are SQL aggregates by name.

    ``verify`` reads everything again and raises unless rows are the same both ways.
    """
    out = quantize(stream, quanta or {})
    # One writer per observation and no more open files per task than it has observations.
    out.repartition("session", "obs").sortWithinPartitions("session", "obs", "det", "i").write.mode("overwrite").partitionBy("session", "obs").parquet(f"{path}/stream")
    extra = [F.expr(e).alias(n) for n, e in (index_fields or {}).items()]
    own = out.groupBy("session", F.col("obs").alias("name")).agg(F.countDistinct("i").alias("samples"), F.countDistinct("det").alias("valid_dets"), F.min("t").alias("start"), F.max("t").alias("stop"), *extra)
    own.write.mode("overwrite").parquet(f"{path}/index")
    if verify:
        back = stream.sparkSession.read.schema(out.schema).parquet(f"{path}/stream").select(*out.columns)
        if not (out.exceptAll(back).isEmpty() and back.exceptAll(out).isEmpty()):
            raise ValueError(f"{path}: what was read differs from what was written")


def load(spark: SparkSession, path: str, tail: str = "", columns: Sequence[str] | None = None, det_select: Mapping[str, str] | None = None, dets: DataFrame | None = None) -> DataFrame:
    """The stream of the observations that ``tail`` selects, of detectors whose properties match all patterns."""
    chosen = select_observations(spark.read.parquet(f"{path}/index"), tail).select(F.col("name").alias("obs"), "session")
    out = spark.read.parquet(f"{path}/stream").join(chosen, ["session", "obs"], "left_semi")
    if det_select and dets is not None:
        for column, pattern in det_select.items():
            dets = dets.where(F.col(column).cast("string").rlike(pattern))
        out = out.join(dets.select("det"), "det", "left_semi")
    return out.select(*columns) if columns else out


def reindex(spark: SparkSession, path: str) -> None:
    """Makes the index anew from the stream."""
    s = spark.read.parquet(f"{path}/stream")
    own = s.groupBy("session", F.col("obs").alias("name")).agg(F.countDistinct("i").alias("samples"), F.countDistinct("det").alias("valid_dets"), F.min("t").alias("start"), F.max("t").alias("stop"))
    own.write.mode("overwrite").parquet(f"{path}/index")
