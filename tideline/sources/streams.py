"""Time streams, detector tables and maps read from the star-schema tables.

A stream has one row per detector and sample: det, i (sample number within the
detector), t (seconds), signal, flags (bit mask), pixel, wi/wq/wu (Stokes
weights), az (a scanning angle) and view (runs of one event type).  Everything
is a projection over one window by detector, so filters on other columns still
reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Flag bits of the stream.
INVALID, PROCESSING = 1, 2
N_PIX = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: users are detectors, values the signal."""
    e = read(spark, sf_dir, "events")
    angle = (F.col("event_id") % 360) * F.pi() / 180
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("det"),
        (F.row_number().over(own) - 1).cast("long").alias("i"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("signal"),
        F.when(F.col("event_type") == "error", INVALID).when(F.col("event_type") == "signup", PROCESSING).otherwise(0).alias("flags"),
        (F.col("event_id") % N_PIX).alias("pixel"),
        F.lit(1.0).alias("wi"),
        F.cos(2 * angle).alias("wq"),
        F.sin(2 * angle).alias("wu"),
        (F.col("event_id") % 360).cast("double").alias("az"),
        F.col("event_type").alias("kind"),
    )


def detectors(stream: DataFrame) -> DataFrame:
    """A property row per detector: weight, calibration (missing for every seventh), group, pixel name."""
    d = stream.select("det").distinct()
    return d.select(
        "det",
        (1.0 + F.col("det") % 3).alias("weight"),
        F.when(F.col("det") % 7 != 0, 1.0 + (F.col("det") % 5) / 10.0).alias("cal"),
        (F.col("det") % 5).alias("grp"),
        F.concat(F.lit("p"), F.floor(F.col("det") / 2).cast("string")).alias("pix"),
    )


def sky(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """A small IQU map with mask bits; the last pixels are not on it."""
    p = spark.range(N_PIX - 4).withColumnRenamed("id", "pixel")
    return p.select("pixel", (100.0 + F.col("pixel")).alias("m0"), ((F.col("pixel") % 7) / 10.0).alias("m1"), ((F.col("pixel") % 5) / 20.0).alias("m2"), (F.col("pixel") % 4).cast("int").alias("mask"))


def cosampled(stream: DataFrame, step: float = 6 * 3600.0) -> DataFrame:
    """Streams of many detectors on one clock: the sample is the time bucket, one value per detector and bucket."""
    return stream.groupBy("det", F.floor(F.col("t") / step).cast("long").alias("sample")).agg(F.avg("signal").alias("signal"), F.bit_or("flags").alias("flags"))
