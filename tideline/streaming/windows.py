"""Windows over event time, on bounded tables and on streams alike.

These are an extension: batch observation processing has no streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Count and total of (kind, ts, value) per kind and window; ``late``: the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("kind", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("kind", F.unix_seconds("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("kind", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("kind", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("stop"), "n", "total")


def hit_map(samples: DataFrame) -> DataFrame:
    """Good samples per pixel of a stream (flags, pixel), kept as running state (update or complete mode)."""
    return samples.where("(flags & 7) = 0 and pixel >= 0").groupBy("pixel").agg(F.count(F.lit(1)).alias("hits"))
