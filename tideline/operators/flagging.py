"""Flags over time: intervals, dilation, bad values, and cuts of whole detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import good, raised


def flag_nans(df: DataFrame, bit: int = 1, replace: float = 0.0, value: str = "signal") -> DataFrame:
    """Values that are null, NaN or infinite are replaced and flagged."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.withColumns({"flags": raised("flags", bad, bit), value: F.when(bad, replace).otherwise(x)})


def in_intervals(df: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("det",), block: int = 1024) -> DataFrame:
    """Samples inside intervals(keys, first, last), ``last`` exclusive, with the interval's columns.

    An interval becomes one row per block of samples that it touches, so the join
    has an equality on the block and stays linear however long the intervals are.
    """
    cut = intervals.withColumn("__block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))))
    own = df.withColumn("__block", F.floor(F.col("i") / block))
    got = own.join(cut, [*keys, "__block"])
    return got.where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last"))).drop("__block")


def flag_intervals(df: DataFrame, intervals: DataFrame, bit: int, keys: Sequence[str] = ("det",), reset: bool = False) -> DataFrame:
    """Sets a bit inside intervals; ``reset`` clears it everywhere first."""
    base = F.col("flags").bitwiseAND(F.lit(~bit)) if reset else F.col("flags")
    inside = in_intervals(df.select(*keys, "i"), intervals.select(*keys, "first", "last"), keys).select(*keys, "i").distinct().withColumn("__in", F.lit(True))
    return df.withColumn("flags", base).join(inside, [*keys, "i"], "left").withColumn("flags", raised("flags", F.col("__in").isNotNull(), bit)).drop("__in")


def extend_flags(df: DataFrame, n: int, bit: int = 1, keys: Sequence[str] = ("det",)) -> DataFrame:
    """Grows runs of a bit by n samples to both sides."""
    near = W.partitionBy(*keys).orderBy("i").rowsBetween(-n, n)
    return df.withColumn("flags", raised("flags", F.max(F.col("flags").bitwiseAND(F.lit(bit))).over(near) != 0, bit))


def near_direction(df: DataFrame, bodies: DataFrame, radius: float, bit: int = 4, step: float = 3600.0) -> DataFrame:
    """Flags samples within ``radius`` (radians) of a body: df(t, x, y, z), bodies(t, bx, by, bz).

    A body's place is known at its epochs and interpolated between the two around a
    sample; samples outside the epochs are left alone.  Both sides meet on a time
    bucket, the epochs' spans being cut at the buckets that they cover.
    """
    after = W.partitionBy("name").orderBy("t")
    spans = bodies.select("name", F.col("t").alias("t0"), *[F.col(c).alias(f"{c}0") for c in ("bx", "by", "bz")], F.lead("t").over(after).alias("t1"), *[F.lead(c).over(after).alias(f"{c}1") for c in ("bx", "by", "bz")])
    spans = spans.where("t1 is not null").withColumn("__b", F.explode(F.sequence(F.floor(F.col("t0") / step), F.floor(F.col("t1") / step))))
    last = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    got = df.withColumn("__b", F.floor(F.col("t") / step)).join(spans, "__b").where(last)
    f = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    at = [F.col(f"{c}0") + f * (F.col(f"{c}1") - F.col(f"{c}0")) for c in ("bx", "by", "bz")]
    size = F.sqrt(sum((a * a for a in at), F.lit(0.0)))
    dot = sum((F.col(c) * a for c, a in zip("xyz", at, strict=True)), F.lit(0.0)) / size
    hit = got.where(dot > F.cos(F.lit(radius))).select("det", "i").distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, ["det", "i"], "left").withColumn("flags", raised("flags", F.col("__hit").isNotNull(), bit)).drop("__hit")


def all_flagged(df: DataFrame, mask: int = 7) -> DataFrame:
    """Detectors without a good sample."""
    return df.groupBy("det").agg(F.sum(F.when(good(mask=mask), 1).otherwise(0)).alias("n")).where("n = 0").select("det")


def _median_and_spread(stats: DataFrame, column: str) -> tuple[float, float] | None:
    got = stats.agg(F.median(column), F.stddev_pop(column)).first()
    return None if got[0] is None else (float(got[0]), float(got[1]))


def clip_pass(stats: DataFrame, column: str, limit: float) -> DataFrame:
    """One pass of sigma clipping over detectors: rows further than limit * std from the median go, and those without a value."""
    found = _median_and_spread(stats, column)
    return stats.where(F.lit(False)) if found is None else stats.where(F.abs(F.col(column) - found[0]) <= limit * found[1])


def clip(stats: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Passes over each column in turn until nothing more goes.

    ``stats`` is written once, one row per detector; each pass reads two numbers of it
    and adds a filter, so the plan grows by one condition a pass.
    """
    from .destriper import kept

    stats = kept(stats, "clip")
    for c in columns:
        n = None
        while n != (n := stats.count()):
            stats = clip_pass(stats, c, limit)
    return stats
