"""Interval lists: (keys, first, last) with ``last`` exclusive.

Built from samples by runs, and combined by sweeping over their ends; one window
by key each, no comparison of all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_runs(df: DataFrame, condition: Column, keys: Sequence[str] = ("det",)) -> DataFrame:
    """Maximal runs of samples on which a condition holds."""
    own = W.partitionBy(*keys).orderBy("i")
    marked = df.select(*keys, "i", "t", condition.alias("__on"))
    runs = marked.withColumn("__run", F.col("i") - F.row_number().over(W.partitionBy(*keys, "__on").orderBy("i"))).where("__on")
    del own
    return runs.groupBy(*keys, "__run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"), F.min("t").alias("start"), F.max("t").alias("stop")).drop("__run")


def regular(spans: DataFrame, length: int, keys: Sequence[str] = ("det",)) -> DataFrame:
    """Each of spans(keys, first, last) cut into pieces of ``length`` samples, the last one shorter."""
    at = F.explode(F.sequence(F.col("first"), F.col("last") - 1, F.lit(length).cast("long")))
    return spans.where("last > first").select(*keys, "last", at.alias("a")).select(*keys, F.col("a").alias("first"), F.least(F.col("a") + length, F.col("last")).alias("last"))


def simplify(a: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    """Touching and overlapping intervals as one."""
    own = W.partitionBy(*keys).orderBy("first", "last")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    new = F.when(F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1)), 1).otherwise(0)
    marked = a.where("last > first").withColumn("__new", new)
    return marked.withColumn("__g", F.sum("__new").over(own)).groupBy(*keys, "__g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__g")


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    return simplify(a.select(*keys, "first", "last").unionByName(b.select(*keys, "first", "last")), keys)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    """Where both lists have an interval: a sweep over all ends counts the open ones."""
    ends = None
    for k, x in enumerate((simplify(a, keys), simplify(b, keys))):
        part = x.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("d")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("d")))))
        ends = part if k == 0 else ends.unionByName(part)
    steps = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    own = W.partitionBy(*keys).orderBy("at")
    swept = steps.withColumns({"open": F.sum("d").over(own), "next": F.lead("at").over(own)})
    return simplify(swept.where("open = 2").select(*keys, F.col("at").alias("first"), F.col("next").alias("last")), keys)


def invert(a: DataFrame, spans: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    """What spans(keys, first, last), one per key, leave uncovered; a key without intervals is all gap."""
    s = spans.select(*keys, F.col("first").alias("__lo"), F.col("last").alias("__hi"))
    edges = simplify(a, keys).join(s, list(keys), "right")
    own = W.partitionBy(*keys).orderBy("first")
    gaps = edges.select(*keys, "__lo", "__hi", "first", "last", F.lead("first").over(own).alias("__next"), F.row_number().over(own).alias("__r"))
    lead = gaps.where("__r = 1").select(*keys, F.col("__lo").alias("first"), F.coalesce("first", "__hi").alias("last"))
    rest = gaps.where("last is not null").select(*keys, F.col("last").alias("first"), F.coalesce("__next", "__hi").alias("last"))
    return lead.unionByName(rest).where("last > first")


def spans_of(df: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"))


def azimuth_ranges(df: DataFrame, keys: Sequence[str] = ("det",), az: str = "az", mask: int = 7) -> DataFrame:
    """Least and largest azimuth (degrees), steps of over half a turn taken as crossing north."""
    from ..functions.flags import good

    own = W.partitionBy(*keys).orderBy("i")
    step = F.col(az) - F.lag(az).over(own)
    turn = F.when(step > 180, -1).when(step < -180, 1).otherwise(0)
    unwound = df.withColumn("__turn", turn).withColumn("__az", F.col(az) + 360 * F.sum("__turn").over(own))
    return unwound.where(good(mask=mask)).groupBy(*keys).agg(F.min("__az").alias("az_min"), F.max("__az").alias("az_max"))


def gap_fill(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("det",)) -> DataFrame:
    """A schedule and, in its gaps, those entries of another that fit there whole."""
    touched = intersect(first, second, keys)
    cut = second.select(*keys, "first", "last").join(touched.select(*keys, F.col("first").alias("__f"), F.col("last").alias("__l")), list(keys), "left")
    hit = cut.where((F.col("__f") < F.col("last")) & (F.col("__l") > F.col("first"))).select(*keys, "first", "last").distinct()
    return first.select(*keys, "first", "last").unionByName(second.select(*keys, "first", "last").join(hit, [*keys, "first", "last"], "left_anti"))
