"""Ground scans: motion in azimuth, signals fixed to the ground, and gains from a known sky."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.flags import good, raised
from .intervals import invert, spans_of
from .regress import fitted, solved, with_position
from .templates import legendre


def _smoothed(c: str, window: int, order: W, keys: Sequence[str]) -> Column:
    """The mean of ``window`` samples around each, the first and last ones standing for those beyond the ends."""
    left = window // 2
    right = window - left - 1
    near = order.rowsBetween(-left, right)
    own = W.partitionBy(*keys)
    first, last = F.min_by(c, "i").over(own), F.max_by(c, "i").over(own)
    before, after = F.greatest(left - F.col("__r"), F.lit(0)), F.greatest(F.col("__r") + right - F.col("__n") + 1, F.lit(0))
    return (F.sum(c).over(near) + before * first + after * last) / window


def _slope(c: str, order: W) -> Column:
    up, down = F.lead(c).over(order), F.lag(c).over(order)
    return F.when(down.isNull(), up - F.col(c)).when(up.isNull(), F.col(c) - down).otherwise((up - down) / 2)


def azimuth_motion(df: DataFrame, window: int, keys: Sequence[str] = ("obs",), az: str = "az", mask: int = 1) -> DataFrame:
    """Adds vel and acc, smoothed gradients by sample; azimuths of flagged samples are interpolated."""
    order, own = W.partitionBy(*keys).orderBy("i"), W.partitionBy(*keys)
    seen = F.when(good(mask=mask), F.col(az))
    place = F.when(seen.isNotNull(), F.col("i"))
    d = df.withColumns({"__r": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(own)})
    v0, v1 = F.last(seen, True).over(order), F.first(seen, True).over(order.rowsBetween(0, W.unboundedFollowing))
    i0, i1 = F.last(place, True).over(order), F.first(place, True).over(order.rowsBetween(0, W.unboundedFollowing))
    d = d.withColumns({"__v0": F.coalesce(v0, v1), "__v1": F.coalesce(v1, v0), "__i0": i0, "__i1": i1})
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.coalesce((F.col("i") - F.col("__i0")) / F.nullif(F.col("__i1") - F.col("__i0"), F.lit(0)), F.lit(0.0))
    d = d.withColumn("__a", between)
    d = d.withColumn("__s", _smoothed("__a", window, order, keys)).withColumn("vel", _slope("__s", order))
    d = d.withColumn("__w", _smoothed("vel", window, order, keys)).withColumn("acc", _slope("__w", order))
    return d.drop("__v0", "__v1", "__i0", "__i1", "__a", "__s", "__w", "__r", "__n")


def azimuth_intervals(df: DataFrame, window: int, keys: Sequence[str] = ("obs",), az: str = "az", mask: int = 1, short: float | None = 0.25, long: float | None = 1.25, cut_from: int = 4) -> DataFrame:
    """(keys, kind, first, last) of scans, throws and turnarounds: df(keys, i, t, az, flags).

    A scan is a run with little acceleration and some speed, each against a tenth of its range.
    Of ``cut_from`` scans or more, those shorter than ``short`` of the median and then those longer than
    ``long`` of the median of the rest go.  A throw ends where the velocity changes its sign between two
    scans, or half-way if it does so never or more than once.  Kinds: scanning and throw, each also by
    direction (_leftright, _rightleft), and turnaround, which is all that is not scanning.
    """
    own, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("i")
    d = azimuth_motion(df, window, keys, az, mask)
    spread = lambda c: F.max(c).over(own) - F.min(c).over(own)
    d = d.withColumns({"__va": spread("vel"), "__aa": spread("acc"), "__n": F.max("i").over(own) + 1, "__t": F.lead("t").over(order)})
    d = d.withColumn("__on", (F.abs("acc") < 0.1 * F.col("__aa")) & (F.abs("vel") > 0.1 * F.col("__va")))
    # Runs by the difference of two counts; a run begins with the sample before it and ends with its last, as the ends of an observation do.
    runs = d.withColumn("__g", F.col("i") - F.sum(F.when(F.col("__on"), 1).otherwise(0)).over(order)).where("__on")
    runs = runs.groupBy(*keys, "__g").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("__n").alias("n"))
    runs = runs.select(*keys, F.greatest(F.col("a") - 1, F.lit(0)).alias("first"), F.when(F.col("b") == F.col("n") - 1, F.col("n")).otherwise(F.col("b")).alias("last")).where("last > first")
    times = d.select(*keys, F.col("i").alias("__i"), F.col("t").alias("__at"))
    runs = runs.join(times.withColumnRenamed("__i", "first").withColumnRenamed("__at", "t0"), [*keys, "first"])
    runs = runs.withColumn("__e", F.col("last") - 1).join(times.withColumnRenamed("__i", "__e").withColumnRenamed("__at", "t1"), [*keys, "__e"]).drop("__e")
    runs = runs.withColumns({"__k": F.count(F.lit(1)).over(own), "__l": F.col("t1") - F.col("t0")})
    for limit, kept in ((short, lambda m: F.col("__l") >= short * m), (long, lambda m: F.col("__l") <= long * m)):
        if limit is not None:
            runs = runs.withColumn("__m", F.median("__l").over(own)).where((F.col("__k") < cut_from) | kept(F.col("__m")))
    by_first = W.partitionBy(*keys).orderBy("first")
    scans = runs.select(*keys, "first", "last", F.lead("first").over(by_first).alias("next"), F.row_number().over(by_first).alias("__s"))
    # The place of the only change of sign in each gap.
    sign = d.select(*keys, "i", (F.col("vel") * F.lead("vel").over(order) < 0).alias("__c"), "vel")
    inside = scans.where("next is not null").join(sign.where("__c").select(*keys, "i"), list(keys)).where("i >= last and i + 1 < next")
    turns = inside.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n"), F.min("i").alias("__at")).where("__n = 1").drop("__n")
    scans = scans.join(turns, [*keys, "__s"], "left").withColumn("end", F.when(F.col("next").isNull(), F.col("last")).otherwise(F.coalesce("__at", F.col("last") + F.floor((F.col("next") - F.col("last")) / 2))))
    scans = scans.withColumn("begin", F.coalesce(F.lag("end").over(by_first) + 1, F.col("first"))).withColumn("__mid", F.col("first") + F.floor((F.col("last") - F.col("first")) / 2))
    scans = scans.join(sign.select(*keys, F.col("i").alias("__mid"), F.when(F.col("vel") >= 0, "leftright").otherwise("rightleft").alias("way")), [*keys, "__mid"])
    row = lambda kind, a, b: F.struct(kind.alias("kind"), F.col(a).alias("first"), F.col(b).alias("last"))
    both = F.array(row(F.lit("scanning"), "first", "last"), row(F.concat(F.lit("scan_"), "way"), "first", "last"), row(F.lit("throw"), "begin", "end"), row(F.concat(F.lit("throw_"), "way"), "begin", "end"))
    found = scans.select(*keys, F.inline(both).alias("kind", "first", "last"))
    rest = invert(found.where("kind = 'scanning'").select(*keys, "first", "last"), spans_of(df, keys), keys)
    return found.unionByName(rest.select(*keys, F.lit("turnaround").alias("kind"), "first", "last"))


def scan_synchronous(df: DataFrame, ground: DataFrame, nside: int, power: float = -1.0, scale: float = 1.0, mask: int = 7) -> DataFrame:
    """Adds a signal fixed to the ground: df(az, el in degrees), ground(pixel in ring order, value).

    The map is scaled by (elevation / 90 + 0.5) ** power, and read at longitude -az.
    A direction on the edge of pixels falls to one by the last bit, so it is that of the unit vector, not of the angles.
    """
    lon, lat = F.radians(-F.col("az")), F.radians("el")
    x, y = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon)
    seen = healpix.ring_pixel(df, F.sin(lat), F.atan2(y, x), nside, "__pixel")
    got = seen.join(ground.select(F.col("pixel").alias("__pixel"), F.col("value").alias("__v")), "__pixel", "left")
    level = scale * F.coalesce("__v", F.lit(0.0)) * F.pow(F.abs(F.col("el")) / 90 + 0.5, F.lit(power))
    return got.withColumn("signal", F.col("signal") + F.when(good(mask=mask), level).otherwise(0.0)).drop("__pixel", "__v")


def calibrate(df: DataFrame, order: int, model: str = "model", keys: Sequence[str] = ("det",), mask: int = 7, bit: int = 1) -> DataFrame:
    """Solves each stream's gain on a known signal, a polynomial in time, and divides by it; adds ``gain``.

    A stream without a solution, and samples whose gain is not above 0, are flagged and left as they are.
    """
    d = with_position(df, keys)
    p = legendre(F.col("__x"), order)
    k = len(p)
    d = d.withColumns({f"__p{j}": x for j, x in enumerate(p)} | {f"__t{j}": x * F.col(model) for j, x in enumerate(p)})
    terms = [F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
    sums = d.where(fitted(mask)).groupBy(*keys).agg(*terms, *[F.sum(F.col(f"__t{i}") * F.col("signal")).alias(f"r{i}") for i in range(k)])
    found = solved(sums, k).select(*keys, *[F.col(f"c{j}").alias(f"__c{j}") for j in range(k)])
    got = d.join(found, list(keys), "left").withColumn("gain", sum((F.col(f"__c{j}") * F.col(f"__p{j}") for j in range(k)), F.lit(0.0)))
    bad = F.col("gain").isNull() | (F.col("gain") <= 0)
    out = got.withColumns({"signal": F.when(bad, F.col("signal")).otherwise(F.col("signal") / F.col("gain")), "flags": raised("flags", bad, bit)})
    return out.select(*[c for c in df.columns if c != "gain"], "gain")
