"""Filters that are windowed or grouped regressions, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.flags import good, raised


def _when(mask: int, c: Column | str) -> Column:
    return F.when(good(mask=mask), F.col(c) if isinstance(c, str) else c)


def detrend(df: DataFrame, method: str = "linear", edge: int = 10, keys: Sequence[str] = ("det",), mask: int = 7, bit: int = 1) -> DataFrame:
    """Subtracts the mean, the median, or a line through the means of the first and last ``edge`` samples.

    Only good samples are measured; all are corrected.  Where the two edges of the
    line would overlap, the stream is flagged instead.
    """
    own = W.partitionBy(*keys)
    x = _when(mask, "signal")
    if method in ("mean", "median"):
        level = F.avg(x) if method == "mean" else F.median(x)
        return df.withColumn("signal", F.col("signal") - F.coalesce(level.over(own), F.lit(0.0)))
    i = F.when(good(mask=mask), F.col("i"))
    out = df.withColumns({"__g0": F.min(i).over(own), "__g1": F.max(i).over(own)})
    e = edge
    first = F.avg(F.when(F.col("i") < F.col("__g0") + e, x)).over(own)
    last = F.avg(F.when(F.col("i") > F.col("__g1") - e, x)).over(own)
    out = out.withColumns({"__l0": first, "__l1": last, "__short": F.coalesce(F.col("__g1") - F.col("__g0") + 1 < 2 * e, F.lit(True))})
    slope = (F.col("__l1") - F.col("__l0")) / (F.col("__g1") - F.col("__g0") + 1 - e)
    line = F.col("__l0") + (F.col("i") - F.col("__g0") - (e - 1) / 2) * slope
    out = out.withColumns({"signal": F.when(F.col("__short"), F.col("signal")).otherwise(F.col("signal") - line), "flags": raised("flags", F.col("__short"), bit)})
    return out.drop("__g0", "__g1", "__l0", "__l1", "__short")


def poly_filter(df: DataFrame, order: int, keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """Orders 0 and 1 as regressions over a window; higher orders are in ``regress``."""
    own = W.partitionBy(*keys)
    x = _when(mask, "signal")
    if order == 0:
        return df.withColumn("signal", F.col("signal") - F.coalesce(F.avg(x).over(own), F.lit(0.0)))
    if order != 1:
        from .regress import poly_filter as general

        return general(df, order, keys, mask)
    n = F.count(F.lit(1)).over(own)
    at = (F.lit(-1.0) + (2 * F.row_number().over(own.orderBy("i")) - 1) / n).alias("__x")
    out = df.withColumn("__x", at)
    u = _when(mask, "__x")
    slope, base = F.regr_slope(x, u).over(own), F.regr_intercept(x, u).over(own)
    out = out.withColumns({"__s": slope, "__b": F.coalesce(base, F.avg(x).over(own), F.lit(0.0))})
    return out.withColumn("signal", F.col("signal") - F.col("__b") - F.coalesce(F.col("__s"), F.lit(0.0)) * F.col("__x")).drop("__x", "__s", "__b")


def common_mode(df: DataFrame, sample: str = "sample", group: str | None = None, mask: int = 7, regress: bool = False) -> DataFrame:
    """Subtracts the mean over good detectors of a group at each sample, or its regression on each detector.

    The mean is a grouped sum and a join, not a window, so that partial sums run first.
    """
    keys = [sample, *([group] if group else [])]
    mode = df.where(good(mask=mask)).groupBy(*keys).agg(F.avg("signal").alias("__mode"))
    out = df.join(mode, keys, "left")
    if not regress:
        return out.withColumn("signal", F.col("signal") - F.coalesce("__mode", F.lit(0.0))).drop("__mode")
    own = W.partitionBy("det")
    x, y = _when(mask, "__mode"), _when(mask, "signal")
    out = out.withColumns({"__s": F.regr_slope(y, x).over(own), "__b": F.regr_intercept(y, x).over(own)})
    model = F.coalesce(F.col("__b") + F.col("__s") * F.col("__mode"), F.lit(0.0))
    return out.withColumn("signal", F.col("signal") - model).drop("__mode", "__s", "__b")


def ground_bins(df: DataFrame, width: float, az: str = "az", keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """Subtracts the mean of good samples in each azimuth bin of each detector."""
    own = W.partitionBy(*keys, F.floor(F.col(az) / width))
    return df.withColumn("signal", F.col("signal") - F.coalesce(F.avg(_when(mask, "signal")).over(own), F.lit(0.0)))


def hwp_moments(df: DataFrame, angle: str, harmonics: int, keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """Mean products of the signal with the harmonics of an angle (radians): the right-hand side of the harmonic fit."""
    terms = []
    for k in range(1, harmonics + 1):
        terms += [F.avg(F.col("signal") * F.cos(k * F.col(angle))).alias(f"c{k}"), F.avg(F.col("signal") * F.sin(k * F.col(angle))).alias(f"s{k}")]
    return df.where(good(mask=mask)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *terms)


def t2p_filter(df: DataFrame, intensity: str, targets: Sequence[str], keys: Sequence[str] = ("det",), mask: int = 7) -> DataFrame:
    """Regresses an intensity column, with an offset, out of others."""
    own = W.partitionBy(*keys)
    x = _when(mask, intensity)
    out = df
    for c in targets:
        y = _when(mask, c)
        out = out.withColumns({f"__s{c}": F.regr_slope(y, x).over(own), f"__b{c}": F.regr_intercept(y, x).over(own)})
    fits = {c: F.col(c) - F.coalesce(F.col(f"__b{c}") + F.col(f"__s{c}") * F.col(intensity), F.lit(0.0)) for c in targets}
    return out.withColumns(fits).drop(*[p + c for c in targets for p in ("__s", "__b")])


def crosstalk(df: DataFrame, matrix: DataFrame, sample: str = "sample", add: bool = True) -> DataFrame:
    """d_i (+)= sum over j of x_ij d_j: matrix(det_out, det, coef); df has one value per det and sample."""
    sent = df.select(F.col("det"), sample, "signal").join(matrix, "det").groupBy(F.col("det_out").alias("det"), sample).agg(F.sum(F.col("coef") * F.col("signal")).alias("__x"))
    out = df.join(sent, ["det", sample], "left")
    base = F.col("signal") if add else F.lit(0.0)
    return out.withColumn("signal", base + F.coalesce("__x", F.lit(0.0))).drop("__x")


def crosslinking(df: DataFrame, theta: str, phi: str, mask: int = 7) -> DataFrame:
    """Per pixel sums of (1, cos 2a, sin 2a), a being the direction of the scan on the sky."""
    own = W.partitionBy("det").orderBy("i")
    lat = F.pi() / 2 - F.col(theta)

    def slope(c: Column) -> Column:
        before, after = F.lag(c).over(own), F.lead(c).over(own)
        return F.coalesce((after - before) / 2, after - c, c - before, F.lit(0.0))

    out = df.withColumn("__lat", lat)
    out = out.withColumns({"__dl": slope(F.col("__lat")), "__dp": slope(F.col(phi)) * F.cos("__lat")})
    angle = F.when(F.abs("__dp") < 1e-30, F.signum("__dl") * F.pi() / 2).otherwise(F.atan(F.col("__dl") / F.col("__dp")))
    out = out.withColumn("__a", angle).where(good(mask=mask))
    return out.groupBy("pixel").agg(F.count(F.lit(1)).cast("double").alias("x0"), F.sum(F.cos(2 * F.col("__a"))).alias("x1"), F.sum(F.sin(2 * F.col("__a"))).alias("x2"))


def signal_diff_noise(df: DataFrame, rate: float, mask: int = 7) -> DataFrame:
    """White noise level of each detector from differences of neighbours that are both good."""
    own = W.partitionBy("det").orderBy("i")
    both = good(mask=mask) & good(F.coalesce(F.lead("flags").over(own), F.lit(mask)), mask)
    d = df.select("det", F.when(both, F.lead("signal").over(own) - F.col("signal")).alias("d"))
    return d.groupBy("det").agg((F.stddev_pop("d") / F.sqrt(F.lit(2.0)) / F.sqrt(F.lit(rate))).alias("net"))


def elevation_noise(noise: DataFrame, elevations: DataFrame, a: float, c: float, extra: float = 1.0) -> DataFrame:
    """Noise spectra scaled by (a / sin(el) + c) squared with each detector's median elevation: noise(det, freq, psd)."""
    el = elevations.groupBy("det").agg(F.median("el").alias("el"))
    return noise.join(el, "det").withColumn("psd", F.col("psd") * F.pow((F.lit(a) / F.sin("el") + c) * extra, 2)).drop("el")


def lagged_covariance(df: DataFrame, lags: Sequence[int], mask: int = 7) -> DataFrame:
    """Mean product of good samples a lag apart, per detector and lag."""
    own = W.partitionBy("det").orderBy("i")
    x = F.when(good(mask=mask), F.col("signal"))
    out = df.select("det", "i", x.alias("x"), "flags").withColumns({f"p{k}": F.col("x") * (F.lead("x", k).over(own) if k else F.col("x")) for k in lags})
    rows = out.select("det", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("p")) for k in lags])))
    return rows.where("p is not null").groupBy("det", "lag").agg(F.count(F.lit(1)).alias("hits"), F.avg("p").alias("cov"))
