"""Accumulating streams into maps, and reading maps along streams.

A map is a table keyed by pixel.  Accumulation is a partial and a final sum by
pixel, so a pixel that holds most samples costs one row per task.  Reading is an
equi-join on pixel; Spark broadcasts the map where it is under the configured
threshold and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import good

WEIGHTS = ("wi", "wq", "wu")


def pairs(n: int) -> list[tuple[int, int]]:
    """The upper triangle row by row."""
    return [(j, k) for j in range(n) for k in range(j, n)]


def hit_map(df: DataFrame, mask: int = 7) -> DataFrame:
    return df.where(good(mask=mask) & (F.col("pixel") >= 0)).groupBy("pixel").agg(F.count(F.lit(1)).alias("hits"))


def inverse_covariance(df: DataFrame, weights: Sequence[str] = WEIGHTS, mask: int = 7, det_weight: str = "weight") -> DataFrame:
    terms = [F.sum(F.col(weights[j]) * F.col(weights[k]) * F.col(det_weight)).alias(f"c{j}{k}") for j, k in pairs(len(weights))]
    return df.where(good(mask=mask) & (F.col("pixel") >= 0)).groupBy("pixel").agg(*terms)


def noise_weighted(df: DataFrame, weights: Sequence[str] = WEIGHTS, mask: int = 7, det_weight: str = "weight", value: str = "signal") -> DataFrame:
    terms = [F.sum(F.col(w) * F.col(value) * F.col(det_weight)).alias(f"z{k}") for k, w in enumerate(weights)]
    return df.where(good(mask=mask) & (F.col("pixel") >= 0)).groupBy("pixel").agg(*terms)


def accumulate(df: DataFrame, weights: Sequence[str] = WEIGHTS, mask: int = 7, det_weight: str = "weight", value: str = "signal") -> DataFrame:
    """Hits, inverse covariance and noise-weighted map in one pass and one shuffle."""
    dw = F.col(det_weight)
    cov = [F.sum(F.col(weights[j]) * F.col(weights[k]) * dw).alias(f"c{j}{k}") for j, k in pairs(len(weights))]
    z = [F.sum(F.col(w) * F.col(value) * dw).alias(f"z{k}") for k, w in enumerate(weights)]
    return df.where(good(mask=mask) & (F.col("pixel") >= 0)).groupBy("pixel").agg(F.count(F.lit(1)).alias("hits"), *cov, *z)


def inverse3(c: dict[tuple[int, int], Column]) -> tuple[dict[tuple[int, int], Column], Column]:
    """Cofactors over the determinant of a symmetric 3 x 3 matrix; and the determinant."""
    a, b, d, e, f, g = (c[k] for k in pairs(3))
    cof = {(0, 0): e * g - f * f, (0, 1): d * f - b * g, (0, 2): b * f - d * e, (1, 1): a * g - d * d, (1, 2): b * d - a * f, (2, 2): a * e - b * b}
    det = a * cof[0, 0] + b * cof[0, 1] + d * cof[0, 2]
    return {k: v / det for k, v in cof.items()}, det


def rcond3(c: dict[tuple[int, int], Column]) -> Column:
    """Least over largest eigenvalue of a symmetric 3 x 3 matrix, by the trigonometric solution of its cubic."""
    a, b, d, e, f, g = (c[k] for k in pairs(3))
    q = (a + e + g) / 3
    p2 = (a - q) ** 2 + (e - q) ** 2 + (g - q) ** 2 + 2 * (b * b + d * d + f * f)
    p = F.sqrt(p2 / 6)
    x, y, z = (a - q) / p, (e - q) / p, (g - q) / p
    u, v, w = b / p, d / p, f / p
    half = (x * (y * z - w * w) - u * (u * z - v * w) + v * (u * w - v * y)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    most, least = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    return F.when(p2 == 0, F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(least / most)


def covariance(sums: DataFrame, threshold: float = 1e-8) -> DataFrame:
    """Replaces c.. by its inverse and adds rcond; both are zero where rcond is below the threshold."""
    c = {k: F.col(f"c{k[0]}{k[1]}") for k in pairs(3)}
    rcond = rcond3(c)
    inv, _ = inverse3(c)
    out = sums.withColumn("rcond", F.when(rcond < threshold, 0.0).otherwise(rcond))
    ok = F.col("rcond") > 0
    return out.withColumns({f"c{j}{k}": F.when(ok, v).otherwise(0.0) for (j, k), v in inv.items()})


def binned_map(df: DataFrame, threshold: float = 1e-8, mask: int = 7, value: str = "signal") -> DataFrame:
    """hits, rcond and the IQU solution m0, m1, m2 of each pixel."""
    s = covariance(accumulate(df, mask=mask, value=value), threshold)
    c = lambda j, k: F.col(f"c{min(j, k)}{max(j, k)}")
    return s.select("pixel", "hits", "rcond", *[sum((c(j, k) * F.col(f"z{k}") for k in range(3)), F.lit(0.0)).alias(f"m{j}") for j in range(3)])


def scan_map(df: DataFrame, sky: DataFrame, sign: float = 1.0, zero: bool = False, weights: Sequence[str] = WEIGHTS, out: str = "signal") -> DataFrame:
    """signal (or 0) + sign * sum of weights times map values; off the map nothing is added."""
    names = [f"m{k}" for k in range(len(weights))]
    got = df.join(sky.select("pixel", *[F.col(n).alias(f"__{n}") for n in names]), "pixel", "left")
    seen = sum((F.col(w) * F.col(f"__{n}") for w, n in zip(weights, names, strict=True)), F.lit(0.0))
    base = F.lit(0.0) if zero else F.col(out)
    return got.withColumn(out, base + F.lit(sign) * F.coalesce(seen, F.lit(0.0))).drop(*[f"__{n}" for n in names])


def scan_mask(df: DataFrame, sky: DataFrame, bits: int = 255, value: int = 2) -> DataFrame:
    got = df.join(sky.select("pixel", F.col("mask").alias("__m")), "pixel", "left")
    hit = F.coalesce(F.col("__m").bitwiseAND(F.lit(bits)), F.lit(0)) != 0
    return got.withColumn("flags", F.when(hit, F.col("flags").bitwiseOR(F.lit(value))).otherwise(F.col("flags"))).drop("__m")


def scan_scale(df: DataFrame, sky: DataFrame, column: str = "m0") -> DataFrame:
    """Signals times the map; off the map they become 0."""
    got = df.join(sky.select("pixel", F.col(column).alias("__m")), "pixel", "left")
    return got.withColumn("signal", F.col("signal") * F.coalesce("__m", F.lit(0.0))).drop("__m")


def scan_detector_map(df: DataFrame, maps: DataFrame, key: str, weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """Each detector reads its own map: maps(key, pixel, m0, ..)."""
    names = [f"m{k}" for k in range(len(weights))]
    got = df.join(maps.select(key, "pixel", *[F.col(n).alias(f"__{n}") for n in names]), [key, "pixel"], "left")
    seen = sum((F.col(w) * F.col(f"__{n}") for w, n in zip(weights, names, strict=True)), F.lit(0.0))
    return got.withColumn("signal", F.col("signal") + F.coalesce(seen, F.lit(0.0))).drop(*[f"__{n}" for n in names])


def noise_weight(df: DataFrame, det_weight: str = "weight") -> DataFrame:
    return df.withColumn("signal", F.col("signal") * F.col(det_weight))


def cadence_map(df: DataFrame, mask: int = 7) -> DataFrame:
    """Modified Julian days on which a pixel was seen."""
    day = F.floor(F.col("t") / 86400.0 + 40587).cast("long").alias("day")
    return df.where(good(mask=mask)).select(day, "pixel").distinct()


def statistics(df: DataFrame, mask: int = 7, by: Sequence[str] = ("det",)) -> DataFrame:
    """Good samples, mean, population variance, skewness and kurtosis (3 for a Gaussian)."""
    return df.where(good(mask=mask)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("ngood"), F.avg("signal").alias("mean"), F.var_pop("signal").alias("var"), F.skewness("signal").alias("skew"), (F.kurtosis("signal") + 3).alias("kurt")
    )


def coadd(maps: Sequence[DataFrame], threshold: float = 1e-8) -> DataFrame:
    """Noise-weighted sum of maps: each has pixel, hits, inverse covariance c.. and solution m.."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    c = lambda j, k: F.col(f"c{min(j, k)}{max(j, k)}")
    z = [F.sum(sum((c(j, k) * F.col(f"m{k}") for k in range(3)), F.lit(0.0))).alias(f"z{j}") for j in range(3)]
    s = both.groupBy("pixel").agg(F.sum("hits").alias("hits"), *[F.sum(f"c{j}{k}").alias(f"c{j}{k}") for j, k in pairs(3)], *z)
    s = covariance(s, threshold)
    return s.select("pixel", "hits", "rcond", *[sum((c(j, k) * F.col(f"z{k}") for k in range(3)), F.lit(0.0)).alias(f"m{j}") for j in range(3)])


def map_stats(m: DataFrame, columns: Sequence[str] = ("m0", "m1", "m2")) -> DataFrame:
    """Sum, mean and root mean square about the mean of each component, as rows."""
    parts = [F.struct(F.lit(c).alias("component"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("rms")) for c in columns]
    return m.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def compare_maps(a: DataFrame, b: DataFrame, column: str = "m0") -> DataFrame:
    """Per pixel of either map: both values and their difference, absent ones as null."""
    x, y = a.select("pixel", F.col(column).alias("first")), b.select("pixel", F.col(column).alias("second"))
    return x.join(y, "pixel", "full").withColumn("diff", F.col("first") - F.col("second"))


def degrade_map(m: DataFrame, shift: int, columns: Sequence[str] = ("m0",)) -> DataFrame:
    """Means over nested pixels, 4 ** shift to one."""
    return m.groupBy(F.shiftright("pixel", 2 * shift).alias("pixel")).agg(*[F.avg(c).alias(c) for c in columns])


def mean_filter_matrix(df: DataFrame, mask: int = 7) -> DataFrame:
    """Pixel by pixel, (row, col, val): what taking each detector's mean off does to a binned map.

    Only pairs of pixels that one detector hits appear, from its hits by pixel.
    """
    s = df.where(good(mask=mask))
    hits = s.groupBy("det", "pixel").agg(F.count(F.lit(1)).alias("h"))
    n = hits.groupBy("det").agg(F.sum("h").alias("n"))
    total = hits.groupBy("pixel").agg(F.sum("h").alias("t"))
    pairs = hits.join(n, "det").join(hits.select("det", F.col("pixel").alias("col"), F.col("h").alias("g")), "det")
    off = pairs.groupBy(F.col("pixel").alias("row"), "col").agg(F.sum(-F.col("h") * F.col("g") / F.col("n")).alias("val"))
    one = total.select(F.col("pixel").alias("row"), F.col("pixel").alias("col"), F.col("t").cast("double").alias("val"))
    both = off.unionByName(one).groupBy("row", "col").agg(F.sum("val").alias("val"))
    return both.join(total.withColumnRenamed("pixel", "row"), "row").select("row", "col", (F.col("val") / F.col("t")).alias("val"))
