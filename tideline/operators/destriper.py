"""Destriping map-making: (M^T N^-1 Z M) a = M^T N^-1 Z d by conjugate gradients.

Z takes from a stream the map binned from it.  One application is a sum by pixel,
a join on pixel and a sum by amplitude; the stream itself is written once to the
shared folder, vectors of amplitudes once per iteration, which cuts lineage.
Only dot products come to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import binned_map, coadd, covariance  # noqa: F401  (part of this module's interface)
from .templates import Offset


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back; on a single machine the warehouse serves where that is unset."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_sky(df: DataFrame, value: str = "signal") -> DataFrame:
    """Z d: good samples less the weighted mean of their pixel (intensity only)."""
    w = F.col("weight")
    sky = df.where("good").groupBy("pixel").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("__m"))
    return df.join(sky, "pixel", "left").withColumn(value, F.when(F.col("good"), F.col(value) - F.col("__m")).otherwise(0.0)).drop("__m")


def right_side(df: DataFrame, template: Offset) -> DataFrame:
    """M^T N^-1 Z d as (det, amp, value)."""
    z = without_sky(df)
    return z.where("good").groupBy("det", template.key()).agg(F.sum(F.col("weight") * F.col("signal")).alias("value"))


def left_side(df: DataFrame, amps: DataFrame, template: Offset) -> DataFrame:
    """M^T N^-1 Z M a."""
    return right_side(template.add(df.withColumn("signal", F.lit(0.0)), amps), template)


def _dot(a: DataFrame, b: DataFrame) -> float:
    return a.join(b.select("det", "amp", F.col("value").alias("__b")), ["det", "amp"]).agg(F.sum(F.col("value") * F.col("__b"))).first()[0] or 0.0


def _plus(a: DataFrame, b: DataFrame, scale: float, name: str) -> DataFrame:
    both = a.select("det", "amp", "value").unionByName(b.select("det", "amp", (F.col("value") * scale).alias("value")))
    return kept(both.groupBy("det", "amp").agg(F.sum("value").alias("value")), name)


def solve_amplitudes(df: DataFrame, template: Offset, convergence: float = 1e-12, iter_min: int = 3, iter_max: int = 100, mask: int = 7) -> DataFrame:
    """Amplitudes of (det, i, pixel, signal, flags, weight): preconditioned conjugate gradients from zero.

    Stops when the squared residual falls below ``convergence`` of that of the right
    side, or when ten iterations have not halved the best one.
    """
    from ..functions.flags import good

    d = kept(df.select("det", "i", "pixel", "signal", "weight", good(mask=mask).alias("good")), "stream")
    # Steps with few good samples are left out of the fit as a whole.
    share = d.groupBy("det", template.key()).agg(F.avg(F.when(F.col("good"), 1.0).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("good"), F.col("weight")).otherwise(0.0)).alias("w"))
    use = kept(share.where(F.col("s") > template.good_fraction), "steps")
    d = d.withColumn("amp", template.key()).join(use.select("det", "amp", F.lit(True).alias("__use")), ["det", "amp"], "left")
    d = kept(d.withColumn("good", F.col("good") & F.col("__use").isNotNull()).drop("__use", "amp"), "stream")
    precondition = lambda r: r.join(use.select("det", "amp", "w"), ["det", "amp"]).select("det", "amp", (F.col("value") / F.col("w")).alias("value"))
    r = kept(right_side(d, template), "rhs")
    a = r.withColumn("value", F.lit(0.0))
    p = kept(precondition(r), "p")
    first = _dot(r, r)
    rz, best, last_best = _dot(r, p), first, first
    for k in range(iter_max):
        if first == 0 or rz == 0:
            break
        q = kept(left_side(d, p, template), "q")
        curvature = _dot(p, q)
        if curvature <= 0:
            break
        alpha = rz / curvature
        a, r = _plus(a, p, alpha, "a"), _plus(r, q, -alpha, "r")
        size = _dot(r, r)
        best = min(best, size)
        if size / first < convergence or size < 1e-30:
            break
        if k >= iter_min and k % 10 == 0:
            if last_best < 2 * best:
                break
            last_best = best
        z = precondition(r)
        new = _dot(r, z)
        p = _plus(z, p, new / rz, "p")
        rz = new
    return a


def apply_amplitudes(df: DataFrame, amps: DataFrame, template: Offset) -> DataFrame:
    return template.add(df, amps, sign=-1.0)


def map_maker(df: DataFrame, template: Offset, **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """(cleaned map, amplitudes) of a stream with Stokes weights wi, wq, wu."""
    amps = solve_amplitudes(df, template, **options)
    return binned_map(apply_amplitudes(df, amps, template)), amps
