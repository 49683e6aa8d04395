"""Detector pointing, pixels and Stokes weights of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix, wcs
from ..functions import quaternion as Q
from ..functions.flags import good
from ..functions.physics import stokes_weights as weights_of

BORE, FP, DET = ("bx", "by", "bz", "bw"), ("fx", "fy", "fz", "fw"), ("qx", "qy", "qz", "qw")


def detector_pointing(samples: DataFrame, dets: DataFrame, mask: int = 7, rotate: tuple[float, ...] | None = None) -> DataFrame:
    """Every sample for every detector with its quaternion; a flagged sample has the detector's own.

    The focal plane is the small side by nature: one row per detector.  It is joined
    on the telescope, and Spark broadcasts it under its size threshold.
    """
    got = samples.join(dets, "telescope")
    b = tuple(F.col(c) for c in BORE)
    if rotate is not None:
        b = Q.mult(Q.of(rotate), b)
    q = Q.mult(b, tuple(F.col(c) for c in FP))
    ok = good(mask=mask)
    return got.withColumns({c: F.when(ok, v).otherwise(F.col(f)) for c, v, f in zip(DET, q, FP, strict=True)})


def fixed_pointing(samples: DataFrame, dets: DataFrame) -> DataFrame:
    """The boresight pinned to the zenith: each detector's quaternion is its own."""
    return samples.join(dets, "telescope").withColumns({c: F.col(f) for c, f in zip(DET, FP, strict=True)})


def pixels_healpix(df: DataFrame, nside: int, nest: bool = True, mask: int = 7, out: str = "pixel") -> DataFrame:
    d = Q.rotate(tuple(F.col(c) for c in DET), Q.of((0, 0, 1)))
    df = df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for c, n in zip(d, ("__vx", "__vy", "__vz"), strict=True)]))))
    df = healpix.vec_pixel(df, F.col("__vx"), F.col("__vy"), F.col("__vz"), nside, out, nest)
    return df.withColumn(out, F.when(good(mask=mask), F.col(out)).otherwise(-1)).drop("__vx", "__vy", "__vz")


def pixels_wcs(df: DataFrame, kind: str, center: tuple[float, float], size: tuple[int, int], resolution: float, mask: int = 7, out: str = "pixel") -> DataFrame:
    d = Q.rotate(tuple(F.col(c) for c in DET), Q.of((0, 0, 1)))
    df = df.withColumns({"__lon": F.degrees(F.atan2(d[1], d[0])), "__lat": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d[2]))))})
    pix = wcs.wcs_pixel(kind, F.col("__lon"), F.col("__lat"), center, size, resolution)
    return df.withColumn(out, F.when(good(mask=mask), pix).otherwise(-1)).drop("__lon", "__lat")


def auto_bounds(df: DataFrame, lon: str, lat: str, mask: int = 7) -> DataFrame:
    return df.where(good(mask=mask)).agg(F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"))


def stokes_weights(df: DataFrame, hwp: str | None = None, iau: bool = False) -> DataFrame:
    w = weights_of(tuple(F.col(c) for c in DET), hwp=F.col(hwp) if hwp else None, gamma=F.col("gamma") if hwp else 0.0, iau=iau)
    return df.withColumns(dict(zip(("wi", "wq", "wu"), w, strict=True)))


def stokes_weights_demod(df: DataFrame, name: str = "det") -> DataFrame:
    """One weight of 1 by the prefix of a demodulated detector's name."""
    is_ = lambda p: F.when(F.col(name).startswith(p), 1.0).otherwise(0.0)
    return df.withColumns({"wi": is_("demod0"), "wq": is_("demod4r"), "wu": is_("demod4i")})


def pixel_distribution(df: DataFrame, n_sub: int) -> DataFrame:
    """The submaps that samples touch."""
    return df.where("pixel >= 0").select(F.floor(F.col("pixel") / n_sub).cast("long").alias("submap")).distinct()


def interpolate_map(df: DataFrame, sky: DataFrame, neighbours: str = "near", out: str = "signal") -> DataFrame:
    """Adds the weighted mean of the map at each sample's neighbours: an array of (pixel, weight)."""
    each = df.select("det", "i", F.inline(neighbours).alias("pixel", "w"))
    got = each.join(sky.select("pixel", "m0"), "pixel").groupBy("det", "i").agg((F.sum(F.col("w") * F.col("m0")) / F.sum("w")).alias("__v"))
    return df.join(got, ["det", "i"], "left").withColumn(out, F.col(out) + F.coalesce("__v", F.lit(0.0))).drop("__v")
