"""Simulated observations: scans, noise, gains, glitches, schedules and focal planes.

Random numbers come from a counter-based generator keyed by names, so that any
task makes the same numbers again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..functions import rng
from .sequences import model_psd


def satellite_schedule(spark: SparkSession, n: int, minutes: float, gap: float = 0.0, prec: float = 50.0, spin: float = 10.0, start: float = 0.0) -> DataFrame:
    """n scans of equal length (minutes), ``gap`` minutes apart."""
    k = spark.range(n)
    begin = start + F.col("id") * (minutes + gap) * 60
    return k.select(F.format_string("obs_%06d", "id").alias("obs"), begin.alias("start"), (begin + minutes * 60).alias("stop"), F.lit(prec).alias("prec_period"), F.lit(spin).alias("spin_period"))


def satellite(schedule: DataFrame, rate: float, prec_angle: float = 65.0, spin_angle: float = 30.0, hwp_rpm: float | None = None) -> DataFrame:
    """Samples of each scan with boresight quaternions bx..bw: precession, spin, and the plate's angle.

    Rows are made where they are needed: a scan is exploded by blocks of samples, so one
    long scan is many tasks after the repartition.
    """
    n = F.floor((F.col("stop") - F.col("start")) * rate).cast("long")
    block = 1 << 16
    blocks = schedule.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(block).cast("long"))).alias("b")).repartition("obs", "b")
    s = blocks.select("obs", "start", "prec_period", "spin_period", F.explode(F.sequence(F.col("b"), F.least(F.col("b") + block, F.col("n")) - 1)).alias("i"))
    s = s.select("obs", "i", (F.col("start") + F.col("i") / rate).alias("t"), "prec_period", "spin_period")
    turn = lambda period: 2 * F.pi() * (F.col("t") / (60 * F.col(period)) - F.floor(F.col("t") / (60 * F.col(period))))
    z, x = Q.of((0, 0, 1)), Q.of((1, 0, 0))
    steps = [(z, turn("prec_period")), (x, F.radians(F.lit(prec_angle))), (z, turn("spin_period")), (x, F.radians(F.lit(spin_angle))), (z, F.pi() / 2)]
    s = s.withColumns({"bx": F.lit(0.0), "by": F.lit(0.0), "bz": F.lit(0.0), "bw": F.lit(1.0)})
    for axis, angle in steps:  # a projection each, so that expressions stay small
        q = Q.mult(tuple(F.col(c) for c in ("bx", "by", "bz", "bw")), Q.rotation(axis, angle))
        s = s.select("obs", "i", "t", "prec_period", "spin_period", F.inline(F.array(F.struct(*[c.alias(n) for c, n in zip(q, ("bx", "by", "bz", "bw"), strict=True)]))))
    plate = F.lit(0.0) if hwp_rpm is None else 2 * F.pi() * (F.col("t") * hwp_rpm / 60 - F.floor(F.col("t") * hwp_rpm / 60))
    return s.withColumn("hwp_angle", plate).drop("prec_period", "spin_period")


def ground_scan(schedule: DataFrame, rate: float, speed: float = 1.0, accel: float = 1.0) -> DataFrame:
    """Constant-elevation scans: schedule(obs, start, stop, az_min, az_max, el) -> samples with az, el and ``moving`` (1, -1, or 0 in turns).

    A period is a sweep at ``speed`` degrees a second, a parabolic turn, the sweep back and
    another turn; each sample's place follows from its time alone.
    """
    n = F.floor((F.col("stop") - F.col("start")) * rate).cast("long")
    s = schedule.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).alias("i"))
    sweep, turn = (F.col("az_max") - F.col("az_min")) / speed, 2.0 * speed / accel
    s = s.withColumns({"t": F.col("start") + F.col("i") / rate, "__p": F.pmod(F.col("i") / rate, 2 * (sweep + turn))})
    p = F.col("__p")
    back = p >= sweep + turn
    u = F.when(back, p - sweep - turn).otherwise(p)
    coast = u < sweep
    over = u - sweep
    bulge = speed * over - accel * over * over / 2
    forward = F.when(coast, F.col("az_min") + speed * u).otherwise(F.col("az_max") + bulge)
    backward = F.when(coast, F.col("az_max") - speed * u).otherwise(F.col("az_min") - bulge)
    return s.select("obs", "i", "t", F.when(back, backward).otherwise(forward).alias("az"), "el", F.when(coast, F.when(back, -1).otherwise(1)).otherwise(0).alias("moving"))


def hex_focalplane(spark: SparkSession, rings: int, fov: float, telescope: str = "tel") -> DataFrame:
    """A hexagon of pixels of two detectors each, at right angles: det, pixel, quaternion fx..fw, gamma."""
    at = [(0.0, 0.0)]
    for ring in range(1, rings + 1):
        corners = [(ring * np.cos(k * np.pi / 3), ring * np.sin(k * np.pi / 3)) for k in range(7)]
        at += [tuple((1 - s / ring) * np.array(corners[k]) + s / ring * np.array(corners[k + 1])) for k in range(6) for s in range(ring)]
    rows = []
    for k, (x, y) in enumerate(at):
        theta, phi = np.hypot(x, y) / max(rings, 1) * np.radians(fov) / 2, np.arctan2(y, x)
        for name, psi in (("A", 0.0), ("B", np.pi / 2)):
            a, b = theta / 2, (phi, psi - phi)
            c, s = np.cos(a), np.sin(a)
            half, diff = (b[0] + b[1]) / 2, (b[0] - b[1]) / 2
            rows.append((telescope, f"D{k:03d}{name}", k, -s * np.sin(diff), s * np.cos(diff), c * np.sin(half), c * np.cos(half), psi))
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], "telescope string, det string, pixel_id int, fx double, fy double, fz double, fw double, gamma double")


def noise(df: DataFrame, rate: float, keys: Sequence[str] = ("det",), realization: int = 0) -> DataFrame:
    """Adds noise with the spectrum of columns net, fknee, fmin, alpha; each stream is keyed by its name."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        from zlib import crc32

        p = p.sort_values("i", kind="stable").reset_index(drop=True)
        n = len(p)
        size = 1 << (2 * n).bit_length()
        key = crc32("/".join(str(p[k].iloc[0]) for k in keys).encode())
        g = rng.gaussian(rng.threefry(np.full(size, realization), np.full(size, key), np.zeros(size), np.arange(size))[0])
        f = np.fft.rfftfreq(size, 1 / rate)
        net, fk, fm, al = (float(p[c].iloc[0]) for c in ("net", "fknee", "fmin", "alpha"))
        psd = np.r_[0.0, model_psd(f[1:], net, fk, fm, al)]
        x = np.fft.irfft(np.fft.rfft(g) * np.sqrt(psd * rate), size)[(size - n) // 2 :][:n]
        return p.assign(signal=p["signal"] + x - x.mean())

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def gain_scramble(df: DataFrame, center: float = 1.0, sigma: float = 0.001, pattern: str = ".*", realization: int = 0) -> DataFrame:
    """Signals of matching detectors times a Gaussian number drawn for the detector."""
    name = F.col("det").cast("string")
    draw = df.select("det").distinct().withColumn("__g", rng.column("gaussian")(F.lit(realization).cast("long"), rng.name_uid(name), F.lit(0).cast("long"), F.lit(0).cast("long")))
    gain = F.when(name.rlike(f"^(?:{pattern})"), center + sigma * F.col("__g")).otherwise(1.0)
    return df.join(draw, "det").withColumn("signal", F.col("signal") * gain).drop("__g")


def gain_drift(df: DataFrame, sigma: float = 0.001, keys: Sequence[str] = ("det",), realization: int = 0) -> DataFrame:
    """Linear drift: from 1 at the first sample to 1 + N sigma at the last."""
    own = W.partitionBy(*keys)
    draw = df.select(*keys).distinct().withColumn("__g", rng.column("gaussian")(F.lit(realization).cast("long"), rng.name_uid(F.concat_ws("/", *keys)), F.lit(1).cast("long"), F.lit(0).cast("long")))
    last = F.greatest(F.max("i").over(own), F.lit(1))
    return df.join(draw, list(keys)).withColumn("signal", F.col("signal") * (1 + sigma * F.col("__g") * F.col("i") / last)).drop("__g")


def cosmic_rays(df: DataFrame, rate: float, eventrate: float = 0.0015, size: float = 1.0, tau: float = 0.1, keys: Sequence[str] = ("det",), realization: int = 0) -> DataFrame:
    """Adds glitches that come at random and decay with a time constant (seconds)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        from zlib import crc32

        p = p.sort_values("i", kind="stable").reset_index(drop=True)
        g = np.random.default_rng([realization, crc32("/".join(str(p[k].iloc[0]) for k in keys).encode())])
        d = p["signal"].to_numpy(float).copy()
        for at in np.sort(g.integers(0, len(d), g.poisson(eventrate * len(d) / rate))):
            d[at:] += size * g.exponential() * np.exp(-np.arange(len(d) - at) / (tau * rate))
        return p.assign(signal=d)

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def perturb_hwp(samples: DataFrame, drift: float, keys: Sequence[str] = ("obs",)) -> DataFrame:
    """The plate's angle for a rotation rate that goes linearly from (1 - drift) to (1 + drift) of its mean."""
    own = W.partitionBy(*keys)
    t0, t1 = F.min("t").over(own), F.max("t").over(own)
    a0, step = F.min_by("hwp_angle", "i").over(own), F.lead("hwp_angle").over(own.orderBy("i")) - F.col("hwp_angle")
    out = samples.withColumns({"__t0": t0, "__t1": t1, "__a0": a0, "__dt": F.lead("t").over(own.orderBy("i")) - F.col("t"), "__step": step})
    speed = F.median(F.when(F.col("__step") > 0, F.col("__step") / F.col("__dt"))).over(own)
    out = out.withColumn("__w", F.coalesce(speed, F.lit(0.0)))
    u = F.col("t") - F.col("__t0")
    angle = F.col("__a0") + F.col("__w") * (1 - drift) * u + F.col("__w") * drift / F.greatest(F.col("__t1") - F.col("__t0"), F.lit(1e-300)) * u * u
    return out.withColumn("hwp_angle", F.pmod(angle, 2 * F.pi())).drop("__t0", "__t1", "__a0", "__dt", "__step", "__w")


def catalog_signal(df: DataFrame, sources: DataFrame, fwhm: float) -> DataFrame:
    """Adds point sources through a Gaussian beam: df(x, y, z unit vectors, wi, wq, wu), sources(sx, sy, sz, flux, pol_frac, pol_angle).

    Sources are a catalogue, one row each; where Spark does not broadcast it, the join runs on cells of the sky of the beam's width.
    """
    radius, sigma = 3 * fwhm, fwhm / np.sqrt(8 * np.log(2))
    cell = max(4 * radius, 1e-3)
    cells = lambda c: F.floor(F.col(c) / cell)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    s = sources
    for k, c in enumerate("xyz"):
        s = s.withColumn(f"__o{c}", near).withColumn(f"__c{c}", (cells(f"s{c}") + F.col(f"__o{c}")).cast("long")).drop(f"__o{c}")
    d = df.withColumns({f"__c{c}": cells(c).cast("long") for c in "xyz"})
    dot = F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz")
    hit = d.join(s, ["__cx", "__cy", "__cz"]).withColumn("__d", F.acos(F.least(dot, F.lit(1.0)))).where(F.col("__d") < radius)
    beam = F.exp(-(F.col("__d") ** 2) / (2 * sigma**2))
    pol = F.col("wq") * F.cos(2 * F.col("pol_angle")) + F.col("wu") * F.sin(2 * F.col("pol_angle"))
    got = hit.groupBy("det", "i").agg(F.sum(F.col("flux") * beam * (F.col("wi") + F.col("pol_frac") * pol)).alias("__v"))
    return df.join(got, ["det", "i"], "left").withColumn("signal", F.col("signal") + F.coalesce("__v", F.lit(0.0))).drop("__v")


def common_mode_noise(noise_keys: DataFrame, dets: DataFrame, group: str | None, net: float, fknee: float, fmin: float, alpha: float, center: float = 1.0, width: float = 0.0, realization: int = 0) -> tuple[DataFrame, DataFrame]:
    """(noise table with a key per group, mixing rows that couple each detector to its group's key)."""
    name = F.concat(F.lit("common_"), F.col(group).cast("string") if group else F.lit("all"))
    draw = rng.column("gaussian")(F.lit(realization).cast("long"), rng.name_uid(F.col("det").cast("string")), F.lit(2).cast("long"), F.lit(0).cast("long"))
    mixing = dets.select("det", name.alias("key"), (center + width * draw).alias("w"))
    rows = mixing.select("key").distinct().select("key", *[F.lit(v).alias(c) for c, v in (("net", net), ("fknee", fknee), ("fmin", fmin), ("alpha", alpha))])
    return noise_keys.unionByName(rows), mixing


def weather(sites: DataFrame, table: DataFrame, median: bool = False, realization: int = 0) -> DataFrame:
    """sites(obs, site, month, hour, variable), table(site, month, hour, variable, prob array, value array) -> value by inverse distribution."""
    u = F.lit(0.5) if median else rng.column("uniform_01")(F.lit(realization).cast("long"), rng.name_uid("site"), F.col("month") * 24 + F.col("hour"), rng.name_uid("variable"))
    got = sites.withColumn("__u", u).join(table, ["site", "month", "hour", "variable"])
    k = F.greatest(F.lit(1), F.least(F.size("prob") - 1, F.size(F.filter("prob", lambda p: p <= F.col("__u")))))
    p0, p1, v0, v1 = F.element_at("prob", k), F.element_at("prob", k + 1), F.element_at("value", k), F.element_at("value", k + 1)
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__u") - p0) / F.greatest(p1 - p0, F.lit(1e-300))))
    return got.withColumn("drawn", v0 + f * (v1 - v0)).drop("__u", "prob", "value")


