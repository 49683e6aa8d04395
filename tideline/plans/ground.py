"""Queries of ground scans, calibration, map interpolation and of small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import healpix
from ..operators import destriper, ground, pointing, simulate
from ..operators.templates import Offset
from ..sources import streams as S
from . import catalog, sqltext
from .catalog import GOOD, query, r, rounded
from .sequences import _stream

#: A scan of 300 seconds at 10 Hz between 40 and 44 degrees, a degree a second, turns of 2 seconds.
_AZ = """with k as (select range as i, range / 10.0::double as t, (range / 10.0::double) % 12 as p from range(3000)),
k2 as (select *, p >= 6 as back, case when p >= 6 then p - 6 else p end as u from k),
scan as (select i, t, case when u < 4 then case when back then 44 - u else 40 + u end when back then 40 - ((u - 4) - (u - 4) * (u - 4) / 2) else 44 + ((u - 4) - (u - 4) * (u - 4) / 2) end as az, 50.0::double as el from k2)
"""


def _smooth(src: str, c: str, out: str) -> str:
    return f"""{out} as (select *, (sum({c}) over (order by i rows between 2 preceding and 2 following) + greatest(2 - i, 0) * first_value({c}) over w + greatest(i + 2 - 2999, 0) * last_value({c}) over w) / 5 as s_{c}
  from {src} window w as (order by i rows between unbounded preceding and unbounded following)),
{out}g as (select *, case when i = 0 then lead(s_{c}) over w - s_{c} when i = 2999 then s_{c} - lag(s_{c}) over w else (lead(s_{c}) over w - lag(s_{c}) over w) / 2 end as d_{c} from {out} window w as (order by i)),
"""


def _scan(spark):  # noqa: ANN001, ANN202
    s = spark.createDataFrame([("ces", 0.0, 300.0, 40.0, 44.0, 50.0)], "obs string, start double, stop double, az_min double, az_max double, el double")
    return simulate.ground_scan(s, 10.0).withColumn("flags", F.lit(0))


@query("azimuth_intervals", _AZ + ", " + _smooth("scan", "az", "g1") + _smooth("g1g", "d_az", "g2") + f"""
x as (select i, t, d_az as vel, abs(d_d_az) < 0.1 * (max(d_d_az) over () - min(d_d_az) over ()) and abs(d_az) > 0.1 * (max(d_az) over () - min(d_az) over ()) as ok from g2g),
runs as (select min(i) as a, max(i) as b from (select i, i - row_number() over (order by i) as g from x where ok) group by g),
isl as (select greatest(a - 1, 0) as first, case when b = 2999 then 3000 else b end as last from runs),
len as (select first, last, y.t - x.t as l, count(*) over () as k from isl join x on x.i = first join x y on y.i = last - 1 where last > first),
cut1 as (select * from len where k < 4 or l >= 0.25 * (select median(l) from len)),
cut2 as (select * from cut1 where k < 4 or l <= 1.25 * (select median(l) from cut1)),
sc as (select first, last, lead(first) over (order by first) as nxt from cut2),
chg as (select i from (select i, vel * lead(vel) over (order by i) < 0 as c from x) where c),
tn as (select first, count(*) as n, min(i) as pt from sc join chg on i >= last and i + 1 < nxt group by first),
e as (select sc.first, last, case when nxt is null then last when n = 1 then pt else last + (nxt - last) // 2 end as fin from sc left join tn on tn.first = sc.first),
f as (select first, last, coalesce(lag(fin) over (order by first) + 1, first) as begin, fin, first + (last - first) // 2 as mid from e),
w as (select f.*, case when vel >= 0 then 'leftright' else 'rightleft' end as way from f join x on x.i = mid),
inv as (select coalesce(lag(last) over (order by first), 0) as first, first as last from sc union all select max(last), 3000 from sc)
select 'ces' as obs, 'scanning' as kind, first, last from w union all select 'ces', 'scan_' || way, first, last from w
union all select 'ces', 'throw', begin, fin from w union all select 'ces', 'throw_' || way, begin, fin from w
union all select 'ces', 'turnaround', first, last from inv where last > first""", base=False)
def _(spark, d):
    return ground.azimuth_intervals(_scan(spark), 5)


_RING = catalog._HPX[len(catalog._QUATS):]


@query("scan_synchronous", """, v as (select det * 100000 + i as k, cos(radians(30 + det % 50)) * cos(radians(-az)) as dx, cos(radians(30 + det % 50)) * sin(radians(-az)) as dy, sin(radians(30 + det % 50)) as dz from s0)"""
       + _RING.replace("\n", "\n", 1) + f""", m as (select *, case when eq then 65 + jp - jm else jp + jm + 1 end as r from l),
n as (select *, case when eq then (((jp + jm - 64 + (1 - (r & 1)) + 1) >> 1) % 256 + 256) % 256 else floor(tt * r)::bigint % (4 * r) end as ip from m),
px as (select k, (case when eq then 128 * 63 + (r - 1) * 256 + ip when z > 0 then 2 * r * (r - 1) + ip else 49152 - 2 * r * (r + 1) + ip end)::bigint as pixel from n)
select det, i, {r(f"signal + case when {GOOD} then (px.pixel % 97) / 10.0::double * pow((30 + det % 50) / 90.0::double + 0.5, -1) else 0 end", 'signal')} from s0 join px on px.k = det * 100000 + i""")
def _(spark, d):
    s = _stream(spark, d).withColumn("el", (30 + F.col("det") % 50).cast("double"))
    sky = spark.range(12 * 64 * 64).select(F.col("id").alias("pixel"), ((F.col("id") % 97) / 10.0).alias("value"))
    return ground.scan_synchronous(s, sky, 64).withColumns(rounded("signal")).select("det", "i", "signal")


@query("calibrate", sqltext.PLACED + ", w as (select u.*, 10 + m0 + wq * m1 + wu * m2 as model from u join sky using (pixel))" + sqltext.fit("w", ["model", "x * model"])
       + f"""select det, i, {r('case when c0 + c1 * x > 0 then signal / (c0 + c1 * x) else signal end', 'signal')}, {r('c0 + c1 * x', 'gain')}, case when c0 + c1 * x > 0 then flags else flags | 1 end as flags from v left join c using (det)""")
def _(spark, d):
    s = _stream(spark, d).join(S.sky(spark), "pixel")
    s = s.withColumn("model", 10 + F.col("m0") + F.col("wq") * F.col("m1") + F.col("wu") * F.col("m2"))
    # Places are those of the whole stream; samples beside the map only have no model.
    ends = _stream(spark, d).groupBy("det").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    whole = _stream(spark, d).join(S.sky(spark), "pixel", "left_anti").select("det", "i", "t", "signal", F.lit(1).alias("flags"), "pixel", "az", "wq", "wu").withColumn("model", F.lit(0.0))
    out = ground.calibrate(s.select("det", "i", "t", "signal", "flags", "pixel", "az", "wq", "wu", "model").unionByName(whole), 1)
    return out.join(S.sky(spark).select("pixel"), "pixel", "left_semi").withColumns(rounded("signal", "gain")).select("det", "i", "signal", "gain", "flags")


@query("healpix_interpolate", f"""with k as (select c_custkey as k, pi() * (c_custkey % 997 + 0.5) / 997 as th, 2 * pi() * ((c_custkey * 7) % 1009) / 1009 as ph from customer),
a as (select *, cos(th) as z from k),
b as (select *, case when abs(z) <= 2.0::double / 3 then floor(16 * (2 - 1.5 * z))::bigint when z > 0 then floor(16 * sqrt(3 * (1 - abs(z))))::bigint else 63 - floor(16 * sqrt(3 * (1 - abs(z))))::bigint end as up from a),
g as (select *, side, case side when 0 then greatest(up, 1) else least(up + 1, 63) end as ring from b, (select range as side from range(2))),
h as (select *, case when ring > 32 then 64 - ring else ring end as nr from g),
f as (select *, case when nr < 16 then 4 * nr else 64 end as size, case when nr < 16 then 2 * nr * (nr - 1) else 480 + (nr - 16) * 64 end as fn,
       acos(case when nr < 16 then 1 - nr * nr / 768.0::double else (32 - nr) * 2 / 48.0::double end) as tn, case when nr < 16 or (nr - 16) % 2 = 0 then 0.5::double else 0.0::double end as sh from h),
e as (select *, case when nr <> ring then 3072 - fn - size else fn end as first, case when nr <> ring then pi() - tn else tn end as theta, ph * size / (2 * pi()) - sh as pos from f),
p as (select *, floor(pos)::bigint as lo, pos - floor(pos) as w from e),
q as (select k, th, up, side, theta, first + (lo % size + size) % size as p0, first + ((lo + 1) % size + size) % size as p1, w from p),
j as (select x.k, x.th, x.up, x.theta as ta, y.theta as tb, x.p0 as a0, x.p1 as a1, x.w as wa, y.p0 as b0, y.p1 as b1, y.w as wb from q x join q y on x.k = y.k and x.side = 0 and y.side = 1),
s as (select *, case when up = 0 then th / tb when up = 63 then (th - ta) / (pi() - ta) else (th - ta) / (tb - ta) end as s from j),
n as (
  select k, case when up = 0 then (b0 + 2) & 3 else a0 end as pixel, case when up = 0 then (1 - s) * 0.25 else (1 - s) * (1 - wa) end + case when up = 63 then s * 0.25 else 0 end as w from s
  union all select k, case when up = 0 then (b1 + 2) & 3 else a1 end, case when up = 0 then (1 - s) * 0.25 else (1 - s) * wa end + case when up = 63 then s * 0.25 else 0 end from s
  union all select k, case when up = 63 then ((a0 + 2) & 3) + 3068 else b0 end, case when up = 63 then s * 0.25 else s * (1 - wb) end + case when up = 0 then (1 - s) * 0.25 else 0 end from s
  union all select k, case when up = 63 then ((a1 + 2) & 3) + 3068 else b1 end, case when up = 63 then s * 0.25 else s * wb end + case when up = 0 then (1 - s) * 0.25 else 0 end from s)
select k as i, {r('sum(w * (pixel % 31))', 'signal')} from n group by k""", base=False)
def _(spark, d):
    k = F.col("c_custkey")
    c = S.read(spark, d, "customer").select(F.lit(0).alias("det"), k.alias("i"), F.lit(0.0).alias("signal"), (F.pi() * (k % 997 + 0.5) / 997).alias("th"), (2 * F.pi() * ((k * 7) % 1009) / 1009).alias("ph"))
    sky = spark.range(3072).select(F.col("id").alias("pixel"), (F.col("id") % 31).cast("double").alias("m0"))
    near = healpix.interpolation(c, F.col("th"), F.col("ph"), 16)
    return pointing.interpolate_map(near, sky).withColumns(rounded("signal")).select("i", "signal")


@query("stokes_weights_demod", "select det, i, n as name, (n = 'demod0_' || det)::int::double as wi, (n = 'demod4r_' || det)::int::double as wq, (n = 'demod4i_' || det)::int::double as wu from (select det, i, p || det as n from s0, (select unnest(['demod0_', 'demod4r_', 'demod4i_']) as p))")
def _(spark, d):
    s = S.event_stream(spark, d).select("det", "i", F.explode(F.array(*[F.concat(F.lit(p), F.col("det")) for p in ("demod0_", "demod4r_", "demod4i_")])).alias("name"))
    return pointing.stokes_weights_demod(s, "name")


@query("pixel_distribution", "select distinct pixel // 8 as submap from s0 where pixel >= 0")
def _(spark, d):
    return pointing.pixel_distribution(S.event_stream(spark, d), 8)


@query("fixed_pointing", "select c_custkey as i, k as det, k / 10.0::double as qx, 0.0::double as qy, k / 20.0::double as qz, 1.0::double as qw from customer, (select range as k from range(4))", base=False)
def _(spark, d):
    s = S.read(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.lit("tel").alias("telescope"))
    k = F.col("id")
    dets = spark.range(4).select(F.lit("tel").alias("telescope"), k.alias("det"), (k / 10.0).alias("fx"), F.lit(0.0).alias("fy"), (k / 20.0).alias("fz"), F.lit(1.0).alias("fw"))
    return pointing.fixed_pointing(s, dets).select("i", "det", "qx", "qy", "qz", "qw")


_DIRECTION = "cos(radians(det % 40 - 20)) * cos(radians(az)) as x, cos(radians(det % 40 - 20)) * sin(radians(az)) as y, sin(radians(det % 40 - 20)) as z"


@query("point_sources", f""",
b as (select *, {_DIRECTION} from s0),
p as (select range as n, cos(radians(range * 30)) as sx, sin(radians(range * 30)) as sy, 0.0::double as sz, 1.0::double + range as flux, 0.1::double as pf, radians(range * 10) as pa from range(12)),
m as (select det, i, flux * exp(-pow(acos(least(x * sx + y * sy + z * sz, 1)), 2) / (2 * pow(0.1 / sqrt(8 * ln(2)), 2))) * (wi + pf * (wq * cos(2 * pa) + wu * sin(2 * pa))) as v from b, p where acos(least(x * sx + y * sy + z * sz, 1)) < 0.3)
select det, i, {r('signal + coalesce(v, 0)', 'signal')} from s0 left join (select det, i, sum(v) as v from m group by det, i) using (det, i)""")
def _(spark, d):
    lat, lon = F.radians(F.col("det") % 40 - 20), F.radians("az")
    s = S.event_stream(spark, d).withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})
    n = F.col("id")
    sources = spark.range(12).select(F.cos(F.radians(n * 30)).alias("sx"), F.sin(F.radians(n * 30)).alias("sy"), F.lit(0.0).alias("sz"), (1.0 + n).alias("flux"), F.lit(0.1).alias("pol_frac"), F.radians(n * 10).alias("pol_angle"))
    return simulate.catalog_signal(s, sources, 0.1).withColumns(rounded("signal")).select("det", "i", "signal")


@query("common_mode_noise", "select det, 'common_' || grp as key, 1.5::double as w, 2.0::double as net, 0.1::double as fknee from d")
def _(spark, d):
    none = spark.createDataFrame([], "key string, net double, fknee double, fmin double, alpha double")
    keys, mixing = simulate.common_mode_noise(none, S.detectors(S.event_stream(spark, d)), "grp", 2.0, 0.1, 1e-5, 1.0, center=1.5)
    return mixing.join(keys, "key").select("det", "key", "w", "net", "fknee")


@query("weather_median", "select c_custkey as obs, c_nationkey % 3 as month, round(10 + c_nationkey % 3 + 0.5 + 3e-6, 4) as drawn from customer", base=False)
def _(spark, d):
    sites = S.read(spark, d, "customer").select(F.col("c_custkey").alias("obs"), F.lit(1).alias("site"), (F.col("c_nationkey") % 3).alias("month"), F.lit(0).alias("hour"), F.lit("pwv").alias("variable"))
    m = F.col("id")
    table = spark.range(3).select(F.lit(1).alias("site"), m.cast("int").alias("month"), F.lit(0).alias("hour"), F.lit("pwv").alias("variable"), F.array(F.lit(0.0), F.lit(0.25), F.lit(0.75), F.lit(1.0)).alias("prob"), F.array(9.0 + m, 10.0 + m, 11.0 + m, 20.0 + m).alias("value"))
    return simulate.weather(sites, table, median=True).withColumns(rounded("drawn")).select("obs", "month", "drawn")


@query("solver_rhs", f""",
g as (select * from s where {GOOD}), m as (select pixel, sum(weight * signal) / sum(weight) as m from g group by pixel)
select det, i // 20 as amp, {r('sum(weight * (signal - m))', 'value')} from g join m using (pixel) group by all""")
def _(spark, d):
    s = catalog.stream(spark, d).withColumn("good", F.expr(GOOD))
    return destriper.right_side(s, Offset(20)).withColumns(rounded("value"))
