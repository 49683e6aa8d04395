"""Named queries over the star-schema tables, with their SQL counterparts.

Floating results are rounded to four places, a little off the ties, so that the
order in which an engine adds does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions import quaternion as Q
from ..functions.flags import good
from ..functions.physics import dipole, stokes_weights
from ..functions.wcs import wcs_pixel
from ..operators import containers, filters, flagging, intervals, mapping
from ..operators.destriper import left_side
from ..operators.templates import Offset, Periodic, SubHarmonic
from ..sources import streams as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracle: the stream, its detectors, a map, and runs of one kind.
BASE = """
with s0 as (
  select user_id as det, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as i, epoch_us(ts) / 1e6 as t,
         value as signal, case event_type when 'error' then 1 when 'signup' then 2 else 0 end as flags, event_id % 64 as pixel,
         1.0::double as wi, cos(2 * ((event_id % 360) * pi() / 180)) as wq, sin(2 * ((event_id % 360) * pi() / 180)) as wu,
         (event_id % 360)::double as az, event_type as kind
  from events),
d as (
  select det, 1.0::double + det % 3 as weight, case when det % 7 <> 0 then 1.0::double + (det % 5) / 10.0::double end as cal, det % 5 as grp,
         'p' || (det // 2)::varchar as pix
  from (select distinct det from s0)),
s as (select s0.*, d.weight, d.cal, d.grp, d.pix from s0 join d using (det)),
sky as (
  select range as pixel, 100.0::double + range as m0, (range % 7) / 10.0::double as m1, (range % 5) / 20.0::double as m2, (range % 4)::int as mask
  from range(60)),
co as (
  select det, floor(t / 21600.0)::bigint as sample, avg(signal) as signal, bit_or(flags) as flags from s0 group by all)
"""


def rounded(*names: str) -> dict[str, F.Column]:
    return {n: F.round(F.col(n) + 3e-6, 4) for n in names}


def r(expr: str, name: str) -> str:
    return f"round({expr} + 3e-6, 4) as {name}"


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return keep


def stream(spark: SparkSession, d: str) -> DataFrame:
    # Detectors come from the table itself, so the windowed stream is made once.
    dets = S.detectors(S.read(spark, d, "events").select(F.col("user_id").alias("det")))
    return S.event_stream(spark, d).join(dets, "det")


GOOD = "(flags & 7) = 0"
RUNS = """,
runs as (
  select det, min(i) as first, max(i) + 1 as last
  from (select det, i, i - row_number() over (partition by det order by i) as g from s where kind in ('view', 'click')) group by det, g),
other as (
  select det, min(i) as first, max(i) + 1 as last
  from (select det, i, i - row_number() over (partition by det order by i) as g from s where i % 10 between 2 and 6) group by det, g)
"""


def _runs(s: DataFrame) -> DataFrame:
    return intervals.from_runs(s, F.col("kind").isin("view", "click")).select("det", "first", "last")


def _other(s: DataFrame) -> DataFrame:
    return intervals.from_runs(s, (F.col("i") % 10).between(2, 6)).select("det", "first", "last")


# ---- containers -------------------------------------------------------------------------------------------------


@query("copy", "select det, i, signal, signal as saved, flags as saved_flags from s")
def _(spark, d):
    return containers.copy(stream(spark, d), {"signal": "saved", "flags": "saved_flags"}).select("det", "i", "signal", "saved", "saved_flags")


@query("delete", "select det, i, t, signal, flags, pixel from s")
def _(spark, d):
    return containers.delete(stream(spark, d), ["wi", "wq", "wu", "az", "kind", "weight", "cal", "grp", "pix"])


@query("reset", "select det, i, 0.0::double as signal, 0 as flags, '' as kind from s")
def _(spark, d):
    return containers.reset(stream(spark, d), ["signal", "flags", "kind"]).select("det", "i", "signal", "flags", "kind")


for _op, _sign in {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}.items():

    @query(f"combine_{_op}", f"select a.det, a.i, {r(f'a.signal {_sign} (b.weight * b.signal)', 'result')} from s a join s b using (det, i)")
    def _(spark, d, op=_op):
        s = stream(spark, d)
        scaled = s.select("det", "i", (F.col("weight") * F.col("signal")).alias("signal"))
        out = containers.combine_streams(s.select("det", "i", "signal"), scaled, op)
        return out.withColumns(rounded("result")).select("det", "i", "result")


@query("calibrate_detectors", f"select det, i, {r('signal * coalesce(cal, 1.0)', 'signal')}, case when cal is null then flags | 4 else flags end as flags from s")
def _(spark, d):
    s = S.event_stream(spark, d)
    out = containers.calibrate(s, S.detectors(s).where("cal is not null"), bit=4)
    return out.withColumns(rounded("signal")).select("det", "i", "signal", "flags")


@query("memory_counter", "select count(*) as n_rows, sum(8 + 8 + 8 + octet_length(encode(kind)))::bigint as n_bytes from s")
def _(spark, d):
    return containers.memory_counter(stream(spark, d).select("det", "i", "signal", "kind"))


@query("decimate_focalplane", "select det, (case when (dense_rank() over (order by pix) - 1) % 10 = 0 then 0 else 1 end)::int as det_flag from d")
def _(spark, d):
    return containers.decimate_focalplane(S.detectors(S.event_stream(spark, d))).select("det", "det_flag")


@query("yield_cut", "select det, (case when ('0x' || substr(md5(pix || '/0'), 1, 8))::bigint / 4294967296.0::double < 0.9 then 0 else 1 end)::int as det_flag from d")
def _(spark, d):
    return containers.yield_cut(S.detectors(S.event_stream(spark, d))).select("det", "det_flag")


@query("data_select", "select det, i, kind from s where regexp_matches(kind, '^(?:(view|sign))') and regexp_matches(det::varchar, '^(?:1)')")
def _(spark, d):
    return containers.select_data(stream(spark, d), kind="(view|sign)", det="1").select("det", "i", "kind")


@query("data_split", "select grp, count(*) as n_samples, count(distinct det) as n_dets from s group by grp")
def _(spark, d):
    return containers.split_data(stream(spark, d), "grp")


# ---- maps --------------------------------------------------------------------------------------------------------


@query("hit_map", f"select pixel, count(*) as hits from s where {GOOD} group by pixel")
def _(spark, d):
    return mapping.hit_map(S.event_stream(spark, d))


_COV = "sum(wi*wi*weight) as c00, sum(wi*wq*weight) as c01, sum(wi*wu*weight) as c02, sum(wq*wq*weight) as c11, sum(wq*wu*weight) as c12, sum(wu*wu*weight) as c22"
_Z = "sum(wi*signal*weight) as z0, sum(wq*signal*weight) as z1, sum(wu*signal*weight) as z2"
_CN = ("c00", "c01", "c02", "c11", "c12", "c22")


@query("inverse_covariance", f"select pixel, {', '.join(r(c, c) for c in _CN)} from (select pixel, {_COV} from s where {GOOD} group by pixel)")
def _(spark, d):
    return mapping.inverse_covariance(stream(spark, d)).withColumns(rounded(*_CN))


@query("noise_weighted_map", f"select pixel, {', '.join(r(c, c) for c in ('z0', 'z1', 'z2'))} from (select pixel, {_Z} from s where {GOOD} group by pixel)")
def _(spark, d):
    return mapping.noise_weighted(stream(spark, d)).withColumns(rounded("z0", "z1", "z2"))


_SOLVED = """,
a as (select pixel, count(*) as hits, {cov}, {z} from s where {good} group by pixel),
k as (select *, c11*c22-c12*c12 as i00, c02*c12-c01*c22 as i01, c01*c12-c02*c11 as i02, c00*c22-c02*c02 as i11, c01*c02-c00*c12 as i12, c00*c11-c01*c01 as i22 from a),
m as (select *, c00*i00+c01*i01+c02*i02 as det3 from k)
""".format(cov=_COV, z=_Z, good=GOOD)


@query("binned_map", _SOLVED + f"select pixel, hits, {r('(i00*z0+i01*z1+i02*z2)/det3', 'm0')}, {r('(i01*z0+i11*z1+i12*z2)/det3', 'm1')}, {r('(i02*z0+i12*z1+i22*z2)/det3', 'm2')} from m")
def _(spark, d):
    return mapping.binned_map(stream(spark, d)).withColumns(rounded("m0", "m1", "m2")).drop("rcond")


@query("covariance_and_hits", _SOLVED + f"select pixel, hits, {', '.join(r(f'i{c[1:]}/det3', c) for c in _CN)} from m")
def _(spark, d):
    return mapping.covariance(mapping.accumulate(stream(spark, d))).select("pixel", "hits", *_CN).withColumns(rounded(*_CN))


@query("noise_weight", f"select det, i, {r('signal * weight', 'signal')} from s")
def _(spark, d):
    return mapping.noise_weight(stream(spark, d)).withColumns(rounded("signal")).select("det", "i", "signal")


_SEEN = "coalesce(wi*m0 + wq*m1 + wu*m2, 0.0)"


@query("scan_map", f"select det, i, {r(f'signal - {_SEEN}', 'signal')} from s left join sky using (pixel)")
def _(spark, d):
    return mapping.scan_map(stream(spark, d), S.sky(spark, d), sign=-1.0).withColumns(rounded("signal")).select("det", "i", "signal")


@query("scan_mask", "select det, i, case when coalesce(mask & 2, 0) <> 0 then flags | 2 else flags end as flags from s left join sky using (pixel)")
def _(spark, d):
    return mapping.scan_mask(stream(spark, d), S.sky(spark, d), bits=2, value=2).select("det", "i", "flags")


@query("scan_scale", f"select det, i, {r('signal * coalesce(m0, 0.0)', 'signal')} from s left join sky using (pixel)")
def _(spark, d):
    return mapping.scan_scale(stream(spark, d), S.sky(spark, d)).withColumns(rounded("signal")).select("det", "i", "signal")


@query("scan_detector_map", f"select det, i, {r('signal + coalesce(wi*(m0+grp) + wq*m1 + wu*m2, 0.0)', 'signal')} from s left join sky using (pixel)")
def _(spark, d):
    s = stream(spark, d)
    maps = S.sky(spark, d).crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "grp"))).withColumn("m0", F.col("m0") + F.col("grp"))
    return mapping.scan_detector_map(s, maps, "grp").withColumns(rounded("signal")).select("det", "i", "signal")


@query("interpolate_map", f"""select det, i, {r('signal + coalesce(v, 0.0)', 'signal')} from s left join (
  select det, i, sum(w * m0) / sum(w) as v from (select det, i, pixel as p, 0.75::double as w from s union all select det, i, (pixel + 1) % 64, 0.25::double from s) x
  join sky on sky.pixel = p group by det, i) using (det, i)""")
def _(spark, d):
    from ..operators.pointing import interpolate_map

    near = F.array(F.struct(F.col("pixel").alias("pixel"), F.lit(0.75).alias("w")), F.struct(((F.col("pixel") + 1) % 64).alias("pixel"), F.lit(0.25).alias("w")))
    s = stream(spark, d).withColumn("near", near)
    return interpolate_map(s, S.sky(spark, d)).withColumns(rounded("signal")).select("det", "i", "signal")


@query("cadence_map", f"select distinct floor(t / 86400.0 + 40587)::bigint as day, pixel from s where {GOOD}")
def _(spark, d):
    return mapping.cadence_map(S.event_stream(spark, d))


@query("statistics", f"""select det, n as ngood, {r('m', 'mean')}, {r('m2', 'var')}, {r('m3 / m2 ** 1.5', 'skew')}, {r('m4 / (m2 * m2)', 'kurt')} from (
  select det, n, any_value(m) as m, avg((signal - m) ** 2) as m2, avg((signal - m) ** 3) as m3, avg((signal - m) ** 4) as m4
  from (select *, avg(signal) over (partition by det) as m, count(*) over (partition by det) as n from s where {GOOD}) group by det, n)""")
def _(spark, d):
    return mapping.statistics(S.event_stream(spark, d)).withColumns(rounded("mean", "var", "skew", "kurt"))


@query("coadd_maps", f""",
h as (select pixel, grp % 2 as half, count(*) as hits, {_COV}, {_Z} from s where {GOOD} group by all),
a as (select pixel, sum(hits)::bigint as hits, {', '.join(f'sum({c}) as {c}' for c in (*_CN, 'z0', 'z1', 'z2'))} from h group by pixel),
k as (select *, c11*c22-c12*c12 as i00, c02*c12-c01*c22 as i01, c01*c12-c02*c11 as i02, c00*c22-c02*c02 as i11, c01*c02-c00*c12 as i12, c00*c11-c01*c01 as i22 from a),
m as (select *, c00*i00+c01*i01+c02*i02 as det3 from k)
select pixel, hits, {r('(i00*z0+i01*z1+i02*z2)/det3', 'm0')}, {r('(i01*z0+i11*z1+i12*z2)/det3', 'm1')}, {r('(i02*z0+i12*z1+i22*z2)/det3', 'm2')} from m""")
def _(spark, d):
    s = stream(spark, d)
    parts = []
    for half in (0, 1):
        own = s.where(F.col("grp") % 2 == half)
        parts.append(mapping.accumulate(own).select("pixel", "hits", *_CN).join(mapping.binned_map(own).select("pixel", "m0", "m1", "m2"), "pixel"))
    return mapping.coadd(parts).withColumns(rounded("m0", "m1", "m2")).drop("rcond")


@query("map_stats", _SOLVED + f"""select component, {r('sum(v)', 'total')}, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'rms')} from (
  select 'm0' as component, (i00*z0+i01*z1+i02*z2)/det3 as v from m union all select 'm1', (i01*z0+i11*z1+i12*z2)/det3 from m
  union all select 'm2', (i02*z0+i12*z1+i22*z2)/det3 from m) group by component""")
def _(spark, d):
    return mapping.map_stats(mapping.binned_map(stream(spark, d))).withColumns(rounded("total", "mean", "rms"))


@query("compare_maps", f"""select pixel, {r('x.v', 'first')}, {r('y.m0', 'second')}, {r('x.v - y.m0', 'diff')} from
  (select pixel, sum(weight*signal)/sum(weight) as v from s where {GOOD} group by pixel) x full join sky y using (pixel)""")
def _(spark, d):
    z = mapping.accumulate(stream(spark, d), weights=("wi",)).select("pixel", (F.col("z0") / F.col("c00")).alias("m0"))
    return mapping.compare_maps(z, S.sky(spark, d)).withColumns(rounded("first", "second", "diff"))


# ---- flags and intervals -----------------------------------------------------------------------------------------


@query("flag_nans", f"select det, i, {r('case when i % 9 = 4 then 0.0 else signal end', 'signal')}, case when i % 9 = 4 then flags | 1 else flags end as flags from s")
def _(spark, d):
    s = stream(spark, d).withColumn("signal", F.when(F.col("i") % 9 == 4, float("nan")).otherwise(F.col("signal")))
    return flagging.flag_nans(s).withColumns(rounded("signal")).select("det", "i", "signal", "flags")


@query("flag_intervals", RUNS + "select det, i, case when exists (select 1 from runs where runs.det = s.det and i >= first and i < last) then flags | 4 else flags end as flags from s")
def _(spark, d):
    s = S.event_stream(spark, d)
    return flagging.flag_intervals(s, _runs(s), bit=4).select("det", "i", "flags")


@query("extend_flags", "select det, i, case when max(flags & 1) over (partition by det order by i rows between 2 preceding and 2 following) <> 0 then flags | 1 else flags end as flags from s")
def _(spark, d):
    return flagging.extend_flags(S.event_stream(spark, d), 2).select("det", "i", "flags")


@query("flag_sso", """, b(name, t0, x0, y0, z0) as (select 'sun', (select min(t) - 10 from s), 1.0, 0.0, 0.0 union all select 'sun', (select min(t) + 1e6 from s), 0.0, 1.0, 0.0),
p as (select a.t0, b.t0 as t1 from b a join b on a.t0 < b.t0),
v as (select det, i, flags, cos(az * pi() / 180) as x, sin(az * pi() / 180) as y, (t - t0) / (t1 - t0) as f from s left join p on t >= t0 and t < t1)
select det, i, case when f is not null and (x * (1 - f) + y * f) / sqrt((1 - f) * (1 - f) + f * f) > cos(0.3) then flags | 4 else flags end as flags from v""")
def _(spark, d):
    s = S.event_stream(spark, d)
    a = F.radians("az")
    s = s.withColumns({"x": F.cos(a), "y": F.sin(a), "z": F.lit(0.0)})
    t0 = s.agg(F.min("t").alias("t"))
    bodies = t0.select(F.inline(F.array(
        F.struct(F.lit("sun").alias("name"), (F.col("t") - 10).alias("t"), F.lit(1.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(0.0).alias("bz")),
        F.struct(F.lit("sun").alias("name"), (F.col("t") + 1e6).alias("t"), F.lit(0.0).alias("bx"), F.lit(1.0).alias("by"), F.lit(0.0).alias("bz")),
    )))
    return flagging.near_direction(s, bodies, 0.3, step=86400.0).select("det", "i", "flags")


@query("all_flagged", f"select det from s group by det having count(*) filter (where {GOOD} and pixel < 20) = 0")
def _(spark, d):
    s = S.event_stream(spark, d)
    return flagging.all_flagged(s.withColumn("flags", F.when(F.col("pixel") < 20, F.col("flags")).otherwise(1)))


@query("view_samples", RUNS + "select s.det, i, first, last from s join runs on runs.det = s.det and i >= first and i < last")
def _(spark, d):
    s = S.event_stream(spark, d)
    return flagging.in_intervals(s.select("det", "i"), _runs(s), block=16).select("det", "i", "first", "last")


@query("interval_runs", RUNS + "select * from runs")
def _(spark, d):
    return _runs(S.event_stream(spark, d))


_COVER = RUNS + """, cover as (
  select det, i, exists (select 1 from runs where runs.det = s.det and i >= first and i < last) as a, exists (select 1 from other where other.det = s.det and i >= first and i < last) as b from s)
"""
_AS_RUNS = "select det, min(i) as first, max(i) + 1 as last from (select det, i, i - row_number() over (partition by det order by i) as g from cover where {}) group by det, g"


@query("interval_union", _COVER + _AS_RUNS.format("a or b"))
def _(spark, d):
    s = S.event_stream(spark, d)
    return intervals.union(_runs(s), _other(s))


@query("interval_intersect", _COVER + _AS_RUNS.format("a and b"))
def _(spark, d):
    s = S.event_stream(spark, d)
    return intervals.intersect(_runs(s), _other(s))


@query("interval_invert", _COVER + _AS_RUNS.format("not a"))
def _(spark, d):
    s = S.event_stream(spark, d)
    return intervals.invert(_runs(s), intervals.spans_of(s))


@query("interval_simplify", _COVER + _AS_RUNS.format("a"))
def _(spark, d):
    s = S.event_stream(spark, d)
    return intervals.simplify(intervals.regular(_runs(s), 2))


@query("interval_regular", "select det, a as first, least(a + 10, n) as last from (select det, n, unnest(range(0, n, 10)) as a from (select det, count(*) as n from s group by det))")
def _(spark, d):
    return intervals.regular(intervals.spans_of(S.event_stream(spark, d)), 10)


@query("gap_fill_schedule", RUNS + "select det, first, last from runs union all select det, first, last from other o where not exists (select 1 from runs r where r.det = o.det and r.first < o.last and r.last > o.first)")
def _(spark, d):
    s = S.event_stream(spark, d)
    return intervals.gap_fill(_runs(s), _other(s))


@query("azimuth_ranges", f"""select det, min(u) as az_min, max(u) as az_max from (
  select det, flags, az + 360 * sum(case when st > 180 then -1 when st < -180 then 1 else 0 end) over (partition by det order by i) as u
  from (select *, az - lag(az) over (partition by det order by i) as st from s)) where {GOOD} group by det""")
def _(spark, d):
    return intervals.azimuth_ranges(S.event_stream(spark, d))


@query("stat_cut_pass1", f"""select det, {r('rms', 'rms')} from (select *, median(rms) over () as m, stddev_pop(rms) over () as sd from (
  select det, stddev_pop(signal) as rms from s where {GOOD} group by det)) where abs(rms - m) <= 1.5 * sd""")
def _(spark, d):
    stats = mapping.statistics(S.event_stream(spark, d)).select("det", F.sqrt("var").alias("rms"))
    return flagging.clip_pass(stats, "rms", 1.5).withColumns(rounded("rms"))


# ---- filters -----------------------------------------------------------------------------------------------------


@query("detrend_mean", f"select det, i, {r(f'signal - coalesce(avg(case when {GOOD} then signal end) over (partition by det), 0)', 'signal')} from s")
def _(spark, d):
    return filters.detrend(S.event_stream(spark, d), "mean").withColumns(rounded("signal")).select("det", "i", "signal")


@query("detrend_median", f"select det, i, {r(f'signal - coalesce(median(case when {GOOD} then signal end) over (partition by det), 0)', 'signal')} from s")
def _(spark, d):
    return filters.detrend(S.event_stream(spark, d), "median").withColumns(rounded("signal")).select("det", "i", "signal")


@query("detrend_linear", f""",
g as (select *, min(case when {GOOD} then i end) over (partition by det) as g0, max(case when {GOOD} then i end) over (partition by det) as g1 from s),
e as (select *, avg(case when {GOOD} and i < g0 + 10 then signal end) over (partition by det) as l0, avg(case when {GOOD} and i > g1 - 10 then signal end) over (partition by det) as l1 from g)
select det, i, {r('signal - (l0 + (i - g0 - 4.5) * (l1 - l0) / (g1 - g0 + 1 - 10))', 'signal')}, flags from e""")
def _(spark, d):
    return filters.detrend(S.event_stream(spark, d), "linear", edge=10).withColumns(rounded("signal")).select("det", "i", "signal", "flags")


@query("poly_filter_0", f"select det, i, {r(f'signal - coalesce(avg(case when {GOOD} then signal end) over (partition by det), 0)', 'signal')} from s")
def _(spark, d):
    return filters.poly_filter(S.event_stream(spark, d), 0).withColumns(rounded("signal")).select("det", "i", "signal")


@query("poly_filter_1", f""",
x as (select *, -1.0 + (2 * i + 1) / (count(*) over (partition by det))::double as x from s),
f as (select det, regr_slope(signal, x) as b, regr_intercept(signal, x) as a from x where {GOOD} group by det)
select det, i, {r('signal - a - b * x', 'signal')} from x join f using (det)""")
def _(spark, d):
    return filters.poly_filter(S.event_stream(spark, d), 1).withColumns(rounded("signal")).select("det", "i", "signal")


@query("common_mode", f"select det, sample, {r('signal - coalesce(m, 0)', 'signal')} from co left join (select sample, avg(signal) as m from co where {GOOD} group by sample) using (sample)")
def _(spark, d):
    return filters.common_mode(S.cosampled(S.event_stream(spark, d))).withColumns(rounded("signal")).select("det", "sample", "signal")


@query("common_mode_group", f"""select det, sample, {r('signal - coalesce(m, 0)', 'signal')} from (select co.*, det % 5 as grp from co)
  left join (select sample, det % 5 as grp, avg(signal) as m from co where {GOOD} group by all) using (sample, grp)""")
def _(spark, d):
    co = S.cosampled(S.event_stream(spark, d)).withColumn("grp", F.col("det") % 5)
    return filters.common_mode(co, group="grp").withColumns(rounded("signal")).select("det", "sample", "signal")


@query("common_mode_regress", f""",
m as (select co.*, m from co left join (select sample, avg(signal) as m from co where {GOOD} group by sample) using (sample)),
f as (select det, regr_slope(signal, m) as b, regr_intercept(signal, m) as a from m where {GOOD} group by det)
select det, sample, {r('signal - coalesce(a + b * m, 0)', 'signal')} from m left join f using (det)""")
def _(spark, d):
    return filters.common_mode(S.cosampled(S.event_stream(spark, d)), regress=True).withColumns(rounded("signal")).select("det", "sample", "signal")


@query("ground_bins", f"select det, i, {r(f'signal - coalesce(avg(case when {GOOD} then signal end) over (partition by det, floor(az / 60)), 0)', 'signal')} from s")
def _(spark, d):
    return filters.ground_bins(S.event_stream(spark, d), 60.0).withColumns(rounded("signal")).select("det", "i", "signal")


@query("hwp_harmonics", f"""select det, count(*) as n, {', '.join(r(f'avg(signal * {f}({k} * (az * pi() / 180)))', f'{f[0]}{k}') for k in (1, 2) for f in ('cos', 'sin'))} from s where {GOOD} group by det""")
def _(spark, d):
    s = S.event_stream(spark, d).withColumn("hwp", F.radians("az"))
    return filters.hwp_moments(s, "hwp", 2).withColumns(rounded("c1", "s1", "c2", "s2"))


@query("t2p_filter", f""",
q as (select det, i, flags, signal, signal * wq as q, signal * wu as u from s),
f as (select det, regr_slope(q, signal) as bq, regr_intercept(q, signal) as aq, regr_slope(u, signal) as bu, regr_intercept(u, signal) as au from q where {GOOD} group by det)
select det, i, {r('q - coalesce(aq + bq * signal, 0)', 'q')}, {r('u - coalesce(au + bu * signal, 0)', 'u')} from q left join f using (det)""")
def _(spark, d):
    s = S.event_stream(spark, d).withColumns({"q": F.col("signal") * F.col("wq"), "u": F.col("signal") * F.col("wu")})
    return filters.t2p_filter(s, "signal", ["q", "u"]).withColumns(rounded("q", "u")).select("det", "i", "q", "u")


_XT = ", x as (select a.det as det_out, a.det - 1 as det, 0.1::double as coef from d a union all select a.det, a.det + 1, 0.05::double from d a)"


@query("crosstalk", _XT + f"""select det, sample, {r('signal + coalesce(v, 0)', 'signal')} from co left join (
  select det_out as det, sample, sum(coef * signal) as v from co join x using (det) group by all) using (det, sample)""")
def _(spark, d):
    s = S.event_stream(spark, d)
    return filters.crosstalk(S.cosampled(s), _matrix(s)).withColumns(rounded("signal")).select("det", "sample", "signal")


@query("mitigate_crosstalk", _XT + f"""select det, sample, {r('coalesce(v, 0)', 'signal')} from co left join (
  select det_out as det, sample, sum(-coef * signal) as v from co join x using (det) group by all) using (det, sample)""")
def _(spark, d):
    s = S.event_stream(spark, d)
    inverse = _matrix(s).withColumn("coef", -F.col("coef"))  # first order in the coefficients
    return filters.crosstalk(S.cosampled(s), inverse, add=False).withColumns(rounded("signal")).select("det", "sample", "signal")


def _matrix(s: DataFrame) -> DataFrame:
    dets = s.select("det").distinct()
    left = dets.select(F.col("det").alias("det_out"), (F.col("det") - 1).alias("det"), F.lit(0.1).alias("coef"))
    return left.unionByName(dets.select(F.col("det").alias("det_out"), (F.col("det") + 1).alias("det"), F.lit(0.05).alias("coef")))


@query("crosslinking", f""",
a as (select det, i, flags, pixel, pi() / 2 - (0.5 + (pixel % 8) / 10.0::double) as lat, az * pi() / 180 as phi from s),
g as (select *, coalesce((lead(lat) over w - lag(lat) over w) / 2, lead(lat) over w - lat, lat - lag(lat) over w, 0) as dl,
             coalesce((lead(phi) over w - lag(phi) over w) / 2, lead(phi) over w - phi, phi - lag(phi) over w, 0) * cos(lat) as dp from a window w as (partition by det order by i)),
h as (select *, case when abs(dp) < 1e-30 then sign(dl) * pi() / 2 else atan(dl / dp) end as ang from g)
select pixel, count(*)::double as x0, {r('sum(cos(2 * ang))', 'x1')}, {r('sum(sin(2 * ang))', 'x2')} from h where {GOOD} group by pixel""")
def _(spark, d):
    s = S.event_stream(spark, d).withColumns({"theta": 0.5 + (F.col("pixel") % 8) / 10.0, "phi": F.radians("az")})
    return filters.crosslinking(s, "theta", "phi").withColumns(rounded("x1", "x2"))


@query("signal_diff_noise", f"""select det, {r('stddev_pop(x) / sqrt(2.0) / sqrt(10.0)', 'net')} from (
  select det, case when {GOOD} and (coalesce(lead(flags) over w, 7) & 7) = 0 then lead(signal) over w - signal end as x from s window w as (partition by det order by i)) group by det""")
def _(spark, d):
    return filters.signal_diff_noise(S.event_stream(spark, d), 10.0).withColumns(rounded("net"))


@query("elevation_noise", f""",
n as (select det, f.freq, weight * weight * (1 + 0.5 / f.freq) as psd from d, (select unnest([0.5, 1.0, 2.0])::double as freq) f),
e as (select det, median(0.5 + az / 720.0) as el from s group by det)
select det, freq, {r('psd * pow((2.0 / sin(el) + 0.3) * 1.1, 2)', 'psd')} from n join e using (det)""")
def _(spark, d):
    s = stream(spark, d)
    freq = F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("freq")
    noise = S.detectors(s).select("det", "weight", freq).select("det", "freq", (F.col("weight") ** 2 * (1 + 0.5 / F.col("freq"))).alias("psd"))
    return filters.elevation_noise(noise, s.select("det", (0.5 + F.col("az") / 720.0).alias("el")), 2.0, 0.3, 1.1).withColumns(rounded("psd"))


@query("lagged_covariance", f""",
x as (select det, i, case when {GOOD} then signal end as x from s)
select det, lag, count(*) as hits, {r('avg(p)', 'cov')} from (
  select det, 0 as lag, x * x as p from x union all select det, 1, x * lead(x, 1) over (partition by det order by i) from x
  union all select det, 5, x * lead(x, 5) over (partition by det order by i) from x) where p is not null group by all""")
def _(spark, d):
    return filters.lagged_covariance(S.event_stream(spark, d), [0, 1, 5]).withColumns(rounded("cov"))


# ---- templates ---------------------------------------------------------------------------------------------------


@query("offset_project", f"select det, i // 10 as amp, {r('sum(signal)', 'value')} from s where {GOOD} group by all")
def _(spark, d):
    return Offset(10).project(S.event_stream(spark, d)).withColumns(rounded("value"))


@query("offset_add", f"""select det, i, {r('signal - coalesce(a, 0)', 'signal')} from (select *, i // 10 as amp from s)
  left join (select det, i // 10 as amp, avg(signal) as a from s where {GOOD} group by all having count(*) > 5) using (det, amp)""")
def _(spark, d):
    s, t = S.event_stream(spark, d), Offset(10)
    means = s.where(good()).groupBy("det", t.key()).agg(F.avg("signal").alias("value"), F.count(F.lit(1)).alias("n")).where("n > 5")
    return t.add(s, means, sign=-1.0).withColumns(rounded("signal")).select("det", "i", "signal")


@query("periodic_project", f"select det, floor((az - 0.0) / 45.0)::bigint as amp, {r('sum(signal)', 'value')} from s where {GOOD} group by all having count(*) >= 3")
def _(spark, d):
    return Periodic("az", 45.0, 0.0).project(S.event_stream(spark, d)).withColumns(rounded("value"))


@query("subharmonic_project", f""",
x as (select det, flags, signal, -1.0 + (2 * i + 1) / (count(*) over (partition by det))::double as x from s),
p as (select det, signal, unnest([{{'amp': 0, 'p': 1.0::double}}, {{'amp': 1, 'p': x}}, {{'amp': 2, 'p': (3 * x * x - 1) / 2}}]) as u from x where {GOOD})
select det, u.amp as amp, {r('sum(u.p * signal)', 'value')} from p group by all""")
def _(spark, d):
    s = S.event_stream(spark, d)
    s = s.join(intervals.spans_of(s), "det")
    return SubHarmonic(2, keys=("det",)).project(s).withColumns(rounded("value"))


@query("destriper_lhs", f""",
a as (select *, {GOOD} as ok, (i // 10 + det % 3)::double as x from s),
m as (select pixel, sum(weight * x) / sum(weight) as m from a where ok group by pixel)
select det, i // 10 as amp, {r('sum(weight * (x - m))', 'value')} from a join m using (pixel) where ok group by all""")
def _(spark, d):
    s = stream(spark, d).withColumn("good", good())
    t = Offset(10)
    amps = s.select("det", t.key()).distinct().withColumn("value", (F.col("amp") + F.col("det") % 3).cast("double"))
    return left_side(s, amps, t).withColumns(rounded("value"))


# ---- formulas ----------------------------------------------------------------------------------------------------

_QUATS = """, q0 as (select c_custkey as k, (c_custkey % 17) / 17.0::double - 0.4 as x, (c_custkey % 13) / 13.0::double - 0.3 as y, (c_custkey % 11) / 11.0::double - 0.6 as z, 0.7::double as w from customer),
q as (select k, x/n as x, y/n as y, z/n as z, w/n as w from (select *, sqrt(x*x+y*y+z*z+w*w) as n from q0)),
v as (select *, 2*(x*z+y*w) as dx, 2*(y*z-x*w) as dy, 1-2*(x*x+y*y) as dz, 1-2*(y*y+z*z) as ox, 2*(x*y+z*w) as oy, 2*(x*z-y*w) as oz from q)
"""


def _quats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = (k % 17 / 17.0 - 0.4, k % 13 / 13.0 - 0.3, k % 11 / 11.0 - 0.6, F.lit(0.7))
    return S.read(spark, d, "customer").select(k.alias("k"), *[c.alias(n) for c, n in zip(Q.norm(raw), "xyzw", strict=True)])


def _q() -> tuple:
    return tuple(F.col(c) for c in "xyzw")


@query("quat_mult", _QUATS + f"""select k, {r('0.5*w+0.5*x+0.5*y-0.5*z', 'px')}, {r('0.5*w-0.5*x+0.5*y+0.5*z', 'py')}, {r('0.5*w+0.5*x-0.5*y+0.5*z', 'pz')}, {r('0.5*w-0.5*x-0.5*y-0.5*z', 'pw')} from q""")
def _(spark, d):
    p = Q.mult(_q(), Q.of((0.5, 0.5, 0.5, 0.5)))
    return _quats(spark, d).select("k", *[c.alias(n) for c, n in zip(p, ("px", "py", "pz", "pw"), strict=True)]).withColumns(rounded("px", "py", "pz", "pw"))


@query("quat_rotate", _QUATS + f"select k, {r('dx', 'dx')}, {r('dy', 'dy')}, {r('dz', 'dz')} from v")
def _(spark, d):
    v = Q.rotate(_q(), Q.of((0, 0, 1)))
    return _quats(spark, d).select("k", *[c.alias(n) for c, n in zip(v, ("dx", "dy", "dz"), strict=True)]).withColumns(rounded("dx", "dy", "dz"))


@query("stokes_weights", _QUATS + f""",
m as (select *, atan2(dy, dx) as phi from v),
n as (select *, dz*cos(phi) as mx, dz*sin(phi) as my, -sqrt(1-dz*dz) as mz from m),
a as (select k, atan2((my*oz-mz*oy)*dx + (mz*ox-mx*oz)*dy + (mx*oy-my*ox)*dz, mx*ox+my*oy+mz*oz) as al from n)
select k, 2.0::double as wi, {r('2.0 * (0.9/1.1) * cos(2*al)', 'wq')}, {r('2.0 * (0.9/1.1) * sin(2*al)', 'wu')} from a""")
def _(spark, d):
    w = stokes_weights(_q(), eps=0.1, cal=2.0)
    return _quats(spark, d).select("k", *[c.alias(n) for c, n in zip(w, ("wi", "wq", "wu"), strict=True)]).withColumns(rounded("wq", "wu"))


_HPX = _QUATS + """, h as (select k, dz as z, atan2(dy, dx) * 2 / pi() as tt0 from v), g as (select k, z, tt0 - 4 * floor(tt0 / 4) as tt from h),
j as (select *, abs(z) <= 2.0/3.0 as eq, least(floor(tt)::bigint, 3) as quad from g),
l as (select *, case when eq then floor(64*(0.5+tt) - 48*z)::bigint else least(floor((tt-quad)*64*sqrt(3*(1-abs(z))))::bigint, 63) end as jp,
             case when eq then floor(64*(0.5+tt) + 48*z)::bigint else least(floor((1-(tt-quad))*64*sqrt(3*(1-abs(z))))::bigint, 63) end as jm from j)
"""


@query("healpix_ring", _HPX + """, m as (select *, case when eq then 65 + jp - jm else jp + jm + 1 end as r from l),
n as (select *, case when eq then (((jp + jm - 64 + (1 - (r & 1)) + 1) >> 1) % 256 + 256) % 256 else floor(tt * r)::bigint % (4 * r) end as ip from m)
select k, (case when eq then 128 * 63 + (r - 1) * 256 + ip when z > 0 then 2 * r * (r - 1) + ip else 49152 - 2 * r * (r + 1) + ip end)::bigint as pixel from n""")
def _(spark, d):
    q = _quats(spark, d)
    v = Q.rotate(_q(), Q.of((0, 0, 1)))
    q = q.select("k", *[c.alias(n) for c, n in zip(v, ("vx", "vy", "vz"), strict=True)])
    return healpix.vec_pixel(q, F.col("vx"), F.col("vy"), F.col("vz"), 64, nest=False).select("k", "pixel")


@query("healpix_nest", _HPX + f""", f as (select *, jp >> 6 as fp, jm >> 6 as fm from l),
p as (select k, case when eq then (case when fp = fm then (fp & 3) + 4 when fp < fm then fp else fm + 8 end) when z > 0 then quad else quad + 8 end as face,
             case when eq then jm & 63 when z > 0 then 63 - jm else jp end as x, case when eq then 63 - (jp & 63) when z > 0 then 63 - jp else jm end as y from f)
select k, (face * 4096 + {' + '.join(f'(((x >> {b}) & 1) << {2 * b}) + (((y >> {b}) & 1) << {2 * b + 1})' for b in range(6))})::bigint as pixel from p""")
def _(spark, d):
    q = _quats(spark, d)
    v = Q.rotate(_q(), Q.of((0, 0, 1)))
    q = q.select("k", *[c.alias(n) for c, n in zip(v, ("vx", "vy", "vz"), strict=True)])
    return healpix.vec_pixel(q, F.col("vx"), F.col("vy"), F.col("vz"), 64, nest=True).select("k", "pixel")


@query("wcs_pixels", _QUATS + """, a as (select k, degrees(atan2(dy, dx)) as lon, degrees(asin(dz)) as lat from v), b as (select k, lon - 10.0 - 360.0 * floor((lon - 10.0 + 180.0) / 360.0) as x, lat - 5.0 as y from a),
c as (select k, floor(-x / 0.5 + 100.0) as col, floor(y / 0.5 + 50.0) as row from b)
select k, (case when col >= 0 and col < 200 and row >= 0 and row < 100 then col + row * 200 else -1 end)::bigint as pixel from c""")
def _(spark, d):
    v = Q.rotate(_q(), Q.of((0, 0, 1)))
    q = _quats(spark, d).select("k", F.degrees(F.atan2(v[1], v[0])).alias("lon"), F.degrees(F.asin(v[2])).alias("lat"))
    return q.select("k", wcs_pixel("CAR", F.col("lon"), F.col("lat"), (10.0, 5.0), (200, 100), 0.5).alias("pixel"))


@query("dipole", _QUATS + f"""select k, {r('1e6 * 2.72548 * (sqrt(1 - b*b) / (1 - b*dz) - 1)', 'shift')} from (select *, 370.0 / 299792.458 as b from v)""")
def _(spark, d):
    q = _quats(spark, d)
    v = Q.rotate(_q(), Q.of((0, 0, 1)))
    return q.select("k", (1e6 * dipole(v, Q.of((0, 0, 370.0)))).alias("shift")).withColumns(rounded("shift"))


_E = ", ".join(f"{v!r}::double as e{k}" for k, v in enumerate(Q.EQU2GAL))


@query("coordinate_rotation", _QUATS + f""", e as (select *, {_E}, atan2(dy, dx) as phi from v),
m as (select *, dz * cos(phi) as mx, dz * sin(phi) as my, -sqrt(greatest(0, 1 - dz * dz)) as mz from e)
select k, {r('e3 * x + e0 * w + e1 * z - e2 * y', 'x')}, {r('e3 * y + e1 * w + e2 * x - e0 * z', 'y')}, {r('e3 * z + e2 * w + e0 * y - e1 * x', 'z')}, {r('e3 * w - e0 * x - e1 * y - e2 * z', 'w')},
  {r('phi', 'lon')}, {r('asin(dz)', 'lat')}, {r('atan2((my * oz - mz * oy) * dx + (mz * ox - mx * oz) * dy + (mx * oy - my * ox) * dz, mx * ox + my * oy + mz * oz)', 'psi')} from m""")
def _(spark, d):
    lon, lat, psi = Q.to_lonlat_angles(_q())
    turned = [c.alias(n) for c, n in zip(Q.mult(Q.of(Q.EQU2GAL), _q()), "xyzw", strict=True)]
    return _quats(spark, d).select("k", *turned, lon.alias("lon"), lat.alias("lat"), psi.alias("psi")).withColumns(rounded("x", "y", "z", "w", "lon", "lat", "psi"))


# ---- observation index -------------------------------------------------------------------------------------------

_OBS = ", obs as (select o_custkey as cust, count(*) as samples, median(o_totalprice) as med, avg(o_totalprice) as mean, min_by(o_totalprice, (o_orderdate, o_orderkey)) as first, max_by(o_totalprice, (o_orderdate, o_orderkey)) as last from orders group by o_custkey)"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(
        F.count(F.lit(1)).alias("samples"), F.median("o_totalprice").alias("med"), F.avg("o_totalprice").alias("mean"),
        F.min_by("o_totalprice", at).alias("first"), F.max_by("o_totalprice", at).alias("last"),
    )


@query("volume_index_reduce", _OBS + f"select cust, samples, {r('med', 'med')}, {r('mean', 'mean')}, {r('first', 'first')}, {r('last', 'last')} from obs")
def _(spark, d):
    return _obs(spark, d).withColumns(rounded("med", "mean", "first", "last"))


@query("volume_index_select", _OBS + "select cust, samples from obs where samples >= 12 and cust % 2 = 0")
def _(spark, d):
    from ..sources.volume import select_observations

    return select_observations(_obs(spark, d), "where samples >= 12 and cust % 2 = 0").select("cust", "samples")


@query("lineitem_binned_map", """select l_partkey as pixel, count(*) as hits, round(sum(l_extendedprice * (1 + l_suppkey % 3)) / sum(1 + l_suppkey % 3) + 3e-6, 4) as m0
  from lineitem where l_returnflag <> 'R' group by l_partkey""", base=False)
def _(spark, d):
    li = S.read(spark, d, "lineitem")
    s = li.select(F.col("l_partkey").alias("pixel"), F.col("l_extendedprice").alias("signal"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flags"), (1.0 + F.col("l_suppkey") % 3).alias("weight"), F.lit(1.0).alias("wi"))
    a = mapping.accumulate(s, weights=("wi",))
    return a.select("pixel", "hits", (F.col("z0") / F.col("c00")).alias("m0")).withColumns(rounded("m0"))


@query("time_windows", """select kind, epoch_us(time_bucket(interval '1 hour', ts)) // 1000000 as start, count(*) as n, round(sum(value) + 3e-6, 4) as total from (select event_type as kind, ts, value from events) group by all""", base=False)
def _(spark, d):
    from ..streaming.windows import tumbling

    e = S.read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return tumbling(e, "1 hour").withColumns(rounded("total"))


from . import sequences as _sequences  # noqa: E402,F401  (registers the queries of sequence operators)
from . import ground as _ground  # noqa: E402,F401  (registers those of ground scans)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
