"""Sequence operators, solvers and sources on small made-up streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import destriper, filters, flagging, intervals, mapping, pointing, regress, sequences, simulate
from tideline.operators.templates import Offset, SubHarmonic
from tideline.plans import catalog, config
from tideline.sources import volume


def frame(spark, d, flags=None, det="a", **more):
    n = len(d)
    return spark.createDataFrame(pd.DataFrame({"det": det, "i": np.arange(n), "t": np.arange(n) / 10.0, "signal": np.asarray(d, float), "flags": np.zeros(n, int) if flags is None else flags, **more}))


def signal(df):
    return np.array([r.signal for r in df.orderBy("det", "i").collect()])


def test_poly_and_ground_and_hwp_filters_remove_what_they_model(spark):
    n = 400
    x = np.linspace(-1, 1, n)
    az, hwp = 20 * np.sin(np.arange(n) / 15), np.arange(n) * 0.4
    flags = np.where(np.arange(n) % 50 == 3, 1, 0)
    spike = np.where(flags, 100.0, 0.0)
    out = signal(regress.poly_filter(frame(spark, 3 + 2 * x - x**3 + spike, flags), 3))
    assert np.abs(out[flags == 0]).max() < 1e-9
    out = signal(filters.poly_filter(frame(spark, 3 + 2 * x + spike, flags), 1))
    assert np.abs(out[flags == 0]).max() < 1e-9
    out = signal(regress.ground_filter(frame(spark, 0.1 * az**2 + x + spike, flags, az=az), 3, 3, detrend=True))
    assert np.abs(out[flags == 0]).max() < 1e-6
    out = signal(regress.hwp_filter(frame(spark, np.cos(2 * hwp) + x + spike, flags, hwp=hwp), "hwp", 2, 3, detrend=True))
    assert np.abs(out[flags == 0]).max() < 1e-8
    whole = 2 * np.pi * 25 * np.arange(n) / n  # whole turns, over which harmonics have no mean
    model = regress.hwpss_model(frame(spark, 5 + 0.3 * np.cos(2 * whole), hwp=whole), "hwp", 3)
    assert np.abs(signal(model)).max() < 1e-8 and abs(model.first().relcal - 0.3) < 1e-8


def test_glitches_jumps_and_gaps(spark):
    rnd = np.random.default_rng(5)
    d = rnd.normal(size=1000)
    d[500] += 60
    got = sequences.deglitch(frame(spark, d), width=51).orderBy("i").toPandas()
    assert got["flags"].iloc[495:506].all() and got["flags"].sum() < 40 and abs(got["signal"].iloc[500]) < 5
    step = np.where(np.arange(1000) < 600, 0.0, 30.0) + d * 0.1
    fixed = sequences.jump_correct(frame(spark, step - d.mean()), length=60).orderBy("i").toPandas()
    assert abs(fixed["signal"].iloc[700:].mean() - fixed["signal"].iloc[:500].mean()) < 1.0
    bad = ((np.arange(200) > 90) & (np.arange(200) < 100)).astype(int)
    line = np.arange(200) * 0.5
    assert np.allclose(signal(sequences.fill_gaps(frame(spark, np.where(bad, -99, line), bad), noise=False)), line)


def test_a_stream_with_too_many_jumps_is_flagged_whole(spark):
    n = 8000
    d = np.random.default_rng(6).normal(size=n) * 0.1
    for steps, whole in ((15, True), (8, False)):
        x = d + 30.0 * np.searchsorted(500 * np.arange(1, steps + 1), np.arange(n), side="right")
        flags = sequences.jump_correct(frame(spark, x), length=60).toPandas()["flags"]
        assert (flags == 1).all() == whole and flags.any()


def test_time_constant_round_trip_and_noise_chain(spark):
    n = 512
    d = np.sin(np.arange(n) / 20.0)
    low = sequences.time_constant(frame(spark, d, tau=0.3), 10.0, "tau")
    assert np.abs(signal(sequences.time_constant(low, 10.0, "tau", deconvolve=True)) - d).max() < 0.05
    assert sequences.time_constant(frame(spark, d, tau=np.nan), 10.0, "tau").where("flags = 1").count() == n
    base = frame(spark, np.zeros(8192), net=2.0, fknee=0.1, fmin=1e-4, alpha=1.5)
    noisy = simulate.noise(base, 10.0)
    assert np.array_equal(signal(noisy), signal(simulate.noise(base.repartition(3), 10.0)))
    fit = sequences.fit_noise(sequences.noise_estimate(noisy, 10.0, lagmax=2048, nbin=40), fmin=1e-4).first()
    assert abs(fit.net / 2.0 - 1) < 0.3 and 0.02 < fit.fknee < 0.5


def test_demodulation_recovers_the_polarised_part(spark):
    n, rate = 4096, 50.0
    hwp = 2 * np.pi * 1.0 * np.arange(n) / rate
    d = 7 + 3 * np.cos(4 * hwp) + 2 * np.sin(4 * hwp)
    out = sequences.demodulate(frame(spark, d, hwp=hwp, wq=np.cos(4 * hwp), wu=np.sin(4 * hwp)), rate, "hwp").toPandas()
    mid = out[(out["i"] > 1000) & (out["i"] < 3000)].groupby("name")["signal"].mean()
    assert abs(mid["demod0"] - 7) < 0.1 and abs(mid["demod4r"] - 3) < 0.1 and abs(mid["demod4i"] - 2) < 0.1


def test_destriper_recovers_steps(spark):
    rnd = np.random.default_rng(2)
    n, dets = 200, 4
    parts = []
    for k in range(dets):
        steps = np.repeat(rnd.normal(size=n // 20) * 5, 20)
        parts.append(pd.DataFrame({"det": k, "i": np.arange(n), "pixel": rnd.integers(0, 12, n), "flags": (np.arange(n) % 37 == 0).astype(int), "step": steps}))
    p = pd.concat(parts)
    p["signal"] = p["pixel"] * 1.0 + p["step"]
    p["weight"], p["wi"], p["wq"], p["wu"] = 1.0, 1.0, np.cos(p["i"] * 1.3), np.sin(p["i"] * 1.3)
    df = spark.createDataFrame(p)
    t = Offset(20)
    amps = destriper.solve_amplitudes(df, t, convergence=1e-16)
    clean = destriper.apply_amplitudes(df, amps, t).toPandas()
    left = clean["signal"] - clean["pixel"]
    assert left.std() < 1e-5  # all but a common offset
    m, _ = destriper.map_maker(df, t, convergence=1e-16)
    rows = m.orderBy("pixel").collect()
    assert np.std([r.m0 - r.pixel for r in rows]) < 1e-4


def test_long_intervals_and_subharmonics(spark):
    df = frame(spark, np.arange(5000.0)).withColumn("i", F.col("i").cast("long"))
    ivl = spark.createDataFrame([("a", 10, 4990), ("a", 4995, 4996)], "det string, first long, last long")
    assert flagging.in_intervals(df, ivl, block=64).count() == 4981
    gaps = intervals.invert(ivl, intervals.spans_of(df)).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in gaps] == [(0, 10), (4990, 4995), (4996, 5000)]
    none = intervals.invert(ivl.limit(0), intervals.spans_of(df)).collect()
    assert [(r["first"], r["last"]) for r in none] == [(0, 5000)]
    t = SubHarmonic(1, keys=("det",))
    spans = df.join(intervals.spans_of(df), "det")
    amps = t.project(spans.withColumn("signal", F.lit(1.0)))
    assert abs(amps.where("amp = 0").first().value - 5000) < 1e-6
    assert np.allclose(signal(t.add(spans, amps, sign=0.0)), np.arange(5000.0))


def test_scans_and_pointing(spark):
    scans = simulate.satellite_schedule(spark, 2, 1.0)
    s = simulate.satellite(scans, 10.0, hwp_rpm=6.0)
    q = s.select((F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2 + F.col("bw") ** 2).alias("n"))
    assert s.count() == 1200 and q.where("abs(n - 1) > 1e-9").count() == 0
    seen = pointing.detector_pointing(s.withColumns({"telescope": F.lit("tel"), "flags": F.when(F.col("i") == 0, 1).otherwise(0)}), simulate.hex_focalplane(spark, 1, 4.0))
    hits = mapping.hit_map(pointing.pixels_healpix(seen, 16))
    assert hits.agg(F.sum("hits")).first()[0] == 14 * 2 * 599
    w = pointing.stokes_weights(seen).select((F.col("wq") ** 2 + F.col("wu") ** 2).alias("p"))
    assert w.where("abs(p - 1) > 1e-9").count() == 0
    g = simulate.ground_scan(spark.createDataFrame([("o", 0.0, 60.0, 10.0, 14.0, 50.0)], "obs string, start double, stop double, az_min double, az_max double, el double"), 20.0).toPandas()
    assert np.abs(np.diff(g["az"])).max() < 1.0 / 20 + 1e-6 and g["az"].min() > 9.4 and g["az"].max() < 14.6


def test_volume_round_trip(spark, tmp_path):
    s = frame(spark, np.arange(50.0) / 7).withColumns({"session": F.lit("s1"), "obs": F.when(F.col("i") < 20, "o1").otherwise("o2")})
    path = f"file://{tmp_path}/vol"
    volume.save(s, path, quanta={"signal": 0.01}, index_fields={"mean": "avg(signal)"}, verify=True)
    back = volume.load(spark, path, "where samples > 20")
    assert back.count() == 30 and {r.obs for r in back.select("obs").distinct().collect()} == {"o2"}
    assert back.where("abs(signal * 100 - round(signal * 100)) > 1e-6").count() == 0
    volume.reindex(spark, path)
    assert spark.read.parquet(f"{path}/index").count() == 2


def test_pipelines_from_config(spark):
    c = {"operators": {"flip": {"function": "filters.detrend", "method": "mean"}, "main": {"steps": ["@config:/operators/flip", "flip"]}}}
    out = config.build(c, "main")(frame(spark, [1.0, 3.0]))
    assert signal(out).tolist() == [-1.0, 1.0]
    other = config.merge(c, {"operators.flip.method": "median"})
    assert config.compare(c, other) == [("/operators/flip/method", "mean", "median")]
    with pytest.raises(ValueError):
        config.build({"operators": {"a": {"steps": ["a"]}}}, "a")
    with pytest.raises(ValueError):
        config.build({"operators": {"a": {"function": "os.system"}}}, "a")


def test_streaming_matches_batch(spark, tmp_path):
    from tideline.streaming.windows import tumbling

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    live = tumbling(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "6 hours")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.kind, r.start, r.n) for r in rows)
    assert key(spark.table("live_windows").collect()) == key(tumbling(e, "6 hours").collect())


def test_catalogue_against_duckdb(spark):
    """A few queries here; the whole catalogue is compared by the driver."""
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in ("events", "customer", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("hit_map", "binned_map", "interval_intersect", "poly_filter_1", "flag_intervals", "crosslinking", "healpix_nest"):
        rows = catalog.queries()[name](spark, d)
        cols = sorted(rows.columns)
        got = sorted([tuple(r[k] for k in cols) for r in rows.collect()], key=repr)
        want = c.sql(catalog.oracle_sql()[name])
        index = [want.columns.index(k) for k in cols]
        expect = sorted([tuple(r[k] for k in index) for r in want.fetchall()], key=repr)
        assert len(got) == len(expect) and all(a == pytest.approx(b) for a, b in zip(got, expect, strict=True)), name


def test_every_sql_answer_of_ground_and_fits_matches(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    d = Path("/root/testdata/sf0.001")
    if not d.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in d.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    for name in ("azimuth_intervals", "calibrate", "healpix_interpolate", "scan_synchronous", "ground_filter", "hwp_synchronous_model", "simple_stat_cut", "demodulate", "noise_estimate"):
        got = catalog.queries()[name](spark, str(d)).toPandas()
        want = con.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
        keys = [c for c in got.columns if got[c].dtype != float]
        got, want = (v.sort_values(keys).reset_index(drop=True) for v in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-4, obj=name)
