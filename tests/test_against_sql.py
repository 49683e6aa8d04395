"""Queries on small tables of odd events, against their SQL in DuckDB."""

import pandas as pd
import pytest

from tideline.plans import catalog


def compare(spark, folder, name, events):
    """events: rows of (user_id, event_type, value), an event a second."""
    duckdb = pytest.importorskip("duckdb")
    e = pd.DataFrame(events, columns=["user_id", "event_type", "value"])
    e.insert(0, "event_id", range(len(e)))
    e.insert(1, "ts", pd.Timestamp("2024-01-01") + pd.to_timedelta(e["event_id"], unit="s"))
    path = f"{folder}/events.parquet"
    con = duckdb.connect()
    con.register("e", e)
    con.execute(f"copy (select event_id, ts::timestamp as ts, user_id, event_type, value, '' as props from e) to '{path}'")
    con.execute(f"create view events as select * from read_parquet('{path}')")
    got = catalog.queries()[name](spark, str(folder)).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
    keys = [c for c in got.columns if got[c].dtype != float]
    got, want = (v.sort_values(keys).reset_index(drop=True) for v in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9, obj=name)
    return got


def test_division_by_a_signal_of_zero(spark, tmp_path):
    got = compare(spark, tmp_path, "combine_divide", [(u, "view", v) for u in range(3) for v in (0.0, 2.0, -0.0, -3.0)])
    assert got["result"].isna().sum() == 6


def test_directions_on_the_edges_of_pixels(spark, tmp_path):
    compare(spark, tmp_path, "scan_synchronous", [(u, "view", 1.0) for u in (0, 15) for _ in range(360)])


def test_spectra_of_streams_with_absent_lags(spark, tmp_path):
    # Detectors of fewer samples than lags, one without a pair of good samples at some lag, one without a good sample.
    kinds = ["view", "error", "click", "signup", "view", "view", "error"]
    short = [(n, kinds[j * n % 7], float(j * j % 11)) for n in (1, 2, 3, 5, 17, 29) for j in range(n)]
    gaps = [(40, "view" if j < 12 or j > 40 else "error", float(j % 5)) for j in range(44)]
    got = compare(spark, tmp_path, "noise_estimate", [*short, *gaps, *[(50, "error", 1.0)] * 30])
    assert 40 in set(got["det"]) and 50 not in set(got["det"])
