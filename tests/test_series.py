"""The chain over real series: brute force for one series with missing hours, the output tables, the runs, the estimator."""

import datetime as dt

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from pluvion import config, run, sinks
from pluvion.estimator import Estimator
from pluvion.functions import calendar
from pluvion.operators import grid, spatial
from pluvion.plans import series

T0 = dt.datetime(2001, 1, 1)


def put(rows, folder, hours, n_steps, cal="standard"):
    stamp = lambda i: T0 + dt.timedelta(hours=i)
    return folder(
        sim_run=rows([(1, "M", "P", 1, 1, cal, T0, n_steps, 60, 3)], "run_id int, model string, period_name string, realization int, ws tinyint, cal_name string, t0 timestamp_ntz, n_steps int, time_res_min smallint, tas_dt_h tinyint"),
        grid_cell=rows([(5, 2, 3, 46.0, 10.0, 1.0), (6, 2, 4, 46.0, 10.5, 1.0)], "cell_id int, y int, x int, lat double, lon double, elev_m float"),
        pr_hourly=rows([(1, 5, t, stamp(t), v, stamp(n)) for n, (t, v) in enumerate(hours)], "run_id int, cell_id int, t_i int, ts timestamp_ntz, pr float, loaded_at timestamp_ntz"),
    )


def brute(hours, n_steps, s):
    """Events of one series on its full axis: missing hours stay missing, sums of frames with one do not count."""
    last = dict(hours)
    v = np.zeros(n_steps)
    for t, x in last.items():
        v[t] = np.nan if x is None or np.isnan(x) or x > 1000 else round(float(np.float32(x)) * 10_000) if np.float32(x) >= 0.1 else 0
    wet = np.flatnonzero(np.nan_to_num(v) > 0)
    out = set()
    for storm in np.split(wet, np.flatnonzero(np.diff(wet) > s["separation_h"]) + 1):
        a, b = int(storm[0]), int(storm[-1])
        if a < s["separation_h"] or n_steps - 1 - b < s["separation_h"]:
            continue
        seg, m = v[a : b + 1], b - a + 1
        for k in s["durations_h"]:
            if m < k:
                best, at = (np.nan, 0) if np.isnan(seg).any() else (seg.sum(), m // 2)
            else:
                sums = np.array([seg[max(0, j - k // 2) : j + (k - 1) // 2 + 1].sum() for j in range(m)])
                if np.isnan(sums).all():
                    continue
                at = int(np.nanargmax(sums))
                best = sums[at]
            if not np.isnan(best):
                out.add((k, int(best), a + at, a, b))
    return out


def test_events_against_brute_force(spark, rows, folder):
    rng = np.random.default_rng(12)
    n, hours = 8000, []
    for t in sorted(rng.choice(8000, 700, replace=False).tolist()):
        hours.append((t, rng.choice([None, float("nan"), 0.0, 0.05, -1.0, 2000.0, 0.1, 0.5, 3.25, 7.5], p=[0.03, 0.03, 0.05, 0.09, 0.05, 0.02, 0.13, 0.2, 0.2, 0.2])))
    hours += [(t, 1.5) for t, _ in hours[::40]]
    d = put(rows, folder, hours, n)
    got = {(r["duration_h"], r["total"], r["oe_i"], r["from_i"], r["to_i"]) for r in series.events(spark, d).collect()}
    want = brute(hours, n, config.DEFAULTS)
    assert got == want and len(want) > 30


def test_settings_steer_the_chain(spark, rows, folder):
    hours = [(100, 2.0), (101, 3.0), (110, 4.0), (140, 0.3)]
    d = put(rows, folder, hours, 400)
    s = config.load({"durations_h": [2, 4], "separation_h": 8, "min_rain": 0.5, "min_event_min": 120})
    got = sorted((r["duration_h"], r["total"], r["from_i"], r["to_i"]) for r in series.events(spark, d, s).collect())
    assert got == [(2, 50_000, 100, 101), (4, 50_000, 100, 101)]


def test_years_follow_the_calendar(spark, rows, folder):
    hours = [(8600, 2.0), (8700, 2.0)]
    for cal, years in (("standard", [2001, 2001]), ("360_day", [2001, 2002]), ("365_day", [2001, 2001])):
        e = series.events(spark, put(rows, lambda **t: folder_at(folder, cal, t), hours, 9000, cal)).where("duration_h = 1").orderBy("oe_i")
        assert [r["year"] for r in e.collect()] == years


def folder_at(folder, name, tables):
    import pathlib
    import tempfile

    root = pathlib.Path(tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp"))
    for n, df in tables.items():
        df.write.parquet(f"{root}/{n}.parquet")
    return str(root)


def test_empty_tables_have_their_schema(spark, rows, folder, tmp_path):
    d = put(rows, folder, [], 100)
    rows([], "run_id int, cell_id int, t_i int, ts timestamp_ntz, tas float, loaded_at timestamp_ntz").write.parquet(f"{d}/tas_steps.parquet")
    out = f"{tmp_path}/out"
    for mode in ("extract", "metrics", "both", "tpre24_means"):
        run.run(spark, d, out, mode)
    for name in ("events", "maxima", "parameters", "levels", "tail_metrics", "tail_events", "tail_means", "scaling"):
        df = sinks.read(spark, name, out)
        assert df.count() == 0 and [c for c, _ in sinks.schema(name)] == df.columns[:-3]


def test_runs_write_the_stated_tables(spark, tmp_path):
    out = f"{tmp_path}/out"
    s = config.load({"uncertainty": {"enabled": True, "niter": 20}})
    for mode in ("extract", "metrics", "both", "tpre24_means"):
        run.run(spark, DATA, out, mode, s)
    first = sinks.read(spark, "intervals", out).toPandas()
    run.run(spark, DATA, out, "uncertainty", s)
    keys = ["model", "period_name", "cell_id", "duration_h", "return_period"]
    again = sinks.read(spark, "intervals", out).toPandas().merge(first, on=keys)
    # the stored events are single precision, the draws are the same
    assert len(again) == len(first) > 0 and np.allclose(again["lo_x"], again["lo_y"], rtol=1e-4) and np.allclose(again["hi_x"], again["hi_y"], rtol=1e-4)
    for name in sinks.SCHEMAS:
        df = sinks.read(spark, name, out)
        assert df.count() > 0, name
        types = dict(df.dtypes)
        assert all(types[c] == t for c, t in sinks.schema(name, s)), name
    events = sinks.read(spark, "events", out)
    assert {"model", "period_name", "ws"} <= set(events.columns) and events.count() == series.events(spark, DATA).count()
    with pytest.raises(config.SettingError):
        run.run(spark, DATA, out, "other", s)
    with pytest.raises(ValueError, match="lacks"):
        sinks.conformed(events.drop("oe"), "maxima")


def test_estimator(spark, rows):
    rng = np.random.default_rng(3)
    n = 24 * 365 * 3
    wet = {1: rng.random(n) < 0.06, 2: rng.random(n) < 0.06}
    v = {k: np.where(w, rng.weibull(0.7, n) * 4 + 0.1, 0) for k, w in wet.items()}
    cube = spark.createDataFrame([(k, t, float(v[k][t]), 2001 + t // 8760) for k in v for t in range(n)], "k int, t int, v double, year int")
    e = Estimator(["k"], durations_h=[1, 6], separation_h=6)
    events = e.events(cube)
    assert set(r["duration_h"] for r in events.select("duration_h").distinct().collect()) == {1, 6}
    assert e.complete_years(cube.where("k = 1 or t >= 2000")).select("k", "year").distinct().count() == 5
    s = {(r["k"], r["duration_h"]): r for r in e.summary(cube).collect()}
    assert len(s) == 4 and all(r["rl_2"] < r["rl_50"] for r in s.values()) and all(s[k, 1]["rl_50"] > s[k, 6]["rl_50"] for k in (1, 2))
    ci = {r["return_period"]: r for r in e.intervals(events.withColumn("no", F.col("k")), "no").where("k = 1 and duration_h = 1").collect()}
    assert all(r["lo"] <= r["hi"] for r in ci.values()) and len(ci) == 6
    assert abs(e.stats(cube).where("k = 1 and year = 2002").first()["total"] - v[1][8760:17520].sum()) < 1e-6
    assert e.maxima(events).count() == 12


def test_nearest_on_an_axis(rows):
    axis = [(1, 1.0, 0), (1, 2.0, 1), (1, 4.0, 2), (2, 7.0, 5)]
    points = [(1, "a", 0.0), (1, "b", 1.4), (1, "c", 1.5), (1, "d", 3.1), (1, "e", 9.0), (1, "f", 2.0), (2, "g", 1.0), (3, "h", 1.0), (1, "c", 1.5)]
    got = sorted((r["n"], r["at"]) for r in grid.nearest_of(rows(points, "r int, n string, v double"), rows(axis, "r int, coord double, i int"), ["r"], "v", "at").collect())
    assert got == [("a", 0), ("b", 0), ("c", 0), ("c", 0), ("d", 2), ("e", 2), ("f", 1), ("g", 5), ("h", None)]


def test_points_off_the_grid_are_refused(rows):
    matched = grid.rounded_match(rows([(1.00000001,), (5.0,)], "lat double"), rows([(1.0, 3)], "coord double, i int"), "lat")
    assert sorted((r["i"] is None, r["i"]) for r in matched.collect()) == [(False, 3), (True, None)]
    with pytest.raises(Exception, match="not on the grid"):
        grid.all_matched(matched, "i").collect()
    assert grid.all_matched(matched.where("lat < 2"), "i").count() == 1


def test_units_of_a_time_axis(rows):
    texts = ["hours since 2001-02-03 04:05:06", "days since 1850-01-01", "Minutes since 2000-1-1 00:00", "seconds since 1970-01-01T00:00:00", "fortnights since 2001-01-01", "", None]
    df = rows([(t,) for t in texts], "u string").select("u", calendar.origin(F.col("u")).alias("o"), calendar.unit_seconds(F.col("u")).alias("s"), calendar.at(F.lit(1.5), F.col("u")).alias("at"))
    got = [(r["o"], r["s"], r["at"]) for r in df.collect()]
    assert got[0] == (dt.datetime(2001, 2, 3, 4, 5, 6), 3600, dt.datetime(2001, 2, 3, 5, 35, 6))
    assert got[1] == (dt.datetime(1850, 1, 1), 86400, dt.datetime(1850, 1, 2, 12)) and got[2][1:] == (60, dt.datetime(2000, 1, 1, 0, 1, 30)) and got[3][1] == 1
    assert got[4][1] is None and got[4][2] is None and got[5] == (None, None, None) and got[6] == (None, None, None)


def test_lists_of_shares(rows):
    f = np.array([[9, 0, 1], [4, 6, 0], [0, 0, 0]])
    field = rows([(1, 1, y - 1, x - 1, int(f[y, x])) for y in range(3) for x in range(3)], "e int, duration int, dy int, dx int, f bigint")
    r = spatial.metrics(field, ["e"], 3, (0.25, 0.5, 0.9), (0.4, 0.5, 1.0)).first()
    down = np.cumsum(np.sort(f.ravel())[::-1])
    for q in (25, 50, 90):
        assert r[f"a_{q}"] == (np.flatnonzero(down * 100 >= q * f.sum())[0] + 1) / 9
    for a in (40, 50, 100):
        assert r[f"pca_{a}"] == (f * 100 >= a * f.max()).sum() / 9


def test_upper_limit_of_the_fit(rows):
    from pluvion.operators import fit

    xs = np.sort(np.random.default_rng(2).weibull(0.8, 200) * 3)
    got = fit.weibull_fit(rows([("a", float(x)) for x in xs], "k string, x double"), ["k"], "x", 50, 90).first()
    i = np.arange(101, 181)
    b, a = np.polyfit(np.log(-np.log(1 - i / 201)), np.log(xs[100:180]), 1)
    assert got["n_used"] == 80 and abs(got["shape"] - 1 / b) < 1e-9 and abs(got["scale"] - np.exp(a)) < 1e-9
