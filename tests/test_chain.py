"""The event-statistics operators against plain numpy, at their edges."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from pluvion.operators import events as ev
from pluvion.operators import fit, grid, scaling, tails


def test_strict_mean_at_edges_and_nulls(rows):
    v = np.arange(20.0).reshape(4, 5)
    v[2, 2] = np.nan
    cube = rows([(y, x, 0, None if np.isnan(v[y, x]) else float(v[y, x])) for y in range(4) for x in range(5)], "y int, x int, t int, v double")
    for size in (2, 3):
        a, b = grid.bounds(size)
        got = {(r["y"], r["x"]): r["mean"] for r in grid.strict_mean(cube, size).collect()}
        for y in range(4):
            for x in range(5):
                inside = y + a >= 0 and x + a >= 0 and y + b < 4 and x + b < 5
                want = v[y + a : y + b + 1, x + a : x + b + 1].mean() if inside else np.nan
                assert got[y, x] is None if np.isnan(want) else abs(got[y, x] - want) < 1e-12
    edge = {(r["y"], r["x"]): r["mean"] for r in grid.edge_mean(cube.where("not (y = 2 and x = 2)").unionByName(cube.where("y = 2 and x = 2").withColumn("v", F.lit(12.0))), 3, 4, 5).collect()}
    full = np.pad(np.arange(20.0).reshape(4, 5), 1, mode="edge")
    assert all(abs(edge[y, x] - full[y : y + 3, x : x + 3].mean()) < 1e-12 for y in range(4) for x in range(5))


def test_peaks_match_convolution(rows):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for cell in range(12):
        n = int(rng.integers(1, 12))
        v = rng.integers(0, 6, n)
        v[0], v[-1] = 5, 5
        data += [(cell, t, int(v[t])) for t in range(n)]
        for k in (1, 3, 4, 6):
            s = np.convolve(v, np.ones(k, int), "same")[:n] if n >= k else None
            want[cell, k] = (int(s.max()), int(s.argmax())) if n >= k else (int(v.sum()), n // 2)
    inside = ev.in_storms(rows(data, "cell int, t int, v int"), ["cell"], F.col("v") >= 1, 100)
    got = {(r["cell"], r["duration"]): (r["total"], r["oe_i"]) for r in ev.peaks(inside, ["cell"], [1, 3, 4, 6]).collect()}
    for key, (m, at) in want.items():
        assert got[key][0] == m, key
        assert got[key][1] == at, key


def test_separation_equality_stays_together(rows):
    wet = rows([(1, 0), (1, 3), (1, 7)], "cell int, t int")
    assert sorted((r["s0"], r["s1"]) for r in ev.storms(wet, ["cell"], 3).collect()) == [(0, 3), (7, 7)]


def test_gap_filter_against_the_axis(rows):
    """Storms of single series on an axis with two holes, by numpy: a storm goes if one of its wet steps lies in a guard before or after a hole."""
    rng, sep, gaps = np.random.default_rng(9), 3, [(29, 41), (60, 70)]
    axis = np.array([t for t in range(100) if not (29 < t < 41 or 60 < t < 70)])
    data, want = [], set()
    for cell in range(40):
        wet = np.sort(rng.choice(axis, 14, replace=False))
        data += [(cell, int(t)) for t in wet]
        for s in np.split(wet, np.flatnonzero(np.diff(wet) > sep) + 1):
            guards = [t for a, b in gaps for t in (*range(a - sep, a), *range(b, b + sep))]
            if not np.intersect1d(s, guards).size:
                want.add((cell, int(s[0]), int(s[-1])))
    wet = rows(data, "cell int, t int")
    every = ev.storms(wet, ["cell"], sep)
    left = {(r["cell"], r["s0"], r["s1"]) for r in ev.away_from_gaps(every, wet, gaps, ["cell"], sep).collect()}
    assert left == want and len(want) < every.count()
    alone = rows([(1, 29), (2, 28), (3, 26), (4, 25), (5, 41), (6, 43), (7, 44)], "cell int, t int")
    assert sorted(r["cell"] for r in ev.away_from_gaps(ev.storms(alone, ["cell"], sep), alone, gaps[:1], ["cell"], sep).collect()) == [1, 4, 7]


def test_draws_are_those_of_a_bootstrap():
    """Counts of a block vary as with replacement, and as many distinct blocks come up."""
    for blocks in (3, 5, 7, 10, 20, 40):
        times = np.zeros((40_000, blocks))
        np.add.at(times, (np.arange(40_000)[:, None], np.concatenate([fit.mixed_draws(key, blocks, 1000) for key in range(11, 411, 10)])), 1)
        assert abs(times.var() - (1 - 1 / blocks)) < 0.02
        assert abs((times > 0).sum(axis=1).mean() - blocks * (1 - (1 - 1 / blocks) ** blocks)) < 0.02 * blocks**0.5
        # neighbouring iterations and slots know nothing of each other
        draws = fit.mixed_draws(5, blocks, 20_000)
        same = 1 / blocks
        for a, b in ((draws[1:], draws[:-1]), (draws[:, 1:], draws[:, :-1]), (draws, fit.mixed_draws(6, blocks, 20_000))):
            assert abs((a == b).mean() - same) < 0.02


def test_fit_edges(rows):
    one = lambda k, xs: [(k, float(x)) for x in xs]
    data = one("n1", [3]) + one("n2", [1, 2]) + one("n4", [1, 2, 3, 4]) + one("n9", range(1, 10)) + one("equal", [5] * 30) + one("dirt", [0, -1, float("inf"), 2, 3])
    got = {r["k"]: r for r in fit.weibull_fit(rows(data, "k string, x double"), ["k"], "x").collect()}
    assert "n1" not in got and "equal" not in got and got["n2"]["n_used"] == 2 and got["dirt"]["n"] == 2
    xs = np.sort(np.random.default_rng(1).weibull(0.7, 4000) * 5)
    g = fit.weibull_fit(rows([("a", float(x)) for x in xs], "k string, x double"), ["k"], "x").first()
    assert abs(g["shape"] - 0.7) < 0.08


def brute_seeded(x, year, seed, periods, niter):
    """The seeded estimator sample by sample: as many columns of numbers as samples, one row a block."""
    names = np.unique(year)
    per_year, levels = len(x) / len(names), np.full((niter, len(periods)), np.nan)
    draws = np.random.default_rng(np.random.SeedSequence(seed)).integers(0, len(names), size=(len(names), niter))
    for it in range(niter):
        s = np.sort(np.concatenate([x[year == names[b]] for b in draws[:, it]]))
        n = len(s)
        a = int(np.floor(n * 0.85))
        a = 0 if a <= 1 else a
        if n - a < 2:
            continue
        u, v = np.log(np.log(1 / (1 - np.arange(a + 1, n + 1) / (n + 1)))), np.log(s[a:])
        slope = np.cov(u, v, bias=True)[0, 1] / u.var()
        levels[it] = [np.exp(v.mean() - slope * u.mean()) * (-np.log(1 - (1 - 1 / p) ** (1 / per_year))) ** slope for p in periods]
    return np.nanpercentile(levels, [5, 95], axis=0)


def test_seeded_bootstrap_invariants(rows):
    periods = [2, 5, 10, 20, 50, 100]
    for seed, years, per_year, shape, scale in ((1, 10, 20, 0.5, 2), (2, 20, 15, 0.9, 8), (3, 45, 60, 0.7, 5), (4, 12, 100, 1.2, 3)):
        rng = np.random.default_rng(seed)
        x, y = rng.weibull(shape, years * per_year) * scale, np.repeat(np.arange(1990, 1990 + years), per_year)
        got = fit.seeded_interval(x, y, [0, 17], periods, 60)
        assert np.allclose(got, brute_seeded(x, y, [0, 17], periods, 60), rtol=1e-5)
    rng = np.random.default_rng(7)
    y = np.concatenate([np.full(int(rng.integers(5, 80)), t) for t in range(1990, 2020)])
    x = rng.weibull(0.7, len(y)) * 5
    assert np.allclose(fit.seeded_interval(x, y, [3, 4], periods, 60), brute_seeded(x, y, [3, 4], periods, 60), rtol=1e-5)
    rng = np.random.default_rng(21)
    x, y = rng.weibull(0.7, 40 * 50) * 5, np.repeat(np.arange(1980, 2020), 50)
    a = fit.seeded_interval(x, y, [7, 1], periods, 400)
    assert a.shape == (2, 6) and (a[0] <= a[1]).all() and (np.diff(a, axis=1) > 0).all() and a.dtype == np.float32
    assert (fit.seeded_interval(x, y, [7, 1], periods, 400) == a).all() and (fit.seeded_interval(x, y, [7, 2], periods, 400) != a).any()
    fitted = fit.weibull_fit(rows([("a", float(v)) for v in x], "k string, x double"), ["k"], "x").withColumn("per_year", F.lit(50.0))
    point = [r["level"] for r in fit.return_levels(fitted, periods).orderBy("return_period").collect()]
    assert (a[0] < point).all() and (point < a[1]).all()
    assert fit.seeded_interval(np.array([3.0]), np.array([2000]), [1], [2], 10) is None
    assert fit.seeded_interval(np.array([]), np.array([]), [1], [2], 10) is None
    # equal values have slope 0: every level is the value
    assert np.allclose(fit.seeded_interval(np.full(40, 4.0), np.repeat([1, 2], 20), [1], [2, 50], 10), 4.0)


def test_thresholds_higher_match_numpy(rows):
    rng = np.random.default_rng(4)
    data = {k: rng.integers(0, 50, k) for k in (1, 2, 3, 20, 21, 101)}
    got = {r["k"]: r for r in tails.thresholds_higher(rows([(k, int(v)) for k, vs in data.items() for v in vs], "k int, x int"), ["k"], "x").collect()}
    for k, vs in data.items():
        assert [got[k][f"t{p}"] for p in (85, 90, 95, 99)] == [np.quantile(vs, p / 100, method="higher") for p in (85, 90, 95, 99)]


def test_quantile_line_is_optimal():
    rng = np.random.default_rng(8)
    for n, q in itertools.product((5, 12, 25), (0.5, 0.85, 0.95)):
        x, y = rng.normal(size=n).round(1), rng.normal(size=n)
        loss = lambda a, b: np.where(y - a - b * x >= 0, q, q - 1) @ (y - a - b * x)  # noqa: E731,B023
        lines = [(y[i] - x[i] * s, s) for i, j in itertools.combinations(range(n), 2) if x[i] != x[j] for s in [(y[j] - y[i]) / (x[j] - x[i])]]
        assert loss(*scaling.quantile_line(x, y, q)) <= min(loss(a, b) for a, b in lines) + 1e-9


def test_slope_error_is_that_of_repeated_samples():
    """Slopes of many samples scatter as the standard error says, and the interval holds the true slope about as often as it should."""
    rng = np.random.default_rng(6)
    for q in (0.5, 0.85):
        slopes, errors, inside = [], [], 0
        for _ in range(200):
            x = rng.normal(size=300)
            y = 1 + 0.5 * x + rng.normal(size=300)
            a, b = scaling.quantile_line(x, y, q)
            e = scaling.slope_error(x, y, q, a, b)
            slopes.append(b)
            errors.append(e)
            inside += abs(b - 0.5) <= 1.96 * e
        assert abs(np.mean(slopes) - 0.5) < 0.02 and 0.8 < np.median(errors) / np.std(slopes) < 1.25 and 0.9 <= inside / 200 <= 0.99
    assert abs(scaling.student_975(48) - 2.010635) < 1e-5 and abs(scaling.student_975(200) - 1.971896) < 1e-6


def test_regression_of_few_or_equal(rows):
    few = [("few", float(i), 1.0 + i) for i in range(10)] + [("equal", 1.0, 1.0 + i) for i in range(60)] + [("equal", None, 1.0), ("equal", 1.0, -1.0)]
    got = scaling.quantile_regression(rows(few, "k string, x double, y double"), ["k"], "x", "y", [0.9]).collect()
    assert [(r["k"], r["n_events"], r["converged"], r["slope_pct"]) for r in got] == [("equal", 60, False, None)]


def brute_levels(x, year, draws, per_year, periods):
    """Return levels of every draw of year blocks, one refit after the other."""
    names, levels = np.unique(year), []
    for draw in draws:
        s = np.sort(np.log(np.concatenate([x[year == names[b]] for b in draw])))
        n = len(s)
        a = n * 85 // 100 if n * 85 // 100 > 1 else 0
        if n - a >= 2:
            b, c = np.polyfit(np.log(-np.log(1 - np.arange(a + 1, n + 1) / (n + 1))), s[a:], 1)
            if abs(b) > 1e-12:
                levels.append([np.exp(c) * (-np.log(1 - (1 - 1 / p) ** (1 / per_year))) ** b for p in periods])
    return np.array(levels)


def test_bootstrap_queries_draw_as_often_as_the_settings(spark):
    """Both registered queries against a refit after every one of the reference's 1000 draws."""
    from oracle import DATA
    from pluvion import config
    from pluvion.plans import reference

    niter = config.DEFAULTS["uncertainty"]["niter"]
    assert niter == 1000
    e = reference.events(spark, DATA).select("cell", "duration", "year", "oe", "key_no", "raster_no").toPandas()
    rel = reference.QUERIES["bootstrap_ci_rel"](spark, DATA).toPandas().set_index(["cell", "duration", "return_period"])
    seeded = reference.QUERIES["bootstrap_ci_seeded"](spark, DATA).toPandas().set_index(["cell", "duration", "return_period"])
    for (cell, duration), g in list(e.groupby(["cell", "duration"]))[:4]:
        x, year, no = g["oe"].to_numpy(), g["year"].to_numpy(), int(g["key_no"].iloc[0])
        nb = len(np.unique(year))
        want = np.percentile(brute_levels(x, year, fit.mixed_draws(no, nb, niter), len(x) / nb, reference.PERIODS), [5, 95], axis=0)
        assert np.allclose(rel.loc[cell, duration].loc[reference.PERIODS, ["lo", "hi"]].T, want, atol=2e-6)
        want = brute_seeded(x, year, [0, int(g["raster_no"].iloc[0])], reference.PERIODS, niter)
        assert np.allclose(seeded.loc[cell, duration].loc[reference.PERIODS, ["lo", "hi"]].T, want, rtol=1e-5)


def test_every_hourly_step_has_its_civil_year(spark, rows, folder):
    from datetime import datetime

    from pluvion.plans import reference

    runs = [(1, "standard", datetime(2003, 12, 31), 60), (2, "360_day", datetime(2004, 1, 1), 60), (3, "365_day", datetime(2004, 12, 30), 60), (4, "360_day", datetime(2004, 12, 1), 30)]
    hours = [(1, 23), (1, 24), (1, 24), (1, 24 * 366 + 23), (1, 24 * 367), (2, 8639), (2, 8640), (3, 47), (3, 48), (4, 48 * 30 - 1), (4, 48 * 30), (9, 5), (1, None)]
    d = folder(sim_run=rows(runs, "run_id int, cal_name string, t0 timestamp, time_res_min smallint"), pr_hourly=rows(hours, "run_id int, t_i int"))
    got = sorted((r["run_id"], r["t_i"], r["year"]) for r in reference.QUERIES["calendar_step_years"](spark, d).collect())
    assert got == [
        (1, 23, 2003), (1, 24, 2004), (1, 24 * 366 + 23, 2004), (1, 24 * 367, 2005), (2, 8639, 2004), (2, 8640, 2005), (3, 47, 2004), (3, 48, 2005),
        (4, 48 * 30 - 1, 2004), (4, 48 * 30, 2005), (9, 5, None),
    ]


def test_incomplete_years_are_dropped(spark, rows):
    from oracle import DATA
    from pluvion.plans import reference

    data = [(1, y, t, 1.0 if t < n else bad) for y, n, bad in ((2000, 329, None), (2001, 328, None), (2002, 329, float("nan")), (2003, 200, float("nan"))) for t in range(365)]
    data += [(2, 2001, t, 2.0) for t in range(365)]
    got = ev.complete_years(rows(data, "k int, year int, t int, v double"), ["k"], "year", "v", 365, 0.1).groupBy("k", "year").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect())) == [(1, 2000, 365, 329.0), (1, 2002, 365, 329.0), (2, 2001, 365, 730.0)]
    years = reference.QUERIES["complete_years"](spark, DATA).select("year").distinct().collect()
    assert sorted(r["year"] for r in years) == list(range(1995, 2001))
