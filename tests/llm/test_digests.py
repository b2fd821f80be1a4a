import math

import numpy as np

from pluvion.llm.digests import BITS, digests, merge, percentiles


def rank_errors(got, data, k):
    for r in got:
        v = np.sort(data[r["k"]])
        rank = max(1, math.ceil(r["share"] * len(v)))
        lo, hi = np.searchsorted(v, r["value_lo"] - 1e-6 * abs(r["value_lo"]), "left"), np.searchsorted(v, r["value"] + 1e-6 * abs(r["value"]), "right")
        assert r["n_rows"] == len(v) and r["rank_error"] == BITS * ((len(v) - rank) // k)
        yield max(0, lo + 1 - rank, rank - hi) - r["rank_error"]


def test_error_bound_single_and_merged(rows, monkeypatch):
    """One digest, digests of parts that are merged, and tasks that compress often: the bound is the same, at the ends of the universe too."""
    from pluvion.llm import digests as module

    rng = np.random.default_rng(2)
    data = {"a": rng.weibull(0.7, 20_000) * 5, "b": np.concatenate([rng.normal(size=5000), np.zeros(300), [1e20, 9.9e36, -1e20, 1e200, -1e-9]]), "c": np.array([2.5]), "d": np.full(1000, 4.0)}
    table = rows([(k, i % 4, float(v)) for k, vs in data.items() for i, v in enumerate(vs)] + [("a", 0, None), ("a", 1, float("nan"))], "k string, part int, v double")
    for most in (module.TASK_NODES, 500):
        monkeypatch.setattr(module, "TASK_NODES", most)
        for k in (4000, 100, 20):
            assert max(rank_errors(percentiles(digests(table, ["k"], "v", k), ["k"], k=k).collect(), data, k)) <= 0
            both = percentiles(merge(digests(table, ["k", "part"], "v", k), ["k"], k), ["k"], k=k).collect()
            assert max(rank_errors(both, data, k)) <= 0 and len(both) == 16


def test_null_keys_are_a_group(rows):
    table = rows([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    assert sorted((r["k"] or "", r["n_rows"]) for r in percentiles(digests(table, ["k"], "v"), ["k"], (0.5,)).collect()) == [("", 2), ("a", 1)]


def test_compression_bounds_the_size(rows):
    table = rows([("a", float(v)) for v in np.random.default_rng(3).lognormal(size=20_000)], "k string, v double")
    d = digests(table, ["k"], "v", 50)
    assert d.count() <= 3000 and d.groupBy().sum("n").first()[0] == 20_000


def test_empty(rows):
    assert percentiles(digests(rows([], "k string, v double"), ["k"], "v"), ["k"]).count() == 0
