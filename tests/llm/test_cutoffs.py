import math

import numpy as np

from pluvion.llm.cutoffs import kept_cutoffs, merged, sketches


def test_exact_with_ties_nulls_and_a_hot_source(rows):
    rng = np.random.default_rng(1)
    data = {"hot": rng.integers(0, 400, 30_000).astype(float), "tied": np.full(500, 7.0), "one": np.array([3.0]), "fine": rng.normal(size=9000)}
    table = rows([(k, float(np.float32(v)), 1) for k, vs in data.items() for v in vs] + [("hot", None, 1), ("hot", float("nan"), 1), (None, 5.0, 1)], "k string, v float, n_rows int")
    targets = rows([("hot", 0.02), ("tied", 0.4), ("one", 0.1), ("fine", 1.0), ("absent", 0.5)], "k string, share double")
    got = {r["k"]: r for r in kept_cutoffs(table, targets, ["k"], "v", "share").collect()}
    for k, share in (("hot", 0.02), ("tied", 0.4), ("one", 0.1), ("fine", 1.0)):
        v = np.sort(data[k].astype(np.float32))[::-1]
        cut = v[max(1, math.ceil(share * len(v))) - 1]
        assert (got[k]["n_rows"], got[k]["cutoff"], got[k]["n_kept"], got[k]["n_ties"]) == (len(v), cut, (v >= cut).sum(), (v == cut).sum())
    assert got["absent"]["n_rows"] == 0 and got["absent"]["cutoff"] is None and got["absent"]["n_kept"] == 0


def test_empty(rows):
    out = kept_cutoffs(rows([], "k string, v float"), rows([("a", 0.5)], "k string, share double"), ["k"], "v", "share").collect()
    assert [(r["n_rows"], r["cutoff"]) for r in out] == [(0, None)]


def test_sketches_merge(rows):
    parts = sketches(rows([("a", i % 3, float(i)) for i in range(999)], "k string, day int, v float"), ["k", "day"], "v")
    assert merged(parts, ["k"]).first()["n_rows"] == 999


def test_double_values_keep_their_digits(rows):
    values = [1 + i * 1e-12 for i in range(100)]
    data = rows([("a", v) for v in values], "k string, v double")
    r = kept_cutoffs(data, rows([("a", 0.25)], "k string, share double"), ["k"], "v", "share").first()
    assert r["cutoff"] == values[75] and r["n_kept"] == 25 and r["n_ties"] == 1
