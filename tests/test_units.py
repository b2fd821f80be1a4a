from datetime import datetime, timedelta

import numpy as np

from pluvion.operators import units
from pluvion.operators.units import converted, ends_of_parts, moves, number_and_rest, summed, unit_of

READ = "rec_id long, source string, var_name string, cell_id int, ts timestamp, val double, val_text string, units string, remark string, said string"
SRC = "source string, title string, pr_units string, tas_units string, attr_text string"


def test_labels():
    pr = {"mm day-1": "mm/day", "[MM/H]": "mm/h", "mm/h x 0.1": "0.1mm/h", "KG M-2 S-1": "kg/m2/s", "m s^-1": "m/s", "in h-1": "in/h", "Zentimeter pro Stunde": "cm/h", "ok": None, "": None}
    assert {t: unit_of(t, "pr") for t in pr} == pr
    tas = {" K": "K", "℃": "degC", "deg F": "degF", "K x 0.1": "0.1K", "sensor cleaned": None}
    assert {t: unit_of(t, "tas") for t in tas} == tas
    assert unit_of("K", "wind") is None and unit_of(None, None) is None


def test_numbers():
    assert number_and_rest("ca. 0,5 mm/h") == (0.5, " mm/h")
    assert number_and_rest("tas = −1,540")[0] == -1.54
    assert number_and_rest("1.9e-04kg") == (1.9e-4, "kg")
    assert number_and_rest("n/a") == (None, None) and number_and_rest(None) == (None, None)


def test_record_before_source_and_impossible_labels(rows):
    src = rows([("a", "", None, "deg C", None), ("b", "", None, None, "x; precipitation: pouces par heure")], SRC)
    data = [(i, "a", "tas", i, None, 10.0 + i % 9, None, None, None, "x") for i in range(40)]
    data += [(100, "a", "tas", 1, None, 15.0, None, "K", None, "x"), (101, "a", "tas", 1, None, None, "50 F", None, None, "x"), (102, "a", "tas", 1, None, None, "n/a", "K", None, "x")]
    data += [(200 + i, "b", "pr", 1, None, 0.05 * (1 + i % 3), None, None, None, "x") for i in range(20)]
    data += [(300, None, "wind", None, None, 3.0, None, "m/s", None, None), (301, "zz", "pr", 1, None, 2.0, None, "mm/h", None, None), (301, "zz", "pr", 1, None, 2.0, None, "mm/h", None, None)]
    out = [(r["rec_id"], r["unit"], r["value"]) for r in converted(rows(data, READ), src).collect()]
    unit = {i: u for i, u, _ in out}
    assert unit[100] == "degC" and unit[101] == "degF" and unit[102] is None and unit[300] is None and unit[301] == "mm/h"
    assert all(unit[i] == "degC" for i in range(40)) and all(unit[200 + i] == "in/h" for i in range(20))
    assert abs(dict((i, v) for i, _, v in out)[101] - 283.15) < 1e-9


def test_unlabelled_source_is_decoded_from_its_values(rows):
    src = rows([("a", "", None, None, None), ("b", "", "mm/h", None, None)], SRC)
    data = [(i, "a", "pr", i, None, 4e-4 * (1 + i % 5), None, None, None, "") for i in range(60)]
    data += [(100 + i, "b", "pr", i, None, 1.4 * (1 + i % 5), None, "mm/h", None, "") for i in range(60)]
    assert {r["unit"] for r in converted(rows(data, READ), src).where("source = 'a'").collect()} == {"kg/m2/s"}


def test_tree_gives_the_path_of_viterbi():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 101):
        score, move = rng.normal(scale=4, size=(n, 4)), moves(4)
        best, back = score[0].copy(), np.zeros((n, 4), int)
        for t in range(1, n):
            step = best[:, None] + move
            back[t], best = step.argmax(axis=0), step.max(axis=0) + score[t]
        want = [int(best.argmax())]
        for t in range(n - 1, 0, -1):
            want.append(int(back[t, want[-1]]))
        leaves = np.full((n, 4, 4), -np.inf)
        leaves[:, np.arange(4), np.arange(4)] = score
        tree = summed(leaves, move)
        first, last = np.unravel_index(tree[-1][0].argmax(), (4, 4))
        i, j = ends_of_parts(tree, move, first, last)
        assert (i == want[::-1]).all() and (i == j).all() and abs(tree[-1][0].max() - best.max()) < 1e-9


def test_path_does_not_depend_on_the_cuts(rows, monkeypatch):
    """A device that switches its unit for some weeks and back, among labelled readings in other units and readings without a time."""
    rng = np.random.default_rng(4)
    start = datetime(2001, 1, 1)
    data, want = [], {}
    for i in range(400):
        mm, unit = float(rng.lognormal(0.3, 0.7)), "mm/day" if 150 <= i < 220 else "mm/h"
        shown, label = (mm * 24 if unit == "mm/day" else mm), None
        if i % 9 == 4:
            shown, label, unit = mm / 25.4, "in/h", "in/h"
        data.append((i, "a", "pr", 1, start + timedelta(hours=5 * i), shown, None, label, None, "x"))
        want[i] = unit
    data += [(1000 + i, "a", "pr", 2, None, 1.5, None, None, None, "x") for i in range(30)]
    data += [(2000 + i, "b", "pr", 3, start + timedelta(days=i % 365), float(rng.lognormal(0.3, 0.7)), None, "mm/h", None, "x") for i in range(1500)]
    src = rows([("a", "", "mm/h", None, None), ("b", "", None, None, None)], SRC)
    found = []
    for n in (4000, 60, 7):
        monkeypatch.setattr(units, "STRETCH_ROWS", n)
        found.append({r["rec_id"]: r["unit"] for r in converted(rows(data, READ), src).collect()})
    assert found[1] == found[0] and found[2] == found[0]
    wrong = [i for i in want if found[0][i] != want[i]]
    # at the two switches some readings fit both units
    assert len(wrong) <= 6 and all(145 <= i < 225 for i in wrong)
    assert all(found[0][1000 + i] == "mm/h" for i in range(30))


def test_empty(rows):
    assert converted(rows([], READ), rows([], SRC)).count() == 0
