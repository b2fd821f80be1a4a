import numpy as np

from pluvion.operators.faults import p6_found, pareto_cutoff


def test_cutoff_of_an_exponential_tail():
    x = np.random.default_rng(1).exponential(1.0, 400_000)
    u, a, b = np.quantile(x, [0.9, 0.97, 0.995])
    assert abs(pareto_cutoff(u, a, b, (0.9, 0.97, 0.995), 1e-5) - np.log(1e5)) < 1.5
    assert pareto_cutoff(1.0, 1.0, 1.0, (0.9, 0.97, 0.995), 1e-5) is None


def put(folder, rows, pr, tas=(), oe=()):
    runs = rows([(1, "M", None)], "run_id int, model string, t0 timestamp")
    return folder(
        sim_run=runs,
        pr_hourly=rows(pr, "run_id int, cell_id int, t_i int, pr float, model string, month int"),
        tas_steps=rows(list(tas), "run_id int, cell_id int, t_i int, tas float"),
        ordinary_event=rows(list(oe), "run_id int, cell_id int, duration_h int, oe_i int, from_i int, oe float"),
    )


def test_spike_stuck_impossible_and_what_is_no_case(spark, rows, folder):
    rng = np.random.default_rng(2)
    pr = [(1, c, t, float(np.float32(rng.weibull(0.9))), "x", 1) for c in range(4) for t in range(3000)]
    pr[500] = (1, 0, 500, 300.0, "x", 1)
    pr[700] = (1, 0, 700, -9999.0, "x", 1)
    pr[900] = (1, 0, 900, 1e20, "x", 1)
    for t in range(1200, 1215):
        pr[t] = (1, 0, t, 2.5, "x", 1)
    for t in range(1500, 1540):
        pr[t] = (1, 0, t, 0.0, "x", 1)
    pr[1600], pr[1601] = (1, 0, 1600, None, "x", 1), (1, 0, 1601, float("nan"), "x", 1)
    pr += [pr[500], (None, 0, 3, 1.0, "x", 1)]
    got = {r["t_i"] for r in p6_found(spark, put(folder, rows, pr)).collect()}
    assert {500, 700, 900, *range(1200, 1215)} <= got
    assert not got & {*range(1500, 1540), 1600, 1601} and len(got) <= 20


def test_empty_tables(spark, rows, folder):
    assert p6_found(spark, put(folder, rows, [])).count() == 0
