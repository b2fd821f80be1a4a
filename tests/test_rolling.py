from pluvion.operators.rolling import event_rolling, temperature_rolling

TAS = "run_id int, cell_id int, t_i int, tas float, loaded_at timestamp, total double, n int"


def test_inactive_days_fixed_denominators_and_dirt(rows):
    nan = float("nan")
    data = [(1, 1, 0, 280.0), (1, 1, 6, 284.0), (1, 1, 24, nan), (1, 1, 48, None), (1, 1, 24 * 9, 290.0), (1, 1, 24 * 9, 290.0), (1, 2, 5, None)]
    out = {r["day_i"]: r for r in temperature_rolling(rows([(*x, None, 1.0, 1) for x in data], TAS)).collect()}
    assert sorted(out) == list(range(10))
    assert [d for d in out if not out[d]["active"]] == list(range(1, 9))
    assert out[6]["tas_mean_7"] == 282.0 and out[7]["tas_mean_7"] is None and out[9]["tas_mean_7"] == 290.0
    assert out[9]["tas_mean_30"] == (280 + 284 + 290) / 3
    assert out[0]["active_share_7"] == 1 / 7 and out[9]["active_share_30"] == 2 / 30


def test_empty(rows):
    assert temperature_rolling(rows([], TAS)).count() == 0


def test_events_count_once_and_days_without_rows_come_out(rows):
    pr = rows([(1, 1, 0), (1, 1, 24 * 3)], "run_id int, cell_id int, t_i int")
    oe = rows([(1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 3, 2), (1, 1, 1, None)], "run_id int, cell_id int, duration_h int, oe_i int")
    tt = rows([(1, 1, 1, 2, 5.0), (1, 1, 1, 2, 5.0), (1, 1, 3, 2, float("nan"))], "run_id int, cell_id int, duration_h int, oe_i int, t_pre24 float")
    out = {r["day_i"]: r for r in event_rolling(pr, oe, tt).collect()}
    assert sorted(out) == [0, 1, 2, 3] and not out[1]["active"]
    assert out[3]["n_events_7"] == 2 and out[3]["events_per_day_7"] == 2 / 7 and out[3]["t_pre24_mean_30"] == 5.0
