import pytest

from pluvion import config


def test_merge_keeps_what_is_not_given():
    s = config.load({"uncertainty": {"niter": 7}, "durations_h": [1]})
    assert s["uncertainty"] == {"enabled": False, "niter": 7, "percentiles": [5, 95], "seed": 0} and s["durations_h"] == [1]
    assert config.DEFAULTS["durations_h"] == [1, 3, 6, 12, 24]


@pytest.mark.parametrize(
    ("over", "name"),
    [
        ({"durations_h": []}, "durations_h"), ({"durations_h": [1], "time_res_min": 45}, "durations_h"), ({"return_periods": [1]}, "return_periods"),
        ({"left_censoring": [0.9, 0.9]}, "left_censoring"), ({"uncertainty": {"niter": 1}}, "uncertainty.niter"), ({"uncertainty": {"percentiles": [95, 5]}}, "uncertainty.percentiles"),
        ({"time_res_min": True}, "time_res_min"), ({"quantiles": [1.0]}, "quantiles"), ({"ws_list": [0]}, "ws_list"),
    ],
)
def test_bad_settings_are_named(over, name):
    with pytest.raises(config.SettingError, match=f"^{name}"):
        config.load(over)


def test_names(tmp_path):
    (tmp_path / "s.yaml").write_text("durations_h: [1, 3]\nreturn_periods: [2, 10]\n")
    s = config.from_yaml(str(tmp_path / "s.yaml"))
    assert config.band_names(s) == ["RL_1h_2yr", "RL_1h_10yr", "RL_3h_2yr", "RL_3h_10yr"]
    assert config.column("A", 0.29) == "A_29" and config.steps(1, 90) == 1 and config.path(s, "M", "Rcp85", 3) == "out/M/Rcp85/WS3"
