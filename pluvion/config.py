"""Settings of the event-statistics chain: defaults, deep merge, checks. A handful of values read by the driver; no data passes through here."""

from __future__ import annotations

import copy
from typing import Any

DEFAULTS: dict[str, Any] = {
    "time_res_min": 60, "min_rain": 0.1, "separation_h": 24, "min_event_min": 60, "durations_h": [1, 3, 6, 12, 24], "return_periods": [2, 5, 10, 20, 50, 100],
    "ws_list": [1, 3, 5], "left_censoring": [0.85, 1.0], "tolerance": 0.1, "a_fractions": [0.5], "pca_alphas": [0.5], "quantiles": [0.85, 0.9, 0.95, 0.99],
    "temp_window_h": 24, "min_events_regression": 50, "uncertainty": {"enabled": False, "niter": 1000, "percentiles": [5, 95], "seed": 0},
    "output": {"root": "out/{model}/{period}", "compression": "zstd"},
}


class SettingError(ValueError):
    """A setting that no run can use, with its name."""


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries are merged key by key, anything else is replaced. Neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def checked(settings: dict) -> dict:
    """The settings, or a SettingError that names the first bad one. Missing ones count as bad."""

    def need(ok: bool, name: str, why: str) -> None:
        if not ok:
            raise SettingError(f"{name}: {why}")

    for name in DEFAULTS:
        need(name in settings, name, "missing")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0
    for name in ("time_res_min", "temp_window_h", "min_events_regression"):
        need(whole(settings[name]), name, "must be a positive whole number")
    for name in ("durations_h", "return_periods", "ws_list", "a_fractions", "pca_alphas", "quantiles"):
        need(isinstance(settings[name], list) and len(settings[name]) > 0, name, "must be a list with values")
    for name in ("durations_h", "ws_list"):
        need(all(map(whole, settings[name])), name, "must hold positive whole numbers")
    need(all(d * 60 % settings["time_res_min"] == 0 for d in settings["durations_h"]), "durations_h", "must be whole numbers of steps")
    need(max(settings["durations_h"]) <= 127, "durations_h", "must fit a byte")
    need(all(t > 1 for t in settings["return_periods"]), "return_periods", "must exceed one year")
    for name in ("a_fractions", "pca_alphas", "quantiles"):
        need(all(0 < q < 1 for q in settings[name]), name, "must lie between 0 and 1")
    lo, hi = settings["left_censoring"]
    need(0 <= lo < hi <= 1, "left_censoring", "must be 0 <= low < high <= 1")
    u = settings["uncertainty"]
    need(whole(u["niter"]) and u["niter"] >= 2, "uncertainty.niter", "must be two at least")
    a, b = u["percentiles"]
    need(0 <= a < b <= 100, "uncertainty.percentiles", "must be in order, from 0 to 100")
    return settings


def load(over: dict | None = None) -> dict:
    return checked(merged(DEFAULTS, over or {}))


def from_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return load(yaml.safe_load(f) or {})


def steps(duration_h: int, time_res_min: int) -> int:
    """Steps of a duration, one at least."""
    return max(1, duration_h * 60 // time_res_min)


def column(prefix: str, share: float) -> str:
    """The name of a metric column, by the rounded percentage."""
    return f"{prefix}_{round(share * 100)}"


def band_names(settings: dict) -> list[str]:
    """Duration-major."""
    return [f"RL_{d}h_{t}yr" for d in settings["durations_h"] for t in settings["return_periods"]]


def path(settings: dict, model: str, period: str, ws: int) -> str:
    return settings["output"]["root"].format(model=model, period=period, period_lower=period.lower()) + f"/WS{ws}"
