"""A covariate before each event, and quantile regression of intensity on it."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def preceding_mean(covariate: DataFrame, keys: list[str], t: str, v: str, steps: int) -> DataFrame:
    """keys, t, pre: the mean of the ``steps`` steps before each one, NULL unless all of them are there and valid."""
    w = W.partitionBy(*keys).orderBy(t).rangeBetween(-steps, -1)
    return covariate.select(*keys, t, F.when(F.count(v).over(w) == steps, F.avg(v).over(w)).alias("pre"))


def covariate_step(times: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """keys, least and greatest step between successive distinct times in hours, and whether it is one whole number of hours that divides a day."""
    w = W.partitionBy(*keys).orderBy(ts)
    steps = times.select(*keys, ts).where(F.col(ts).isNotNull()).distinct().withColumn("_d", F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")))
    out = steps.groupBy(*keys).agg((F.min("_d") / 3.6e9).alias("least_h"), (F.max("_d") / 3.6e9).alias("greatest_h"))
    step = F.col("least_h")
    fine = (step == F.col("greatest_h")) & (step == F.floor(step)) & (F.pmod(F.lit(24.0), step) == 0)
    return out.withColumn("regular", F.coalesce(fine, F.lit(False)))


def quantile_line(x: np.ndarray, y: np.ndarray, q: float) -> tuple[float, float]:
    """Intercept and slope that minimise the check loss, exactly.

    An optimal line runs through two points. From a point, the best line through it has the slope at which the weighted check loss of the slopes to all other
    points is least; it meets a second point, and from there the step is taken again until no turn lowers the loss.
    """
    def loss(a: float, b: float) -> float:
        r = y - a - b * x
        return float(np.sum(np.where(r >= 0, q * r, (q - 1) * r)))

    if np.ptp(x) == 0:
        return float(np.quantile(y, q, method="inverted_cdf")), 0.0
    b = np.polyfit(x, y, 1)[0]
    r = y - b * x
    i = int(np.argsort(r, kind="stable")[min(len(r) - 1, int(np.ceil(q * len(r))) - 1)])
    best = (math.inf, 0.0, 0.0)
    tried: set[int] = set()
    while i not in tried:
        tried.add(i)
        dx, dy = x - x[i], y - y[i]
        far = np.flatnonzero(dx != 0)
        slope = dy[far] / dx[far]
        order = np.argsort(slope, kind="stable")
        # turning up past a point moves it from above to below the line if it lies to the right, the other way if to the left
        weight = np.abs(dx[far])[order]
        down = np.where(dx[far][order] > 0, q, 1 - q) * weight
        at = int(np.searchsorted(np.cumsum(weight), down.sum() - 1e-12 * weight.sum()))
        j = far[order[min(at, len(far) - 1)]]
        b = float(dy[j] / dx[j])
        a = float(y[i] - b * x[i])
        now = loss(a, b)
        if now < best[0] - 1e-12 * (1 + abs(best[0] if math.isfinite(best[0]) else 0)):
            best = (now, a, b)
            tried = {i}
        i = int(j)
    return best[1], best[2]


def slope_error(x: np.ndarray, y: np.ndarray, q: float, a: float, b: float) -> float:
    """Standard error of the slope: the robust sandwich of Greene ("Econometric Analysis", 2008) with an Epanechnikov kernel and the Hall-Sheather bandwidth."""
    n, z = len(x), NormalDist()
    c = z.inv_cdf(q)
    h = n ** (-1 / 3) * z.inv_cdf(0.975) ** (2 / 3) * (1.5 * z.pdf(c) ** 2 / (2 * c * c + 1)) ** (1 / 3)
    h = min(h, 0.99 * min(q, 1 - q))
    r = y - a - b * x
    width = min(float(y.std()), float(np.subtract(*np.percentile(r, [75, 25]))) / 1.34) * (z.inv_cdf(q + h) - z.inv_cdf(q - h))
    if not width > 0:
        return math.nan
    u = r / width
    density = float(np.sum(np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0.0))) / (n * width)
    m = np.column_stack([np.ones(n), x])
    inner = np.linalg.pinv(m.T @ m)
    share = np.where(r > 0, q, 1 - q) / density
    return float(np.sqrt((inner @ (m.T @ (m * (share**2)[:, None])) @ inner)[1, 1]))


def student_975(freedom: int) -> float:
    """The 0.975 quantile of Student's distribution by its expansion about the normal one; five digits from 20 degrees of freedom on."""
    z = NormalDist().inv_cdf(0.975)
    return z + (z**3 + z) / (4 * freedom) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * freedom**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * freedom**3)


def good_pairs(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.col(y) > 0) & (F.col(y) < float("inf"))).select(*keys, x, y)


def quantile_lines(pairs: DataFrame, keys: list[str], x: str, y: str, quantiles: list[float], least: int = 50) -> DataFrame:
    """keys, q, a, b, mid: the lines themselves, as found, and the mean of x. A group is the events of one cell and duration."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", q double, a double, b double, mid double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf[x].to_numpy(float), np.log(pdf[y].to_numpy(float))
        rows = [(*key, q, *quantile_line(u, v, q), float(u.mean())) for q in quantiles] if len(u) >= least and np.ptp(u) > 0 else []
        return pd.DataFrame(rows, columns=[*keys, "q", "a", "b", "mid"])

    return good_pairs(pairs, keys, x, y).groupBy(*keys).applyInPandas(one, schema)


def quantile_regression(pairs: DataFrame, keys: list[str], x: str, y: str, quantiles: list[float], least: int = 50) -> DataFrame:
    """keys, quantile, slope_pct, slope_lo, slope_hi, intercept, n_events, converged: ln y on x, slopes as percent per unit at three digits.

    Pairs need a number x and a positive y; groups with fewer than ``least`` have no rows. A group is the events of one cell and duration. Where the regression
    fails (equal x), numbers are NULL and ``converged`` is false.
    """
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", quantile double, slope_pct double, slope_lo double, slope_hi double, intercept double, n_events int, converged boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf[x].to_numpy(float), np.log(pdf[y].to_numpy(float))
        if len(u) < least:
            return pd.DataFrame(columns=names)
        rows = []
        for q in quantiles:
            if np.ptp(u) == 0:
                rows.append((*key, q, None, None, None, None, len(u), False))
                continue
            a, b = quantile_line(u, v, q)
            e = student_975(len(u) - 2) * slope_error(u, v, q, a, b)
            pct = [round((math.exp(s) - 1) * 100, 3) if math.isfinite(s) else None for s in (b, b - e, b + e)]
            rows.append((*key, q, *pct, round(a, 5), len(u), True))
        return pd.DataFrame(rows, columns=names)

    return good_pairs(pairs, keys, x, y).groupBy(*keys).applyInPandas(one, schema)
