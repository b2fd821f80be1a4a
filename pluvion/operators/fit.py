"""Left-censored Weibull tails, return levels, and their year-block bootstrap."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def weibull_fit(values: DataFrame, keys: list[str], x: str, censor_pct: int = 85, upper_pct: int = 100) -> DataFrame:
    """keys, n, n_used, shape, scale: least squares of ln x on the Weibull plotting position, over the values above the censored share.

    Values are positive and finite, others are left out. Of ``n`` sorted values the first ``n * censor_pct div 100`` are left out, unless that is one
    at most, and those beyond the first ``n * upper_pct / 100``, rounded up. Groups with fewer than two used values, or with equal ones, have no fit and no row. Ties need no order.
    """
    good = values.where((F.col(x) > 0) & (F.col(x) < float("inf")))
    w = W.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(x)), F.count("*").over(w)
    skip = F.expr(f"case when (n * {censor_pct}) div 100 <= 1 then 0 else (n * {censor_pct}) div 100 end")
    upto = F.expr(f"(n * {upper_pct} + 99) div 100")
    used = good.withColumn("i", i).withColumn("n", n).where((F.col("i") > skip) & (F.col("i") <= upto))
    place = F.log(-F.log(1 - F.col("i") / (F.col("n") + 1)))
    out = used.withColumn("_x", F.log(x)).withColumn("_y", place).groupBy(*keys).agg(
        F.first("n").alias("n"), F.count("*").alias("n_used"), F.regr_slope("_x", "_y").alias("_b"), F.regr_intercept("_x", "_y").alias("_a")
    )
    return out.where((F.col("n_used") >= 2) & (F.abs("_b") > 1e-12)).select(*keys, "n", "n_used", (1 / F.col("_b")).alias("shape"), F.exp("_a").alias("scale"))


def return_level(shape: Column, scale: Column, per_year: Column, period: Column) -> Column:
    """The level exceeded once in ``period`` years on average; 0 for a shape or a number per year of 0."""
    inner = -F.log(1 - F.pow(1 - 1 / period, 1 / per_year))
    return F.when((shape == 0) | (per_year == 0), 0.0).otherwise(scale * F.pow(inner, 1 / shape))


def return_levels(fits: DataFrame, periods: list[int]) -> DataFrame:
    """One row per fit and return period. ``fits`` has shape, scale and per_year."""
    rows = fits.withColumn("return_period", F.explode(F.array(*map(F.lit, periods))))
    return rows.withColumn("level", return_level(F.col("shape"), F.col("scale"), F.col("per_year"), F.col("return_period").cast("double")))


#: Multipliers of key, iteration and slot, and of the mixer's rounds.
SPREAD, ROUND, WORD = (40503, 2654435761, 2246822519), 73244475, 0xFFFFFFFF


def stirred(h: np.ndarray) -> np.ndarray:
    """Two rounds of shift, exclusive or and product on 32 bits, which no sum of the inputs passes through unchanged. Products stay below 2**63."""
    for _ in range(2):
        h = ((h ^ (h >> 16)) * ROUND) & WORD
    return h ^ (h >> 16)


def mixed_draws(key_no: int, blocks: int, niter: int) -> np.ndarray:
    """(niter, blocks) numbers of blocks drawn with replacement: a fixed function of key number, iteration and slot, stirred after each of them, that SQL can follow."""
    it, slot = np.arange(niter, dtype=np.int64)[:, None], np.arange(blocks, dtype=np.int64)[None, :]
    h = stirred(np.int64((key_no & WORD) * SPREAD[0] & WORD))
    h = stirred((h + (it + 1) * SPREAD[1]) & WORD)
    return stirred((h + (slot + 1) * SPREAD[2]) & WORD) % blocks


def refitted(x: np.ndarray, block: np.ndarray, draws: np.ndarray, first: Callable[[int], int], last: Callable[[int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of ln x on the plotting position for every row of ``draws`` with two used values at least.

    ``block`` is the number of each value's block. Of n drawn values in order those from ``first(n)`` on and before ``last(n)`` are used. Rows with equally
    many values share their plotting positions and are fitted together, some millions of values at a time.
    """
    order = np.argsort(x, kind="stable")
    ln, block = np.log(x)[order], block[order]
    times = np.zeros((len(draws), draws.shape[1]), dtype=np.int64)
    np.add.at(times, (np.arange(len(draws))[:, None], draws), 1)
    lengths = times @ np.bincount(block, minlength=draws.shape[1])
    slopes, intercepts = [], []
    for n in np.unique(lengths):
        a, b = first(int(n)), last(int(n))
        if b - a < 2:
            continue
        y = np.log(-np.log(1 - np.arange(a + 1, b + 1) / (n + 1)))
        dy = y - y.mean()
        same = np.flatnonzero(lengths == n)
        for part in np.array_split(same, -(-len(same) * int(n) // 4_000_000)):
            used = np.repeat(np.tile(ln, len(part)), times[part][:, block].ravel()).reshape(len(part), n)[:, a:b]
            mean = used.mean(axis=1)
            slope = (used - mean[:, None]) @ dy / (dy @ dy)
            slopes.append(slope)
            intercepts.append(mean - slope * y.mean())
    return (np.concatenate(slopes), np.concatenate(intercepts)) if slopes else (np.empty(0), np.empty(0))


def mixed_interval(x: np.ndarray, block: np.ndarray, key_no: int, per_year: float, periods: list[float], niter: int, censor_pct: int = 85, share: float = 0.05) -> np.ndarray | None:
    """(2, periods) percentiles of one group's return levels over mixed draws of its blocks; None without a fit. Blocks without a good value are drawn too."""
    names, number = np.unique(block, return_inverse=True)
    good = (x > 0) & (x < np.inf)
    skip = lambda n: n * censor_pct // 100 if n * censor_pct // 100 > 1 else 0
    slope, intercept = refitted(x[good], number[good], mixed_draws(key_no, len(names), niter), skip, lambda n: n)
    fit = np.abs(slope) > 1e-12
    if not fit.any():
        return None
    inner = -np.log(1 - (1 - 1 / np.asarray(periods, float)) ** (1 / per_year))
    levels = np.exp(intercept[fit])[:, None] * inner[None, :] ** slope[fit][:, None]
    return np.percentile(levels, [100 * share, 100 * (1 - share)], axis=0)


def bootstrap(events: DataFrame, fits: DataFrame, keys: list[str], block: str, x: str, periods: list[int], niter: int, share: float = 0.05) -> DataFrame:
    """keys, return_period, lo, hi: percentiles of the return levels refitted to drawn year blocks; the number per year stays that of the fit.

    As many blocks as a key has are drawn with replacement ``niter`` times, by its key number ``key_no``, so the draw does not depend on the partitioning.
    A group is the events of one cell and duration; they go over the wire once, not once a draw.
    """
    types = dict(events.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", return_period int, lo double, hi double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band = mixed_interval(pdf[x].to_numpy(float), pdf[block].to_numpy(), int(pdf["key_no"].iloc[0]), float(pdf["per_year"].iloc[0]), periods, niter, share=share)
        rows = [] if band is None else [(*key, p, *band[:, i]) for i, p in enumerate(periods)]
        return pd.DataFrame(rows, columns=[*keys, "return_period", "lo", "hi"])

    rows = events.select(*keys, "key_no", block, x).join(fits.select(*keys, "per_year"), keys)
    return rows.groupBy(*keys).applyInPandas(one, schema)


def seeded_interval(x: np.ndarray, block: np.ndarray, seed: list[int], periods: list[float], niter: int, censor: tuple[float, float] = (0.85, 1.0), bands: tuple[float, float] = (5, 95)) -> np.ndarray | None:
    """(2, periods) percentiles of one group's return levels over drawn blocks; None where no draw has a fit.

    Draws follow a numpy seed: one row of numbers a block, one column a sample. Fits of any finite slope count, as the estimator has them.
    """
    if len(x) == 0:
        return None
    names, number = np.unique(block, return_inverse=True)
    per_year = len(x) / len(names)
    draws = np.random.default_rng(np.random.SeedSequence(seed)).integers(0, len(names), (len(names), niter)).T
    exceed = 1 - (1 - 1 / np.asarray(periods, float)) ** (1 / per_year)

    def first(n: int) -> int:
        f = max(1, int(np.floor(n * censor[0])))
        return 0 if f == 1 else f

    slope, intercept = refitted(x, number, draws, first, lambda n: int(np.ceil(n * censor[1])))
    with np.errstate(over="ignore", invalid="ignore"):
        levels = np.exp(intercept)[:, None] * (-np.log(exceed))[None, :] ** slope[:, None]
    return np.nanpercentile(levels, bands, axis=0).astype(np.float32) if np.isfinite(levels).any() else None


def seeded_bootstrap(events: DataFrame, keys: list[str], block: str, x: str, seed_column: str, periods: list[int], niter: int, base_seed: int = 0, censor: tuple[float, float] = (0.85, 1.0), bands: tuple[float, float] = (5, 95)) -> DataFrame:
    """keys, return_period, lo, hi with draws seeded by ``base_seed`` and the group's raster cell, whatever the partitioning. A group is the events of one cell and duration."""
    good = events.where((F.col(x) > 0) & (F.col(x) < float("inf"))).select(*{*keys, seed_column}, block, x)
    types = dict(events.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", return_period int, lo float, hi float"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band = seeded_interval(pdf[x].to_numpy(float), pdf[block].to_numpy(), [base_seed, int(pdf[seed_column].iloc[0])], periods, niter, censor, bands)
        rows = [] if band is None else [(*key, p, *band[:, i]) for i, p in enumerate(periods)]
        return pd.DataFrame(rows, columns=[*keys, "return_period", "lo", "hi"])

    return good.groupBy(*keys).applyInPandas(one, schema)
