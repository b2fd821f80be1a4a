"""The estimator for a dense cube of any keys: one object that holds the settings, with a method for each step. All of them take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion import config
from pluvion.operators import events as ev
from pluvion.operators import fit, grid


class Estimator:
    """``keys`` name the series of a cube with the columns t (step), v (amount a step, NULL where missing) and year (civil year of the step)."""

    def __init__(self, keys: list[str], **settings) -> None:
        self.keys, self.settings = keys, config.load(settings)
        self.by_duration = [*keys, "duration_h"]

    def steps(self, hours: int) -> int:
        return config.steps(hours, self.settings["time_res_min"])

    def complete_years(self, cube: DataFrame) -> DataFrame:
        """Years with a share of missing steps over the tolerance are dropped; missing steps of the others become 0."""
        return ev.complete_years(cube, self.keys, "year", "v", 365 * 24 * 60 / self.settings["time_res_min"], self.settings["tolerance"])

    def storms(self, cube: DataFrame, first: int | Column | None = None, last: int | Column | None = None) -> DataFrame:
        """The rows of storms that are long enough and away from the ends of the record; the ends are the cube's own unless given."""
        s = self.settings
        sep = self.steps(s["separation_h"])
        rows = cube.withColumn("v", grid.drizzle_to_zero(F.col("v"), s["min_rain"]))
        inside = ev.in_storms(rows, self.keys, grid.is_wet(F.col("v"), s["min_rain"]), sep)
        first = cube.agg(F.min("t")).scalar() if first is None else first
        last = cube.agg(F.max("t")).scalar() if last is None else last
        return ev.away_from_edges(ev.longer_than(inside, max(1, s["min_event_min"] // s["time_res_min"])), sep, first, last)

    def events(self, cube: DataFrame, **ends) -> DataFrame:
        """keys, duration_h, year (of the peak), oe (mean amount a step over the duration), oe_i, s0, s1."""
        lengths = {self.steps(h): h for h in self.settings["durations_h"]}
        e = ev.peaks(self.storms(cube, **ends), self.keys, list(lengths))
        h = F.coalesce(*[F.when(F.col("duration") == k, v) for k, v in lengths.items()])
        years = cube.select(*self.keys, F.col("t").alias("oe_i"), "year")
        return e.join(years, [*self.keys, "oe_i"]).select(*self.keys, h.alias("duration_h"), "year", "total", (F.col("total").cast("double") / F.col("duration")).alias("oe"), "oe_i", "s0", "s1")

    def maxima(self, events: DataFrame) -> DataFrame:
        return ev.annual_maxima(events, self.by_duration)

    def fits(self, events: DataFrame) -> DataFrame:
        lo, hi = (round(100 * q) for q in self.settings["left_censoring"])
        rate = events.groupBy(*self.by_duration).agg((F.count("*") / F.countDistinct("year")).alias("per_year"))
        return fit.weibull_fit(events, self.by_duration, "oe", lo, hi).join(rate, self.by_duration)

    def levels(self, events: DataFrame) -> DataFrame:
        return fit.return_levels(self.fits(events), self.settings["return_periods"])

    def intervals(self, events: DataFrame, seed_column: str) -> DataFrame:
        s, u = self.settings, self.settings["uncertainty"]
        return fit.seeded_bootstrap(events, self.by_duration, "year", "oe", seed_column, s["return_periods"], u["niter"], u["seed"], tuple(s["left_censoring"]), tuple(u["percentiles"]))

    def summary(self, cube: DataFrame, **ends) -> DataFrame:
        """All steps: one row a key and duration with shape, scale (four digits) and a level for each return period (two digits)."""
        periods = self.settings["return_periods"]
        wide = self.levels(self.events(cube, **ends)).groupBy(*self.by_duration, "shape", "scale").pivot("return_period", periods).agg(F.first("level"))
        return wide.select(*self.by_duration, F.round("shape", 4).alias("shape"), F.round("scale", 4).alias("scale"), *[F.round(str(p), 2).alias(f"rl_{p}") for p in periods])

    def stats(self, cube: DataFrame) -> DataFrame:
        """keys, year, total, and mean, sample deviation and number of the amounts over nothing."""
        wet = F.when(F.col("v") > 0, F.col("v"))
        return cube.groupBy(*self.keys, "year").agg(F.sum("v").alias("total"), F.avg(wet).alias("mean"), F.stddev_samp(wet).alias("sd"), F.count(wet).alias("n_wet"))
