"""Readings that cannot be true (problem 6): impossible, far outside, or stuck.

Every reading is judged against its source (model, for events model and duration). What is taken as normal of a source:

* the residual of a reading is its distance from the seasonal level: for precipitation and events the median of the source in the same
  calendar month, for temperature the median of the readings at the same hour of the three days before and after;
* a generalised Pareto tail is fitted to the residuals over a high threshold, by matching quantiles that a small share of faults does not move,
  and gives the cutoff that a normal reading exceeds with a fixed small risk;
* the longest unbroken stretch of equal readings that more than one in five hundred of its stretches reach; one longer by more than two is stuck.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pluvion.scratch import written
from pluvion.sources.tables import table, valid

#: What a reading can be at all. World records of hourly rain and of air temperature lie inside.
POSSIBLE = {"pr_hourly": (0.0, 1000.0), "tas_steps": (150.0, 350.0), "ordinary_event": (0.0, 1000.0)}
#: Threshold and the two quantiles above it to which the tail is fitted.
LEVELS = {"pr_hourly": (0.99, 0.995, 0.999), "tas_steps": (0.9, 0.97, 0.995), "ordinary_event": (0.9, 0.97, 0.995)}
RISK, ACCURACY = 1e-5, 10_000
STRETCH_SHARE, STRETCH_OVER = 1 / 500, 2
SERIES = ["run_id", "cell_id", "duration_h"]
FOUND = ["tbl", "run_id", "cell_id", "duration_h", "t_i"]


def pareto_cutoff(u: float, a: float, b: float, levels: tuple[float, float, float], risk: float) -> float | None:
    """The value exceeded with probability ``risk`` under the Pareto tail through three quantiles. NULL where they are not distinct."""
    if None in (u, a, b) or not u < a < b:
        return None
    e1, e2 = (1 - levels[1]) / (1 - levels[0]), (1 - levels[2]) / (1 - levels[0])
    ratio = (b - u) / (a - u)
    lo, hi = -5.0, 5.0
    for _ in range(80):
        xi = (lo + hi) / 2 or 1e-9
        lo, hi = (xi, hi) if (e2**-xi - 1) / (e1**-xi - 1) < ratio else (lo, xi)
    return u + (a - u) * ((risk / (1 - levels[0])) ** -xi - 1) / (e1**-xi - 1)


def middle(c: Column) -> Column:
    """The median of a short array without NULLs; NULL of an empty one."""
    s = F.sort_array(c)
    n = F.size(c)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def readings(spark: SparkSession, sf_dir: str, tbl: str) -> DataFrame:
    """source keys, series keys, t_i, ord, v, month: the distinct numbers of a table, rows repeated for a step put together before the shuffle."""
    df = table(spark, sf_dir, tbl)
    value = {"pr_hourly": "pr", "tas_steps": "tas", "ordinary_event": "oe"}[tbl]
    at, order = ("oe_i", "from_i") if tbl == "ordinary_event" else ("t_i", "t_i")
    duration = F.col("duration_h").cast("int") if tbl == "ordinary_event" else F.lit(0)
    runs = table(spark, sf_dir, "sim_run").select(F.col("run_id").alias("_run"), "model", "t0")
    rows = df.where(valid(value) & F.col(at).isNotNull()).select(
        "run_id", "cell_id", duration.alias("duration_h"), F.col(at).alias("t_i"), F.col(order).alias("ord"), F.col(value).cast("double").alias("v")
    ).distinct()
    # the month of t0 plus t_i hours, as ts has it
    month = F.month(F.timestamp_seconds(F.unix_seconds(F.col("t0").cast("timestamp")) + F.col("t_i").cast("bigint") * 3600))
    return rows.join(runs, F.col("run_id") == F.col("_run"), "left").select("model", "run_id", "cell_id", "duration_h", "t_i", "ord", "v", month.alias("month"))


def judged(df: DataFrame, tbl: str) -> DataFrame:
    """model, series keys, t_i, v, month, stretch (length of its stretch of equal readings) and, for temperature, r (residual; NULL if impossible or alone).

    The stretches come first: they need a series together, and that serves the hours of the day of a series as well.
    """
    w = W.partitionBy(*SERIES).orderBy("ord", "t_i", "v")
    df = df.withColumn("_new", F.when(F.col("v") == F.lag("v").over(w), 0).otherwise(1))
    df = df.withColumn("_no", F.sum("_new").over(w)).withColumn("stretch", F.count("*").over(W.partitionBy(*SERIES, "_no")).cast("int")).drop("_new", "_no")
    columns = ["model", *SERIES, "t_i", "v", "month", "stretch"]
    if tbl == "tas_steps":
        same_hour = W.partitionBy(*SERIES, "_hour").orderBy("t_i", "v")
        x = F.when(possible(tbl), F.col("v"))
        near = F.array_compact(F.array(*[f(x, k).over(same_hour) for k in (1, 2, 3) for f in (F.lag, F.lead)]))
        df = df.withColumn("_hour", F.col("t_i") % 24).withColumn("_near", near).withColumn("r", F.abs(x - middle(F.col("_near"))))
        columns.append("r")
    return df.select(*columns)


def possible(tbl: str) -> Column:
    return F.col("v").between(*POSSIBLE[tbl])


def seasonal(df: DataFrame, tbl: str) -> DataFrame:
    """r for precipitation and events: the value over the median of its source in the calendar month. Zeros have no residual."""
    if tbl == "tas_steps":
        return df
    wet = F.when(possible(tbl) & (F.col("v") > 0), F.col("v"))
    level = df.groupBy(F.col("model").alias("_m"), F.col("duration_h").alias("_d"), F.col("month").alias("_month")).agg(F.percentile_approx(wet, 0.5, 1000).alias("_level"))
    level = written(level, "seasonal-level")
    on = F.col("model").eqNullSafe(F.col("_m")) & (F.col("duration_h") == F.col("_d")) & F.col("month").eqNullSafe(F.col("_month"))
    return df.join(level, on, "left").withColumn("r", wet - F.col("_level")).drop("_m", "_d", "_month", "_level")


def cutoffs(df: DataFrame, tbl: str) -> DataFrame:
    """One row per source: model, duration_h, cutoff (of the residual), longest (stretch still normal). Both from aggregates of all its readings."""
    levels = LEVELS[tbl]

    @F.pandas_udf(T.DoubleType())
    def fit(q: pd.Series) -> pd.Series:
        return pd.Series([pareto_cutoff(*x, levels, RISK) if x is not None and len(x) else None for x in q], dtype=float)

    source = ["model", "duration_h"]
    tail = df.groupBy(*source).agg(F.percentile_approx("r", list(levels), ACCURACY).alias("q")).select(*source, fit("q").alias("cutoff"))
    # a stretch of n readings has n rows
    runs = df.where((F.col("v") != 0) | (tbl == "tas_steps")).groupBy(*source, "stretch").agg((F.count("*") / F.col("stretch")).alias("n"))
    w = W.partitionBy(*source)
    reach = F.sum("n").over(w.orderBy(F.desc("stretch")))
    runs = runs.withColumn("share", reach / F.sum("n").over(w)).where(F.col("share") > STRETCH_SHARE)
    longest = runs.groupBy(F.col("model").alias("_m"), F.col("duration_h").alias("_d")).agg(F.max("stretch").alias("longest"))
    on = F.col("model").eqNullSafe(F.col("_m")) & F.col("duration_h").eqNullSafe(F.col("_d"))
    return tail.join(longest, on, "left").select(F.col("model").alias("_m"), F.col("duration_h").alias("_d"), "cutoff", "longest")


def faulty(spark: SparkSession, sf_dir: str, tbl: str) -> DataFrame:
    """tbl, series keys, t_i, v and the three verdicts of every faulty reading of one table.

    NULL, NaN and zero precipitation are never faulty. Readings of a run that ``sim_run`` does not hold are judged as one source of their own.
    Where a source has too few distinct values for a tail, only the other two rules apply. An empty table gives no rows.
    """
    df = seasonal(written(judged(readings(spark, sf_dir, tbl), tbl), f"judged-{tbl}"), tbl)
    cut = written(cutoffs(df, tbl), f"cutoffs-{tbl}")
    on = F.col("model").eqNullSafe(F.col("_m")) & (F.col("duration_h") == F.col("_d"))
    zero = (F.col("v") == 0) & F.lit(tbl != "tas_steps")
    verdicts = (
        df.join(cut, on, "left")
        .select(
            F.lit(tbl).alias("tbl"), *SERIES, "t_i", "v",
            (~possible(tbl)).alias("impossible"),
            F.coalesce(F.col("r") > F.col("cutoff"), F.lit(False)).alias("spike"),
            F.coalesce(F.col("stretch") > F.col("longest") + STRETCH_OVER, F.lit(False)).alias("stuck"),
        )
    )
    return verdicts.where((F.col("impossible") | F.col("spike") | F.col("stuck")) & ~zero)


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every faulty reading of the three tables with its verdicts, once for each distinct value at its step."""
    parts = [faulty(spark, sf_dir, t) for t in POSSIBLE]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_faults(spark, sf_dir).select(*FOUND).distinct()


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_faults": p6_faults}
