"""Percentile thresholds and tail classes of events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERCENTS = (85, 90, 95, 99)


def thresholds_higher(events: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, t85 .. t99: the value at the 0-based place ``ceil((n - 1) * q)`` of the sorted values. Ties need no order. NULLs are left out."""
    w = W.partitionBy(*keys)
    rows = events.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(x))).withColumn("_n", F.count("*").over(w))
    at = lambda p: F.expr(f"1 - (-(_n - 1) * {p}) div 100 + case when ((_n - 1) * {p}) % 100 > 0 then 1 else 0 end")
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == at(p), F.col(x))).alias(f"t{p}") for p in PERCENTS])


def thresholds_linear(events: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, t85 .. t99 by linear interpolation."""
    p = F.percentile(x, F.array(*[F.lit(p / 100) for p in PERCENTS]))
    return events.groupBy(*keys).agg(p.alias("_p")).select(*keys, *[F.col("_p")[i].alias(f"t{p}") for i, p in enumerate(PERCENTS)])


def classified(events: DataFrame, thresholds: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Events at or over the lowest threshold, with ``pctl_class``: the highest one reached."""
    rows = events.join(thresholds, keys)
    c = F.lit(None).cast("int")
    for p in PERCENTS:
        c = F.when(F.col(x) >= F.col(f"t{p}"), p).otherwise(c)
    return rows.withColumn("pctl_class", c).where(F.col("pctl_class").isNotNull()).drop(*[f"t{p}" for p in PERCENTS])


def cumulative_means(events: DataFrame, thresholds: DataFrame, keys: list[str], x: str, covariate: str) -> DataFrame:
    """keys, tail, mean_oe, mean_covariate, n_events: an event over the 99th percentile counts in all four tails. The thresholds stay one row per key."""
    tails = F.array(*[F.struct(F.lit(f"p{p}").alias("tail"), F.col(f"t{p}").alias("at")) for p in PERCENTS])
    rows = events.join(thresholds, keys).withColumn("_t", F.explode(F.filter(tails, lambda s: s["at"] <= F.col(x))))
    return rows.groupBy(*keys, F.col("_t.tail").alias("tail")).agg(F.avg(x).alias("mean_oe"), F.avg(covariate).alias("mean_covariate"), F.count("*").alias("n_events"))
