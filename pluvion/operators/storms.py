"""Storms in hourly precipitation, and their place beside the event tables (problem 2)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion.sources.tables import table, valid
from pluvion.streaming.storms import replay_sessions

SERIES = ["run_id", "cell_id"]


def storms(spark: SparkSession, sf_dir: str, wet: float = 0.1, gap: int = 24) -> DataFrame:
    """One row per storm of ``pr_hourly``: run_id, cell_id, from_i, to_i, n_active.

    An hour is wet when some row of it has ``pr >= wet``; NULL and NaN are not wet. An empty table gives no rows.
    """
    return replay_sessions(table(spark, sf_dir, "pr_hourly"), valid("pr") & (F.col("pr") >= F.lit(wet)), SERIES, "t_i", gap)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storms(spark, sf_dir).select("run_id", "cell_id", "from_i", "to_i")


def p2_storm_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every storm with its length, number of wet hours, and the events and tail events whose peak lies in it.

    Events are matched as of their peak: storms and peaks of a series are put in one order and every peak takes the last storm that
    began before it. No pair of storm and event is formed.
    """
    s = storms(spark, sf_dir).withColumn("kind", F.lit(0)).withColumn("at", F.col("from_i"))
    peaks = (
        table(spark, sf_dir, "ordinary_event").where(F.col("oe_i").isNotNull()).select(*SERIES, F.col("oe_i").alias("at")).distinct()
        .withColumn("kind", F.lit(1)).withColumn("storm_len_h", F.lit(None).cast("float"))
    )
    tails = (
        table(spark, sf_dir, "tail_metric").where(F.col("oe_i").isNotNull()).groupBy(*SERIES, F.col("oe_i").alias("at"))
        .agg(F.max("storm_len_h").alias("storm_len_h")).withColumn("kind", F.lit(2))
    )
    w = W.partitionBy(*SERIES).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = s.unionByName(peaks.unionByName(tails), allowMissingColumns=True)
    placed = both.select(
        *SERIES, "kind", "at", "storm_len_h", "n_active",
        F.last("from_i", ignorenulls=True).over(w).alias("from_i"), F.last("to_i", ignorenulls=True).over(w).alias("to_i"),
    )
    inside = (F.col("kind") > 0) & (F.col("at") <= F.col("to_i"))
    return (
        placed.where(F.col("from_i").isNotNull())
        .groupBy(*SERIES, "from_i", "to_i")
        .agg(
            (F.first("to_i") - F.first("from_i") + 1).alias("length_h"),
            F.max("n_active").alias("n_wet_hours"),
            F.count(F.when(inside & (F.col("kind") == 1), 1)).alias("n_event_peaks"),
            F.count(F.when(inside & (F.col("kind") == 2), 1)).alias("n_tail_peaks"),
            F.max(F.when(inside, F.col("storm_len_h"))).alias("storm_len_h"),
        )
    )


WET_STORMS_SQL = """
wet as (select distinct run_id, cell_id, t_i from pr_hourly where pr >= 0.1 and not isnan(pr) and run_id is not null and cell_id is not null and t_i is not null),
marked as (select *, case when t_i - lag(t_i) over (partition by run_id, cell_id order by t_i) <= 24 then 0 else 1 end as fresh from wet),
numbered as (select *, sum(fresh) over (partition by run_id, cell_id order by t_i) as no from marked),
storm as (select run_id, cell_id, min(t_i) as from_i, max(t_i) as to_i, cast(count(*) as integer) as n_active from numbered group by run_id, cell_id, no)
"""

SQL = {
    "p2_found": f"with {WET_STORMS_SQL} select run_id, cell_id, from_i, to_i from storm",
    "p2_storm_lengths": f"""with {WET_STORMS_SQL},
        peak as (select distinct run_id, cell_id, oe_i from ordinary_event where oe_i is not null),
        tail as (select run_id, cell_id, oe_i, max(storm_len_h) as len from tail_metric where oe_i is not null group by 1, 2, 3)
        select s.run_id, s.cell_id, s.from_i, s.to_i, s.to_i - s.from_i + 1 as length_h, s.n_active as n_wet_hours,
          (select count(*) from peak p where p.run_id = s.run_id and p.cell_id = s.cell_id and p.oe_i between s.from_i and s.to_i) as n_event_peaks,
          (select count(*) from tail p where p.run_id = s.run_id and p.cell_id = s.cell_id and p.oe_i between s.from_i and s.to_i) as n_tail_peaks,
          (select max(len) from tail p where p.run_id = s.run_id and p.cell_id = s.cell_id and p.oe_i between s.from_i and s.to_i) as storm_len_h
        from storm s""",
}

QUERIES = {"p2_found": p2_found, "p2_storm_lengths": p2_storm_lengths}
