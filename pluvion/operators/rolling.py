"""Totals and averages over trailing days, days without activity included (problem 4)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion.scratch import written
from pluvion.sources.tables import table, valid

SERIES = ["run_id", "cell_id"]


def with_calendar(daily: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Adds a row for every day without activity between the first and the last day of each key; column ``active`` tells them apart.

    ``daily`` has one row per key and active day. Values of added days are NULL.
    """
    w = W.partitionBy(*keys).orderBy(day)
    values = [c for c in daily.columns if c not in (*keys, day)]
    until = F.coalesce(F.lead(day).over(w) - 1, F.col(day))
    return (
        daily.withColumn("_first", F.col(day))
        .withColumn("_until", until)
        .withColumn(day, F.explode(F.sequence("_first", "_until")))
        .withColumn("active", F.col(day) == F.col("_first"))
        .select(*keys, day, "active", *[F.when(F.col(day) == F.col("_first"), F.col(c)).alias(c) for c in values])
    )


def trailing(keys: list[str], day: str, days: int):
    """The frame of the last ``days`` days, this one included, over integer day numbers."""
    return W.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1), 0)


def daily_readings(df: DataFrame, keys: list[str], index: str, value: str, order: str) -> DataFrame:
    """Sum and number of the readings of each day; of rows for the same step only the one with the greatest ``order`` counts.

    The rows of a step are put together on (keys, step), partly before the shuffle, so repeated rows of one series cannot pile up.
    """
    steps = df.where(valid(value) & F.col(index).isNotNull()).groupBy(*keys, index).agg(F.max(F.struct(order, value))[value].cast("double").alias("_v"))
    day = F.floor(F.col(index) / 24).cast("int").alias("day_i")
    return steps.groupBy(*keys, day).agg(F.sum("_v").alias("total"), F.count("_v").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def temperature_rolling(tas: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Mean temperature over the last 7 and 30 days of every series and day, from the first to the last day with a reading.

    ``tas_mean_N`` is over the readings of the last N days; ``active_share_N`` is the number of those days that have a reading over N,
    whatever the record holds. NULL and NaN are no readings; a step loaded again counts once, with the value loaded last.
    """
    daily = daily_readings(tas, SERIES, "t_i", "tas", "loaded_at")
    rows = with_calendar(daily, SERIES, "day_i")
    for n in windows:
        w = trailing(SERIES, "day_i", n)
        rows = rows.withColumn(f"tas_mean_{n}", ratio(F.sum("total").over(w), F.sum("n").over(w)))
        rows = rows.withColumn(f"active_share_{n}", F.count("n").over(w) / F.lit(float(n)))
    return rows.drop("total", "n")


def event_rolling(pr: DataFrame, events: DataFrame, temps: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Events and mean ``t_pre24`` over the last 7 and 30 days of every precipitation series and day.

    An event is one (series, duration, ``oe_i``), repeated rows once. Days run from the first to the last day of the series that has a row or an
    event. ``events_per_day_N`` divides by N also where the record began later.
    """
    day = lambda c: F.floor(F.col(c) / 24).cast("int")
    none = F.lit(None).cast("double")
    days = pr.where(F.col("t_i").isNotNull()).groupBy(*SERIES, day("t_i").alias("day_i")).agg(F.lit(0).cast("bigint").alias("n_events"))
    days = days.select(*SERIES, "day_i", "n_events", none.alias("t_sum"), F.lit(0).cast("bigint").alias("t_n"))
    e = events.where(F.col("oe_i").isNotNull()).select(*SERIES, "duration_h", "oe_i").distinct()
    e = e.groupBy(*SERIES, day("oe_i").alias("day_i")).agg(F.count("*").alias("n_events"))
    e = e.select("*", none.alias("t_sum"), F.lit(0).cast("bigint").alias("t_n"))
    t = temps.where(F.col("oe_i").isNotNull() & valid("t_pre24")).groupBy(*SERIES, "duration_h", "oe_i").agg(F.max("t_pre24").cast("double").alias("t"))
    t = t.groupBy(*SERIES, day("oe_i").alias("day_i")).agg(F.sum("t").alias("t_sum"), F.count("t").alias("t_n"))
    t = t.select(*SERIES, "day_i", F.lit(0).cast("bigint").alias("n_events"), "t_sum", "t_n")
    daily = (
        days.unionByName(e).unionByName(t).groupBy(*SERIES, "day_i")
        .agg(F.sum("n_events").alias("n_events"), F.sum("t_sum").alias("t_sum"), F.sum("t_n").alias("t_n"))
    )
    rows = with_calendar(daily, SERIES, "day_i")
    for n in windows:
        w = trailing(SERIES, "day_i", n)
        total = F.coalesce(F.sum("n_events").over(w), F.lit(0))
        rows = rows.withColumn(f"n_events_{n}", total).withColumn(f"events_per_day_{n}", total / F.lit(float(n)))
        rows = rows.withColumn(f"t_pre24_mean_{n}", ratio(F.sum("t_sum").over(w), F.sum("t_n").over(w)))
    return rows.drop("n_events", "t_sum", "t_n")


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles at six digits (or others, by column), so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else c for c, t in df.dtypes])


def p4_rolling_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temperature_rolling(table(spark, sf_dir, "tas_steps")))


def p4_rolling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr, oe, tt = (table(spark, sf_dir, n) for n in ("pr_hourly", "ordinary_event", "tail_temp"))
    return rounded(event_rolling(pr, oe, tt))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days without activity of the temperature output. The output is written whole, frames and all, and they are read from it."""
    return written(p4_rolling_temperature(spark, sf_dir), "rolling-temperature").where(~F.col("active")).select("run_id", "cell_id", "day_i")


DAYS_SQL = """
step as (select run_id, cell_id, t_i, cast(arg_max(tas, {'l': loaded_at, 'v': tas}) as double) as v from tas_steps
  where tas is not null and not isnan(tas) and t_i is not null group by all),
daily as (select run_id, cell_id, cast(t_i // 24 as integer) as day_i, sum(v) as total, count(*) as n from step group by all),
span as (select run_id, cell_id, min(day_i) as a, max(day_i) as b from daily group by all),
calendar as (select run_id, cell_id, cast(unnest(range(a, b + 1)) as integer) as day_i from span),
filled as (select c.run_id, c.cell_id, c.day_i, d.n is not null as active, d.total, d.n from calendar c left join daily d using (run_id, cell_id, day_i))
"""

SQL = {
    "p4_found": f"with {DAYS_SQL} select run_id, cell_id, day_i from filled where not active",
    "p4_rolling_temperature": f"""with {DAYS_SQL} select run_id, cell_id, day_i, active,
        round(sum(total) over w7 / sum(n) over w7, 6) as tas_mean_7, round(count(n) over w7 / 7.0::double, 6) as active_share_7,
        round(sum(total) over w30 / sum(n) over w30, 6) as tas_mean_30, round(count(n) over w30 / 30.0::double, 6) as active_share_30
        from filled window w7 as (partition by run_id, cell_id order by day_i range between 6 preceding and current row),
        w30 as (partition by run_id, cell_id order by day_i range between 29 preceding and current row)""",
    "p4_rolling_events": """with e as (select distinct run_id, cell_id, duration_h, oe_i from ordinary_event where oe_i is not null),
        t as (select run_id, cell_id, duration_h, oe_i, cast(max(t_pre24) as double) as t from tail_temp
              where oe_i is not null and t_pre24 is not null and not isnan(t_pre24) group by all),
        parts as (
          select distinct run_id, cell_id, cast(t_i // 24 as integer) as day_i, 0 as n_events, null::double as t_sum, 0 as t_n from pr_hourly where t_i is not null
          union all select run_id, cell_id, cast(oe_i // 24 as integer), count(*), null, 0 from e group by 1, 2, 3
          union all select run_id, cell_id, cast(oe_i // 24 as integer), 0, sum(t), count(*) from t group by 1, 2, 3),
        daily as (select run_id, cell_id, day_i, sum(n_events) as n_events, sum(t_sum) as t_sum, sum(t_n) as t_n from parts group by all),
        span as (select run_id, cell_id, min(day_i) as a, max(day_i) as b from daily group by all),
        calendar as (select run_id, cell_id, cast(unnest(range(a, b + 1)) as integer) as day_i from span),
        filled as (select c.run_id, c.cell_id, c.day_i, d.n_events is not null as active, n_events, t_sum, t_n
                   from calendar c left join daily d using (run_id, cell_id, day_i))
        select run_id, cell_id, day_i, active,
          cast(coalesce(sum(n_events) over w7, 0) as bigint) as n_events_7, round(coalesce(sum(n_events) over w7, 0) / 7.0::double, 6) as events_per_day_7,
          round(sum(t_sum) over w7 / nullif(sum(t_n) over w7, 0), 6) as t_pre24_mean_7,
          cast(coalesce(sum(n_events) over w30, 0) as bigint) as n_events_30, round(coalesce(sum(n_events) over w30, 0) / 30.0::double, 6) as events_per_day_30,
          round(sum(t_sum) over w30 / nullif(sum(t_n) over w30, 0), 6) as t_pre24_mean_30
        from filled window w7 as (partition by run_id, cell_id order by day_i range between 6 preceding and current row),
        w30 as (partition by run_id, cell_id order by day_i range between 29 preceding and current row)""",
}

QUERIES = {"p4_found": p4_found, "p4_rolling_temperature": p4_rolling_temperature, "p4_rolling_events": p4_rolling_events}
