"""The event-statistics chain over the hourly series of the runs: ``pr_hourly``, ``tas_steps``, ``grid_cell`` and ``sim_run``, in the stated output schemas.

A series is one run's precipitation in one cell; the run's name gives model, period and window size. The cells of a run lie apart from each other, so its series
are taken as the means over its window. An hour that is not stored is dry; one stored as NULL or NaN, or with a reading that no gauge can hold, is missing, and
stays missing through drizzle, storms and moving sums. Of rows for the same hour the one loaded last counts. Amounts are whole ten-thousandths of a mm/h.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion import config
from pluvion.functions import calendar
from pluvion.operators import events as ev
from pluvion.operators import fit, grid, scaling, tails
from pluvion.operators.faults import POSSIBLE
from pluvion.operators.rolling import rounded
from pluvion.scratch import written
from pluvion.sources.tables import table, valid

SERIES = ["run_id", "cell_id"]
KEY = [*SERIES, "duration_h"]
UNIT = 10_000


def last_loaded(df: DataFrame, value: str, most: tuple[float, float]) -> DataFrame:
    """run_id, cell_id, t, x: the value of each step as loaded last, NULL where it is missing or lies outside ``most``."""
    rows = df.where(F.col("t_i").isNotNull()).groupBy(*SERIES, F.col("t_i").alias("t")).agg(F.max(F.struct("loaded_at", value)).alias("_l"))
    x = F.col(f"_l.{value}")
    return rows.select(*SERIES, "t", F.when(valid(x) & (x.cast("double") >= most[0]) & (x.cast("double") <= most[1]), x.cast("double")).alias("x"))


def hours(spark: SparkSession, d: str, least: float) -> DataFrame:
    """run_id, cell_id, t, v: the stored hours. Amounts under ``least``, negative ones too, are 0."""
    x = last_loaded(table(spark, d, "pr_hourly"), "pr", (-float("inf"), POSSIBLE["pr_hourly"][1]))
    return x.select(*SERIES, "t", F.bround(grid.drizzle_to_zero(F.col("x"), least) * UNIT).cast("bigint").alias("v"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sim_run").select("run_id", "model", "period_name", "ws", "cal_name", "t0", "n_steps", "time_res_min", "tas_dt_h")


def storm_rows(spark: SparkSession, d: str, s: dict) -> DataFrame:
    """Every hour of every storm that is long enough and lies away from the ends of its run's record: series, no, s0, s1, t, v. One shuffle by series.

    Storms are found on the stored hours alone; the dry hours between two of them are made up only inside a storm.
    """
    sep, steps = s["separation_h"], s["min_event_min"] // s["time_res_min"]
    inside = ev.in_storms(hours(spark, d, s["min_rain"]), SERIES, grid.is_wet(F.col("v"), 0), sep)
    inside = ev.longer_than(inside, steps).join(runs(spark, d).select("run_id", "n_steps"), "run_id")
    inside = ev.away_from_edges(inside, sep, 0, F.col("n_steps") - 1)
    return ev.filled(inside, SERIES)


def events(spark: SparkSession, d: str, s: dict = config.DEFAULTS) -> DataFrame:
    """The ordinary events with their run: series, model, period_name, ws, lat, lon, y, x, duration_h, year, total, oe (mm/h), oe_i, from_i, to_i."""
    lengths = {config.steps(h, s["time_res_min"]): h for h in s["durations_h"]}
    e = ev.peaks(storm_rows(spark, d, s), SERIES, list(lengths))
    r, c = runs(spark, d), table(spark, d, "grid_cell").select("cell_id", "lat", "lon", "y", "x")
    h = F.coalesce(*[F.when(F.col("duration") == k, v) for k, v in lengths.items()])
    year = calendar.civil_year(F.col("oe_i"), F.col("t0"), F.col("time_res_min"), F.col("cal_name"))
    e = e.join(r, "run_id").join(c, "cell_id")
    oe = F.col("total").cast("double") / (F.col("duration") * F.lit(float(UNIT)))
    return e.select(
        *SERIES, "model", "period_name", "ws", "lat", "lon", "y", "x", h.cast("tinyint").alias("duration_h"), year.cast("smallint").alias("year"), "total", oe.alias("oe"), "oe_i",
        F.col("s0").alias("from_i"), F.col("s1").alias("to_i"),
    )


#: The columns of the event and maximum tables.
STATED = [*SERIES, "lat", "lon", "duration_h", "year", "oe", "oe_i", "from_i", "to_i"]


def stated(e: DataFrame) -> DataFrame:
    return e.withColumn("oe", F.col("oe").cast("float")).select(*STATED)


def maxima(e: DataFrame) -> DataFrame:
    return ev.annual_maxima(e.withColumnRenamed("from_i", "s0"), KEY).withColumnRenamed("s0", "from_i")


def fits(e: DataFrame, s: dict = config.DEFAULTS, keys: list[str] = KEY) -> DataFrame:
    """keys, n, n_used, shape, scale, per_year (events a year that has some)."""
    lo, hi = (round(100 * q) for q in s["left_censoring"])
    good = e.where((F.col("oe") > 0) & (F.col("oe") < float("inf")))
    per_year = good.groupBy(*keys).agg((F.count("*") / F.countDistinct("year")).alias("per_year"))
    return fit.weibull_fit(good, keys, "oe", lo, hi).join(per_year, keys)


def parameters(e: DataFrame, s: dict = config.DEFAULTS) -> DataFrame:
    """The fits with the mean annual maximum; totals are added as whole numbers, so that it does not depend on the order of rows."""
    mam = maxima(e).groupBy(*KEY).agg((F.sum("total").cast("double") / (F.count("total") * F.first("duration_h") * F.lit(60.0 / s["time_res_min"] * UNIT))).alias("mam"))
    return fits(e, s).join(mam, KEY)


def temperatures(spark: SparkSession, d: str) -> DataFrame:
    """run_id, cell_id, i (step of the run's temperature), v: thousandths of a degree C, as loaded last; NULL where missing."""
    x = last_loaded(table(spark, d, "tas_steps"), "tas", POSSIBLE["tas_steps"])
    x = x.join(runs(spark, d).select("run_id", F.col("tas_dt_h").cast("int").alias("dt")), "run_id").where(F.col("t") % F.col("dt") == 0)
    return x.select(*SERIES, F.expr("t div dt").cast("int").alias("i"), "dt", (F.bround(F.col("x") * 1000) - 273_150).cast("bigint").alias("v"))


def preceding_temperatures(spark: SparkSession, d: str, s: dict) -> DataFrame:
    """run_id, cell_id, i, pre: the mean over the steps of the hours before step ``i``, where all of them are there."""
    t = temperatures(spark, d)
    # frames of one length for each step of temperature that a run may have
    hours_before = s["temp_window_h"]
    w = W.partitionBy(*SERIES).orderBy("i")
    pre = F.lit(None).cast("double")
    for dt in (1, 2, 3, 4, 6, 8, 12, 24):
        if hours_before % dt == 0:
            n = hours_before // dt
            frame = w.rangeBetween(-(n - 1), 0)
            pre = F.when((F.col("dt") == dt) & (F.count("v").over(frame) == n), F.sum("v").over(frame) / F.lit(1000.0 * n)).otherwise(pre)
    return t.select(*SERIES, (F.col("i") + 1).cast("int").alias("i"), pre.alias("pre")).where(F.col("pre").isNotNull())


def temperature_cells(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    """run_id, cell_id, tas_cell: for each series the cell nearest on both axes of those that have temperatures in its run."""
    cells = table(spark, d, "grid_cell").select("cell_id", "lat", "lon", "y", "x")
    has = written(table(spark, d, "tas_steps").select(*SERIES).distinct().join(cells, "cell_id"), "temperature-cells")
    for c, i in (("lat", "y"), ("lon", "x")):
        points = grid.nearest_of(points, has.select("run_id", F.col(c).alias("coord"), F.col(i).alias("i")).distinct(), ["run_id"], c, f"_{i}")
    near = has.select("run_id", F.col("cell_id").alias("tas_cell"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    return points.join(near, ["run_id", "_y", "_x"]).select(*SERIES, "tas_cell")


def pairs(spark: SparkSession, d: str, e: DataFrame, s: dict = config.DEFAULTS) -> DataFrame:
    """The events with ``t_pre24``, the mean temperature (deg C) before their peak; events without one are left out."""
    where = temperature_cells(spark, d, e.select(*SERIES, "lat", "lon").distinct())
    dt = runs(spark, d).select("run_id", F.col("tas_dt_h").cast("int").alias("dt"))
    pre = preceding_temperatures(spark, d, s).withColumnRenamed("cell_id", "tas_cell").withColumnRenamed("pre", "t_pre24")
    asked = e.join(where, SERIES).join(dt, "run_id").withColumn("i", F.expr("oe_i div dt").cast("int"))
    return asked.join(pre, ["run_id", "tas_cell", "i"]).drop("tas_cell", "i", "dt").where((F.col("oe") > 0) & (F.col("oe") < float("inf")))


def tail_events(p: DataFrame) -> DataFrame:
    """Events at or over the 85th percentile of their cell and duration, with the highest tail that they reach."""
    return tails.classified(p, tails.thresholds_linear(p, KEY, "oe"), KEY, "oe").withColumn("tail", F.concat(F.lit("p"), F.col("pctl_class")))


def tail_means(p: DataFrame) -> DataFrame:
    return tails.cumulative_means(p, tails.thresholds_linear(p, KEY, "oe"), KEY, "oe", "t_pre24").withColumnRenamed("mean_covariate", "mean_t_pre24")


def scaling_table(p: DataFrame, s: dict = config.DEFAULTS, keys: list[str] = KEY) -> DataFrame:
    return scaling.quantile_regression(p, keys, "t_pre24", "oe", s["quantiles"], s["min_events_regression"])


def single_cell_metrics(e: DataFrame, s: dict = config.DEFAULTS) -> DataFrame:
    """The metrics of tail events whose window is one cell: nothing is spread, and there are no shares of cells."""
    t = tails.classified(e, tails.thresholds_higher(e, KEY, "total"), KEY, "total").where(F.col("ws") == 1)
    zero, none = F.when(F.col("oe") >= s["min_rain"], 0.0).cast("float"), F.lit(None).cast("float")
    length = ((F.col("to_i") - F.col("from_i") + 1) * (s["time_res_min"] / 60)).cast("float")
    shares = [none.alias(config.column("a", f)) for f in s["a_fractions"]] + [none.alias(config.column("pca", a)) for a in s["pca_alphas"]]
    return t.select(*SERIES, "lat", "lon", "duration_h", F.col("pctl_class").cast("tinyint").alias("pctl_class"), "oe_i", F.col("oe").cast("float").alias("oe"), length.alias("storm_len_h"), zero.alias("cv"), zero.alias("rg_norm"), *shares)


def stored_events(spark: SparkSession, d: str, s: dict = config.DEFAULTS) -> DataFrame:
    """The stored event table, repeated rows once, of known runs, cells and durations, positive and such as a gauge can hold."""
    e = table(spark, d, "ordinary_event").where(F.col("duration_h").isin(s["durations_h"]) & (F.col("oe") > 0) & (F.col("oe") <= POSSIBLE["ordinary_event"][1]) & F.col("year").isNotNull())
    e = e.select(*SERIES, "duration_h", "year", F.col("oe").cast("double").alias("oe"), "oe_i").distinct()
    cells = table(spark, d, "grid_cell").select("cell_id", "y", "x")
    return e.join(table(spark, d, "sim_run").select("run_id", "model", "period_name"), "run_id").join(cells, "cell_id")


def bootstrapped(e: DataFrame, cells: DataFrame, s: dict = config.DEFAULTS) -> DataFrame:
    """Intervals of return levels: a cell's events of all runs of a model and period, with the years of each run as blocks.

    ``e`` has run_id, model, period_name, cell_id, y, x, duration_h, year and oe. Draws are seeded by duration, raster row (from the north) and column.
    """
    ny, nx = (cells.agg((F.max(c) + 1).cast("bigint")).scalar() for c in ("y", "x"))
    di = F.array_position(F.array(*[F.lit(h).cast("tinyint") for h in s["durations_h"]]), F.col("duration_h")) - 1
    e = e.withColumn("_ny", ny).withColumn("_nx", nx).withColumn("raster_no", (di * F.col("_ny") + F.col("_ny") - 1 - F.col("y")) * F.col("_nx") + F.col("x"))
    block = (F.col("run_id").cast("bigint") * 10_000 + F.col("year")).alias("block")
    u = s["uncertainty"]
    keys = ["model", "period_name", "cell_id", "duration_h"]
    return fit.seeded_bootstrap(e.select(*keys, "raster_no", "oe", block), keys, "block", "oe", "raster_no", s["return_periods"], u["niter"], u["seed"], tuple(s["left_censoring"]), tuple(u["percentiles"]))


def subset(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """The rows inside a box, ends included; the filter reaches the scan."""
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return written(events(spark, d), "series-events")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return written(pairs(spark, d, _shared(spark, d)), "series-pairs")


def q_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.return_levels(fits(_shared(spark, d)), config.DEFAULTS["return_periods"]).select(*KEY, "return_period", "level"))


def q_stored_levels(spark: SparkSession, d: str) -> DataFrame:
    """Return levels of the stored events of each model, period, cell and duration; a year of each run is a year."""
    keys = ["model", "period_name", "cell_id", "duration_h"]
    e = stored_events(spark, d).withColumn("year", F.col("run_id") * 10_000 + F.col("year"))
    return rounded(fit.return_levels(fits(e, keys=keys), config.DEFAULTS["return_periods"]).select(*keys, "return_period", "level"))


def q_storm_years(spark: SparkSession, d: str) -> DataFrame:
    """Storms of each series by the year in which they begin and by that in which they end."""
    s = config.DEFAULTS
    rows = storm_rows(spark, d, s).select(*SERIES, "s0", "s1").distinct().join(runs(spark, d), "run_id")
    year = lambda c: calendar.civil_year(F.col(c), F.col("t0"), F.col("time_res_min"), F.col("cal_name"))
    both = rows.select(*SERIES, F.explode(F.array(F.struct(year("s0").alias("year"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(year("s1").alias("year"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("z"))
    return both.groupBy(*SERIES, F.col("z.year").alias("year")).agg(F.sum("z.a").alias("n_begun"), F.sum("z.b").alias("n_ended"))


def q_axis(spark: SparkSession, d: str) -> DataFrame:
    """The time axis of each run from its description in words: origin, step in seconds, and the time of the last step."""
    r = table(spark, d, "sim_run").withColumn("units", F.concat(F.lit("minutes since "), F.date_format("t0", "yyyy-MM-dd HH:mm:ss")))
    last = calendar.at((F.col("n_steps") - 1) * F.col("time_res_min"), F.col("units"))
    return r.select("run_id", calendar.origin(F.col("units")).alias("origin"), (calendar.unit_seconds(F.col("units")) * F.col("time_res_min")).alias("step_s"), last.alias("last_ts"))


def stored_tails(spark: SparkSession, d: str) -> DataFrame:
    """The stored tail events with their temperature, repeated rows once. A run's tail events of one duration are bounded by its grid."""
    t = table(spark, d, "tail_temp").where(valid("t_pre24") & (F.col("oe") > 0) & (F.col("oe") < float("inf")))
    return t.select("run_id", "cell_id", "duration_h", "oe_i", F.col("oe").cast("double").alias("oe"), F.col("t_pre24").cast("double").alias("t_pre24")).distinct()


def losses(p: DataFrame, keys: list[str], s: dict = config.DEFAULTS) -> DataFrame:
    """Every regression line held against lines a little above, below and turned either way: whether none of them has a lower check loss.

    Intercepts and slopes are rounded in the tables, so the lines are fitted again here.
    """
    lines = scaling.quantile_lines(p, keys, "t_pre24", "oe", s["quantiles"], s["min_events_regression"])
    turns = F.array(*[F.struct(F.lit(float(da)).alias("da"), F.lit(float(db)).alias("db")) for da, db in ((0, 0), (-0.01, 0), (0.01, 0), (0, -0.001), (0, 0.001))])
    rows = p.select(*keys, F.col("t_pre24").alias("x"), F.log("oe").alias("z")).join(lines, keys).withColumn("t", F.explode(turns))
    # turned about the middle of the covariate, so that small turns stay small
    r = F.col("z") - (F.col("a") + F.col("t.da")) - F.col("b") * F.col("x") - F.col("t.db") * (F.col("x") - F.col("mid"))
    loss = F.sum(F.when(r >= 0, F.col("q") * r).otherwise((F.col("q") - 1) * r))
    at = rows.groupBy(*keys, F.col("q").alias("quantile"), "t").agg(loss.alias("loss"), F.count("*").alias("n_events"))
    here = F.max(F.when((F.col("t.da") == 0) & (F.col("t.db") == 0), F.col("loss")))
    return at.groupBy(*keys, "quantile").agg(F.max("n_events").alias("n_events"), (here <= F.min("loss") + 1e-9).alias("lowest"))


#: A box over part of the grid.
BOX = ((43.5, 44.0), (5.7, 6.4))

QUERIES = {
    "series_hours": lambda s, d: hours(s, d, config.DEFAULTS["min_rain"]),
    "series_events": lambda s, d: stated(events(s, d)).withColumn("oe", F.round(F.col("oe").cast("double"), 6)),
    "series_maxima": lambda s, d: stated(maxima(_shared(s, d))).withColumn("oe", F.round(F.col("oe").cast("double"), 6)),
    "series_parameters": lambda s, d: rounded(parameters(_shared(s, d)), mam=9),
    "series_levels": q_levels,
    "series_storm_years": q_storm_years,
    "series_pairs": lambda s, d: rounded(pairs(s, d, _shared(s, d)).select(*KEY, "oe_i", "oe", "t_pre24"), 9),
    "series_tail_events": lambda s, d: rounded(tail_events(_pairs(s, d)).select(*KEY, "oe_i", "oe", "t_pre24", "tail"), 9),
    "series_tail_means": lambda s, d: rounded(tail_means(_pairs(s, d)), 12),
    "series_scaling": lambda s, d: scaling_table(_pairs(s, d)),
    "series_scaling_losses": lambda s, d: losses(_pairs(s, d), KEY),
    "tail_scaling": lambda s, d: scaling_table(stored_tails(s, d), keys=["run_id", "duration_h"]),
    "tail_scaling_losses": lambda s, d: losses(written(stored_tails(s, d), "stored-tails"), ["run_id", "duration_h"]),
    "series_metrics_ws1": lambda s, d: single_cell_metrics(_shared(s, d)).withColumn("oe", F.round(F.col("oe").cast("double"), 6)),
    "stored_levels": q_stored_levels,
    "stored_bootstrap": lambda s, d: bootstrapped(stored_events(s, d), table(s, d, "grid_cell")),
    "stored_subset": lambda s, d: subset(table(s, d, "ordinary_event"), *BOX).groupBy("run_id", "duration_h").agg(F.count("*").alias("n"), F.count("oe").alias("n_oe")),
    "run_axis": q_axis,
    "grid_transform": lambda s, d: rounded(grid.geotransform(table(s, d, "grid_cell")), 9),
}

# --- the same in SQL ---

_S = config.DEFAULTS
_HOURS = f"""hour as materialized (select run_id, cell_id, t_i as t, case when pr is null or isnan(pr) or pr > {POSSIBLE['pr_hourly'][1]} then null when pr::double >= {_S['min_rain']}::double
    then cast(round_even(pr::double * {UNIT}, 0) as bigint) else 0 end as v
  from (select *, row_number() over (partition by run_id, cell_id, t_i order by loaded_at desc nulls last, pr desc nulls last) as i from pr_hourly where t_i is not null) where i = 1)"""
_STORMS = f"""wet as (select *, case when t - lag(t) over w <= {_S['separation_h']} then 0 else 1 end as fresh from hour where v > 0 window w as (partition by run_id, cell_id order by t)),
  numbered as (select *, sum(fresh) over (partition by run_id, cell_id order by t) as no from wet),
  storm as materialized (select run_id, cell_id, s0, s1 from (select run_id, cell_id, min(t) as s0, max(t) as s1 from numbered group by run_id, cell_id, no) join sim_run using (run_id)
    where s0 >= {_S['separation_h']} and n_steps - 1 - s1 >= {_S['separation_h']} and (s1 - s0 + 1) * {_S['time_res_min']} >= {_S['min_event_min']})"""


def _year(i: str) -> str:
    day = f"(({i}) * time_res_min // 60 // 24)"
    leap = "case when month(t0) > 2 and dayofyear(make_date(year(t0), 12, 31)) = 366 then 1 else 0 end"
    return f"""cast(case cal_name when '360_day' then year(t0) + ((month(t0) - 1) * 30 + day(t0) - 1 + {day}) // 360
      when '365_day' then year(t0) + (dayofyear(t0) - 1 - {leap} + {day}) // 365 else year(cast(t0 as date) + cast({day} as integer)) end as integer)"""


_FRAMES = ", ".join(
    f"case when count(v) over f{k} = count(*) over f{k} then sum(v) over f{k} end as m{k}" for k in _S["durations_h"]
) + ", count(v) over s as nv, count(*) over s as n, sum(v) over s as tot"
_WINDOWS = ", ".join(f"f{k} as (partition by run_id, cell_id, s0 order by t rows between {k // 2} preceding and {(k - 1) // 2} following)" for k in _S["durations_h"])
_EACH = " union all ".join(f"select run_id, cell_id, s0, s1, t, {k} as duration_h, m{k} as m, nv, n, tot from framed" for k in _S["durations_h"])
_EVENTS = f"""{_HOURS}, {_STORMS},
  dense as (select run_id, cell_id, s0, s1, cast(unnest(range(s0, s1 + 1)) as integer) as t from storm),
  filled as (select d.*, case when h.t is null then 0 else h.v end as v from dense d left join hour h using (run_id, cell_id, t)),
  framed as materialized (select *, {_FRAMES} from filled window s as (partition by run_id, cell_id, s0), {_WINDOWS}),
  each_ as (select *, case when n < duration_h then case when nv = n then tot end else m end as total, case when n < duration_h then s0 + n // 2 else t end as oe_i from ({_EACH})),
  best as (select *, row_number() over (partition by run_id, cell_id, s0, duration_h order by total desc nulls last, t) as i from each_),
  event as materialized (select b.run_id, b.cell_id, model, period_name, ws, lat, lon, y, x, cast(duration_h as tinyint) as duration_h, cast({_year('oe_i')} as smallint) as year,
    cast(total as bigint) as total, total::double / (duration_h * {float(UNIT)}::double) as oe, cast(oe_i as integer) as oe_i, s0 as from_i, s1 as to_i
    from best b join sim_run using (run_id) join grid_cell using (cell_id) where i = 1 and total is not null)"""
_STATED = ", ".join(f"round(oe::float::double, 6) as oe" if c == "oe" else c for c in STATED)
_K = "run_id, cell_id, duration_h"
_LO = round(100 * _S["left_censoring"][0])


def _fit(source: str, keys: str) -> str:
    return f"""fit_i as (select *, row_number() over (partition by {keys} order by oe) as i, count(*) over (partition by {keys}) as n from {source} where oe > 0),
      fit_u as (select {keys}, n, ln(oe) as lx, ln(-ln(1 - i / (n + 1)::double)) as ly from fit_i where i > case when (n * {_LO}) // 100 <= 1 then 0 else (n * {_LO}) // 100 end),
      fit_b as (select {keys}, max(n) as n, count(*) as n_used, regr_slope(lx, ly) as b, regr_intercept(lx, ly) as a from fit_u group by all),
      rate as (select {keys}, count(*) / count(distinct year)::double as per_year from {source} where oe > 0 group by all),
      fits as (select *, 1 / b as shape, exp(a) as scale from fit_b join rate using ({keys}) where n_used >= 2 and abs(b) > 1e-12)"""


_LEVEL = "round(scale * pow(-ln(1 - pow(1 - 1 / return_period::double, 1 / per_year)), 1 / shape), 6) as level"
_MAXIMA = f"maximum as (select * from (select *, row_number() over (partition by {_K}, year order by total desc, from_i) as i from event) where i = 1)"
_PRE = " ".join(
    f"when {dt} then case when count(v) over p{dt} = {_S['temp_window_h'] // dt} then sum(v) over p{dt} / {1000.0 * (_S['temp_window_h'] // dt)}::double end" for dt in (1, 2, 3, 4, 6, 8, 12, 24)
)
_PRE_W = ", ".join(f"p{dt} as (partition by run_id, cell_id order by i range between {_S['temp_window_h'] // dt - 1} preceding and current row)" for dt in (1, 2, 3, 4, 6, 8, 12, 24))
_PAIRS = f"""{_EVENTS},
  tas as (select run_id, cell_id, t_i // tas_dt_h as i, tas_dt_h as dt, case when tas is null or isnan(tas) or tas < {POSSIBLE['tas_steps'][0]} or tas > {POSSIBLE['tas_steps'][1]} then null
      else cast(round_even(tas::double * 1000, 0) as bigint) - 273150 end as v
    from (select *, row_number() over (partition by run_id, cell_id, t_i order by loaded_at desc nulls last, tas desc nulls last) as k from tas_steps where t_i is not null) join sim_run using (run_id)
    where k = 1 and t_i % tas_dt_h = 0),
  pre as (select run_id, cell_id as tas_cell, i + 1 as i, case dt {_PRE} end as t_pre24 from tas window {_PRE_W}),
  place as (select distinct run_id, cell_id, lat, lon from event), has as (select distinct run_id, cell_id, lat, lon from tas_steps join grid_cell using (cell_id)),
  by_lat as (select p.run_id, p.cell_id, arg_min(h.lat, {{'d': abs(h.lat - p.lat), 'c': h.lat}}) as lat, arg_min(h.lon, {{'d': abs(h.lon - p.lon), 'c': h.lon}}) as lon from place p join has h using (run_id) group by all),
  near as (select b.run_id, b.cell_id, h.cell_id as tas_cell from by_lat b join has h using (run_id, lat, lon)),
  pair as materialized (select e.*, t_pre24 from event e join near n using (run_id, cell_id) join sim_run r using (run_id) join pre p on p.run_id = e.run_id and p.tas_cell = n.tas_cell and p.i = e.oe_i // tas_dt_h
    where t_pre24 is not null and oe > 0)"""
_LINEAR = f"thr as (select {_K}, " + ", ".join(f"quantile_cont(oe, {p / 100}) as t{p}" for p in tails.PERCENTS) + " from pair group by all)"
_STORED = f"""stored as materialized (select distinct run_id, cell_id, duration_h, year, oe::double as oe, oe_i from ordinary_event where duration_h in ({', '.join(map(str, _S['durations_h']))}) and oe > 0 and oe <= {POSSIBLE['ordinary_event'][1]} and year is not null),
  event as (select model, period_name, cell_id, duration_h, oe, run_id * 10000 + year as year from stored join sim_run using (run_id) join grid_cell using (cell_id))"""

SQL = {
    "series_hours": f"with {_HOURS} select * from hour",
    "series_events": f"with {_EVENTS} select {_STATED} from event",
    "series_maxima": f"with {_EVENTS}, {_MAXIMA} select {_STATED} from maximum",
    "series_parameters": f"""with {_EVENTS}, {_MAXIMA}, {_fit('event', _K)}, mam as (select {_K}, sum(total)::bigint::double / (count(*) * duration_h * {float(UNIT)}::double) as mam from maximum group by {_K})
      select {_K}, n, n_used, round(shape, 6) as shape, round(scale, 6) as scale, round(per_year, 6) as per_year, round(mam, 9) as mam from fits join mam using ({_K})""",
    "series_levels": f"with {_EVENTS}, {_fit('event', _K)} select {_K}, return_period, {_LEVEL} from (select *, unnest({_S['return_periods']}) as return_period from fits)",
    "series_storm_years": f"""with {_HOURS}, {_STORMS}, z as (select run_id, cell_id, {_year('s0')} as year, 1 as a, 0 as b from storm join sim_run using (run_id)
      union all select run_id, cell_id, {_year('s1')}, 0, 1 from storm join sim_run using (run_id)) select run_id, cell_id, year, cast(sum(a) as bigint) as n_begun, cast(sum(b) as bigint) as n_ended from z group by all""",
    "series_pairs": f"with {_PAIRS} select {_K}, oe_i, round(oe, 9) as oe, round(t_pre24, 9) as t_pre24 from pair",
    "series_tail_events": f"""with {_PAIRS}, {_LINEAR} select {_K}, oe_i, round(oe, 9) as oe, round(t_pre24, 9) as t_pre24,
      case when oe >= t99 then 'p99' when oe >= t95 then 'p95' when oe >= t90 then 'p90' else 'p85' end as tail from pair join thr using ({_K}) where oe >= t85""",
    "series_tail_means": f"with {_PAIRS}, {_LINEAR}, long_ as (" + " union all ".join(f"select p.*, 'p{p}' as tail from pair p join thr using ({_K}) where oe >= t{p}" for p in tails.PERCENTS)
    + f") select {_K}, tail, round(avg(oe), 12) as mean_oe, round(avg(t_pre24), 12) as mean_t_pre24, count(*) as n_events from long_ group by all",
    "series_scaling_losses": f"""with {_PAIRS} select {_K}, unnest({_S['quantiles']})::double as quantile, n_events, true as lowest
      from (select {_K}, count(*) as n_events from pair group by all having count(*) >= {_S['min_events_regression']} and max(t_pre24) > min(t_pre24))""",
    "tail_scaling_losses": f"""with t as (select distinct run_id, cell_id, duration_h, oe_i, oe, t_pre24 from tail_temp where t_pre24 is not null and not isnan(t_pre24) and oe > 0 and not isnan(oe) and not isinf(oe))
      select run_id, duration_h, unnest({_S['quantiles']})::double as quantile, n_events, true as lowest
      from (select run_id, duration_h, count(*) as n_events from t group by all having count(*) >= {_S['min_events_regression']} and max(t_pre24) > min(t_pre24))""",
    "series_metrics_ws1": f"""with {_EVENTS}, sorted as (select *, row_number() over (partition by {_K} order by total) as i, count(*) over (partition by {_K}) as n from event),
      higher as (select {_K}, """ + ", ".join(f"max(case when i = 1 + ((n - 1) * {p} + 99) // 100 then total end) as t{p}" for p in tails.PERCENTS) + f""" from sorted group by {_K})
      select {_K}, lat, lon, cast(case when total >= t99 then 99 when total >= t95 then 95 when total >= t90 then 90 else 85 end as tinyint) as pctl_class, oe_i, round(oe::float::double, 6) as oe,
        (to_i - from_i + 1)::float as storm_len_h, case when oe >= {_S['min_rain']} then 0.0::float end as cv, case when oe >= {_S['min_rain']} then 0.0::float end as rg_norm, null::float as a_50, null::float as pca_50
      from event join higher using ({_K}) where total >= t85 and ws = 1""",
    "stored_levels": f"with {_STORED}, {_fit('event', 'model, period_name, cell_id, duration_h')} select model, period_name, cell_id, duration_h, return_period, {_LEVEL} from (select *, unnest({_S['return_periods']}) as return_period from fits)",
    "stored_subset": f"select run_id, duration_h, count(*) as n, count(oe) as n_oe from ordinary_event where lat between {BOX[0][0]} and {BOX[0][1]} and lon between {BOX[1][0]} and {BOX[1][1]} group by all",
    "run_axis": "select run_id, t0 as origin, 60 * time_res_min as step_s, t0 + to_minutes((n_steps - 1) * time_res_min) as last_ts from sim_run",
    "grid_transform": """with a as (select min(lon) as lon0, max(lon) as lon1, min(lat) as lat0, max(lat) as lat1, count(distinct x) as nx, count(distinct y) as ny, arg_min(lat, y) as f, arg_max(lat, y) as l from grid_cell)
      select round(lon0 - (lon1 - lon0) / (nx - 1) / 2, 9) as west, round(lat1 + (lat1 - lat0) / (ny - 1) / 2, 9) as north, round((lon1 - lon0) / (nx - 1), 9) as dx, round((lat1 - lat0) / (ny - 1), 9) as dy, nx, ny, l > f as flip from a""",
}
