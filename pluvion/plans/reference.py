"""The catalog of the event-statistics chain, over a cube made of ``lineitem`` (cell: supplier, step: ship day, value: price in cents).

The grid has five columns of cells. Values of events are means over the duration in units of a million cents.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion import config
from pluvion.functions.calendar import civil_year
from pluvion.operators import events as ev
from pluvion.operators import fit, grid, scaling, spatial, tails
from pluvion.operators.rolling import rounded
from pluvion.scratch import written
from pluvion.sources.tables import table

WET, SEP, DRIZZLE = 4_000_000, 3, 1_000_000
DURATIONS, PERIODS = [1, 3, 6], [2, 5, 10, 20, 50, 100]
EPOCH, NX, PRE = "1995-01-01", 5, 5
NITER = config.DEFAULTS["uncertainty"]["niter"]
#: A week taken out of the record, to have a gap: last step before, first step after.
GAP = (900, 908)
CELL = ["cell"]


def sums(spark: SparkSession, d: str) -> DataFrame:
    """cell, t, v and q (mean quantity) of the days with rows."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    t = F.datediff(F.col("l_shipdate").cast("date"), F.lit(EPOCH))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("cell"), t.alias("t"), cents.alias("c"), "l_quantity")
    return rows.groupBy("cell", "t").agg(F.sum("c").alias("v"), F.avg("l_quantity").alias("q"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily sums, written once for all that a query makes of them."""
    return written(sums(spark, d), "daily-sums")


def extent(s: DataFrame) -> tuple[Column, Column, Column]:
    """First and last step, and rows of the grid, as scalar subqueries; NULL for an empty table."""
    one = lambda f, c: s.agg(f(c)).scalar()
    return one(F.min, "t"), one(F.max, "t"), s.agg(F.expr(f"max(cell) div {NX} + 1").cast("int")).scalar()


def cube(s: DataFrame) -> DataFrame:
    lo, hi, _ = extent(s)
    rows = grid.densify(s.select("cell", "t", "v"), CELL, "t", "v", lo, hi)
    return rows.select("cell", F.expr(f"cell div {NX}").cast("int").alias("y"), (F.col("cell") % NX).alias("x"), "t", "v")


def year(t: str = "t"):
    return F.year(F.date_add(F.lit(EPOCH).cast("date"), F.col(t)))


def storms(s: DataFrame, least: int = WET) -> DataFrame:
    return ev.storms(s.where(grid.is_wet(F.col("v"), least)), CELL, SEP)


def ordinary(s: DataFrame) -> DataFrame:
    """cell, y, x, duration, s0, s1, total, oe, oe_i, year (of the peak), key_no, raster_no (duration, row from the north, column); written once for a query."""
    lo, hi, ny = extent(s)
    inside = ev.in_storms(s.select("cell", "t", "v"), CELL, grid.is_wet(F.col("v"), WET), SEP)
    rows = ev.peaks(ev.filled(ev.away_from_edges(inside, SEP, lo, hi), CELL), CELL, DURATIONS)
    x = F.col("total").cast("double") / (F.col("duration") * F.lit(1e6))
    di = F.array_position(F.array(*map(F.lit, DURATIONS)), F.col("duration")) - 1
    rows = rows.select(
        "cell", F.expr(f"cell div {NX}").cast("int").alias("y"), (F.col("cell") % NX).alias("x"), "duration", "s0", "s1", "total", x.alias("oe"), "oe_i",
        year("oe_i").alias("year"), (F.col("cell") * 10 + F.col("duration")).alias("key_no"), ny.alias("_ny"),
    )
    rows = rows.withColumn("raster_no", ((di * F.col("_ny") + F.col("_ny") - 1 - F.col("y")) * NX + F.col("x")).cast("bigint")).drop("_ny")
    return written(rows, "events")


def events(spark: SparkSession, d: str) -> DataFrame:
    return ordinary(daily(spark, d))


KEY = ["cell", "duration"]


def fits(e: DataFrame, censor: int = 85) -> DataFrame:
    per_year = e.groupBy(*KEY).agg((F.count("*") / F.countDistinct("year")).alias("per_year"))
    return fit.weibull_fit(e, KEY, "oe", censor).join(per_year, KEY)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events with the mean quantity of the days before their peak; written once for a query."""
    s = daily(spark, d)
    lo, hi, _ = extent(s)
    q = s.select("cell", "t", F.col("q").alias("v"))
    every = q.select("cell").distinct().withColumn("t", F.explode(F.sequence(lo, hi)))
    # days without rows carry the last mean on, so that the covariate has no gaps
    w = W.partitionBy("cell").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    full = every.join(q, ["cell", "t"], "left").withColumn("v", F.last("v", ignorenulls=True).over(w))
    pre = scaling.preceding_mean(full, CELL, "t", "v", PRE).where(F.col("pre").isNotNull())
    return written(ordinary(s).join(pre.select("cell", F.col("t").alias("oe_i"), "pre"), ["cell", "oe_i"]), "pairs")


def classes(e: DataFrame) -> DataFrame:
    return tails.classified(e, tails.thresholds_higher(e, KEY, "total"), KEY, "total")


def tail_events(spark: SparkSession, d: str) -> DataFrame:
    return classes(events(spark, d))


def with_fields(spark: SparkSession, d: str, chosen, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """The chosen events, and the fields around their peaks."""
    s = daily(spark, d)
    e = chosen(ordinary(s))
    return e, spatial.fields(e.select("cell", "s0", "y", "x", "duration", "oe_i"), cube(s), ["cell", "s0"], size, DRIZZLE, DURATIONS)


def fields(spark: SparkSession, d: str) -> DataFrame:
    return with_fields(spark, d, classes)[1]


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return spatial.metrics(fields(spark, d), ["cell", "s0"], 3)


def maxima(e: DataFrame) -> DataFrame:
    return ev.annual_maxima(e, KEY)


def q_mean_maximum(spark: SparkSession, d: str) -> DataFrame:
    """The totals are added as whole numbers and divided once, so that the mean does not depend on the order of the rows."""
    mean = F.sum("total").cast("double") / (F.count("total") * F.col("duration") * F.lit(1e6))
    return rounded(maxima(events(spark, d)).groupBy(*KEY).agg(mean.alias("mam")))


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Made-up coordinates of the suppliers."""
    s = table(spark, d, "supplier")
    lat = 46.0 + 0.0275 * (F.col("s_suppkey") % 12) + F.col("s_nationkey") * 0.001
    return s.select("s_suppkey", lat.alias("lat"), (10.0 + 0.0275 * (F.col("s_suppkey") % 14) + 0.001).alias("lon"))


def q_grid_crop(spark: SparkSession, d: str, size: int) -> DataFrame:
    s = daily(spark, d)
    lo, _, ny = extent(s)
    first = cube(s).where(F.col("t") == lo)
    cells = first.select("cell", "y", "x")
    return grid.crop_odd(cells, size, ny, NX) if size % 2 else grid.crop_even(cells, first.select("y", "x", "v"), size)


def q_areal(spark: SparkSession, d: str, size: int) -> DataFrame:
    return rounded(grid.strict_mean(cube(daily(spark, d)), size).select("cell", "t", (F.col("mean") / 1e6).alias("mean")), 8)


def q_areal_edge(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d)
    return rounded(grid.edge_mean(cube(s), 3, extent(s)[2], NX).select("y", "x", "t", (F.col("mean") / 1e6).alias("mean")))


def q_storms_edges(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d)
    lo, hi, _ = extent(s)
    return ev.away_from_edges(storms(s), SEP, lo, hi)


def q_storms_gaps(spark: SparkSession, d: str) -> DataFrame:
    wet = daily(spark, d).where((F.col("v") >= WET) & ~F.col("t").between(GAP[0] + 1, GAP[1] - 1))
    return ev.away_from_gaps(ev.storms(wet, CELL, SEP), wet, [GAP], CELL, SEP)


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by built-in session windows: a gap of a day or less continues one."""
    e = table(spark, d, "events").where(F.col("ts").isNotNull()).withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "24 hours 1 microseconds")).agg(F.count("*").alias("n_events"), F.min("at").alias("a"), F.max("at").alias("b"))
    return s.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"), "n_events")


def q_completeness(spark: SparkSession, d: str) -> DataFrame:
    s = sums(spark, d).withColumn("year", year())
    return s.groupBy("cell", "year").agg(F.count("v").alias("n_valid")).withColumn("share", F.round(F.col("n_valid") / 365.0, 6)).withColumn("complete", F.col("n_valid") / 365.0 >= 0.5)


def q_complete_years(spark: SparkSession, d: str) -> DataFrame:
    """The cube without incomplete years, by the tolerance of the settings. Days without rows are dry days of the cube, not missing ones."""
    return ev.complete_years(cube(daily(spark, d)).withColumn("year", year()), CELL, "year", "v", 365, config.DEFAULTS["tolerance"])


def q_yearly(spark: SparkSession, d: str) -> DataFrame:
    s = cube(daily(spark, d)).withColumn("year", year()).withColumn("p", F.when(F.col("v") > 0, F.col("v") / 1e6))
    return rounded(s.groupBy("cell", "year").agg(F.sum("v").alias("total"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"), F.count("p").alias("n_wet")), mean=9)


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    lv = fit.return_levels(fits(events(spark, d)), PERIODS)
    wide = lv.groupBy(*KEY, "shape", "scale").pivot("return_period", PERIODS).agg(F.first("level"))
    return wide.select(*KEY, F.round("shape", 4).alias("shape"), F.round("scale", 4).alias("scale"), *[F.round(str(p), 4).alias(f"rl_{p}") for p in PERIODS])


def q_bands(spark: SparkSession, d: str) -> DataFrame:
    """Band and raster row of every level: duration-major bands, rows from the north for a grid whose y grows northwards."""
    s = daily(spark, d)
    lv = fit.return_levels(fits(ordinary(s)), PERIODS).withColumn("_ny", extent(s)[2])
    di = F.array_position(F.array(*map(F.lit, DURATIONS)), F.col("duration")) - 1
    ri = F.array_position(F.array(*map(F.lit, PERIODS)), F.col("return_period")) - 1
    name = F.concat(F.lit("RL_"), F.col("duration"), F.lit("h_"), F.col("return_period"), F.lit("yr"))
    return rounded(lv.select((di * len(PERIODS) + ri).cast("int").alias("band"), name.alias("band_name"), (F.col("_ny") - 1 - F.expr(f"cell div {NX}")).cast("int").alias("row"), (F.col("cell") % NX).alias("col"), "level"))


def q_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """Event depths in ten-thousandths, not divided by the duration."""
    return events(spark, d).select("cell", "duration", "s0", F.bround(F.col("total") / 1e6 * 10000).cast("bigint").alias("depth"))


def step_year(i: Column) -> Column:
    return civil_year(i, F.col("t0"), F.col("time_res_min"), F.col("cal_name"))


def q_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Civil year of the first and last step of every run."""
    return table(spark, d, "sim_run").select("run_id", "cal_name", step_year(F.lit(0)).alias("first_year"), step_year(F.col("n_steps") - 1).alias("last_year"))


def q_step_years(spark: SparkSession, d: str) -> DataFrame:
    """Civil year of every distinct step of the hourly rows, by the calendar of its run; NULL for steps of a run that is not known."""
    steps = table(spark, d, "pr_hourly").select("run_id", "t_i").where(F.col("t_i").isNotNull()).distinct()
    runs = table(spark, d, "sim_run").select("run_id", "cal_name", "t0", "time_res_min").distinct()
    return steps.join(runs, "run_id", "left").select("run_id", "t_i", "cal_name", F.when(F.col("t0").isNotNull(), step_year(F.col("t_i"))).alias("year"))


def q_union(spark: SparkSession, d: str) -> DataFrame:
    """Tables of single durations, put together again."""
    e = events(spark, d)
    parts = [e.where(F.col("duration") == k).select("cell", "duration", "s0", "oe_i") for k in DURATIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_step(spark: SparkSession, d: str) -> DataFrame:
    return scaling.covariate_step(table(spark, d, "tas_steps").select("run_id", "cell_id", "ts"), ["run_id", "cell_id"], "ts")


def q_nearest(spark: SparkSession, d: str) -> DataFrame:
    s = grid.nearest_axis(stations(spark, d), "lat", 46.0, 0.05, 8).withColumnRenamed("i", "y")
    return grid.nearest_axis(s, "lon", 10.0, 0.05, 9).select("s_suppkey", "y", F.col("i").alias("x"))


def q_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of events, some of single precision, found on both axes of the grid by their rounded values; NULL where there is none."""
    cells = table(spark, d, "grid_cell")
    points = table(spark, d, "ordinary_event").select("lat", "lon").distinct()
    for c, i in (("lat", "y"), ("lon", "x")):
        points = grid.rounded_match(points, cells.select(F.col(c).alias("coord"), F.col(i).alias("i")).distinct(), c, 4).withColumnRenamed("i", i)
    return points.select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "y", "x")


def q_affine(spark: SparkSession, d: str) -> DataFrame:
    """Raster row and column of the event coordinates by the grid's own transform; points outside the raster are left out."""
    t = grid.geotransform(table(spark, d, "grid_cell"))
    west, north, dx, dy, nx, ny = (t.select(c).scalar() for c in ("west", "north", "dx", "dy", "nx", "ny"))
    points = table(spark, d, "ordinary_event").select("lat", "lon").distinct()
    return grid.in_raster(grid.affine_cell(points, "lat", "lon", north, west, dy, dx), ny, nx).select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "row", "col")


def q_ws1(spark: SparkSession, d: str) -> DataFrame:
    """The shortcut for windows of one cell."""
    zero = F.when(F.col("oe") >= WET / 1e6, 0.0)
    none = F.lit(None).cast("double")
    return tail_events(spark, d).select("cell", "s0", "duration", zero.alias("cv"), zero.alias("rg_norm"), none.alias("a_50"), none.alias("pca_50"))


def q_metrics_tail(spark: SparkSession, d: str) -> DataFrame:
    t, f = with_fields(spark, d, classes)
    e = t.select("cell", "s0", "duration", "pctl_class", (F.col("s1") - F.col("s0") + 1).alias("storm_len"))
    return rounded(spatial.metrics(f, ["cell", "s0"], 3).join(e, ["cell", "s0", "duration"]))


def q_metrics_ams(spark: SparkSession, d: str) -> DataFrame:
    m, f = with_fields(spark, d, maxima)
    return rounded(spatial.metrics(f, ["cell", "s0"], 3).join(m.select("cell", "s0", "duration", "year"), ["cell", "s0", "duration"]))


def q_rates(spark: SparkSession, d: str) -> DataFrame:
    n, years = F.count("*"), F.countDistinct("year")
    return rounded(events(spark, d).groupBy(*KEY).agg(n.alias("n"), years.alias("n_years"), (n / years).alias("per_year")))


def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return rounded(fit.bootstrap(e, fits(e), KEY, "year", "oe", PERIODS, NITER))


def q_tail_means(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return rounded(tails.cumulative_means(p, tails.thresholds_linear(p, KEY, "oe"), KEY, "oe", "pre"), 9)


def q_regression(spark: SparkSession, d: str) -> DataFrame:
    return scaling.quantile_regression(pairs(spark, d), KEY, "pre", "oe", [0.85, 0.9, 0.95, 0.99])


def q_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Scaling of real tail events against temperature: slopes in percent per degree, per model and duration, from the least-squares line."""
    t = table(spark, d, "tail_temp").where(F.col("t_pre24").isNotNull() & ~F.isnan("t_pre24") & (F.col("oe") > 0)).join(table(spark, d, "sim_run").select("run_id", "model"), "run_id")
    y, x = F.log(F.col("oe").cast("double")), F.col("t_pre24").cast("double")
    s = t.groupBy("model", "duration_h").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.count("*").alias("n_events")).where("n_events >= 50")
    return s.select("model", "duration_h", F.bround((F.exp("b") - 1) * 100, 3).alias("slope_pct_K"), F.bround("a", 5).alias("intercept"), "n_events")


QUERIES = {
    "cube_dense": lambda s, d: cube(daily(s, d)),
    "areal_mean_ws2": lambda s, d: q_areal(s, d, 2),
    "areal_mean_ws3": lambda s, d: q_areal(s, d, 3),
    "areal_mean_edge_ws3": q_areal_edge,
    "grid_crop_odd": lambda s, d: q_grid_crop(s, d, 3),
    "grid_crop_even": lambda s, d: q_grid_crop(s, d, 2),
    "storms_raw": lambda s, d: storms(sums(s, d)),
    "storms_gt_zero": lambda s, d: storms(sums(s, d), 0),
    "storms_edges": q_storms_edges,
    "storms_min_duration": lambda s, d: ev.longer_than(storms(sums(s, d)), 4),
    "storms_gap_filtered": q_storms_gaps,
    "event_sessions_24h": q_sessions,
    "ordinary_events": lambda s, d: rounded(events(s, d).drop("key_no", "raster_no"), 8),
    "annual_maxima": lambda s, d: rounded(maxima(events(s, d)).select("cell", "duration", "year", "total", "s0", "oe", "oe_i"), 8),
    "mean_annual_max": q_mean_maximum,
    "events_per_year": q_rates,
    "year_completeness": q_completeness,
    "complete_years": q_complete_years,
    "yearly_stats": q_yearly,
    "weibull_fit": lambda s, d: rounded(fits(events(s, d))),
    "weibull_fit_uncensored": lambda s, d: rounded(fits(events(s, d), 0)),
    "return_levels": lambda s, d: rounded(fit.return_levels(fits(events(s, d)), PERIODS).select(*KEY, "return_period", "level")),
    "fit_summary_wide": q_summary,
    "bootstrap_ci_rel": q_bootstrap,
    "bootstrap_ci_seeded": lambda s, d: fit.seeded_bootstrap(events(s, d), KEY, "year", "oe", "raster_no", PERIODS, NITER),
    "thresholds_higher": lambda s, d: tails.thresholds_higher(events(s, d), KEY, "total"),
    "thresholds_linear": lambda s, d: rounded(tails.thresholds_linear(events(s, d), KEY, "oe"), 9),
    "tail_class": lambda s, d: tail_events(s, d).select("cell", "s0", "duration", "pctl_class"),
    "tail_means": q_tail_means,
    "event_field_mean": lambda s, d: rounded(fields(s, d).select("cell", "s0", "duration", "dy", "dx", (F.col("f").cast("double") / (F.col("duration") * 1e6)).alias("f")), 8),
    "spatial_cv": lambda s, d: rounded(metrics(s, d).select("cell", "s0", "duration", "cv")),
    "spatial_rg": lambda s, d: rounded(metrics(s, d).select("cell", "s0", "duration", "rg_norm")),
    "spatial_area_fraction": lambda s, d: rounded(metrics(s, d).select("cell", "s0", "duration", "a_50", "a_50_cells")),
    "spatial_peak_fraction": lambda s, d: rounded(metrics(s, d).select("cell", "s0", "duration", "pca_50")),
    "spatial_metrics_tail": q_metrics_tail,
    "spatial_metrics_ams": q_metrics_ams,
    "spatial_metrics_ws1": q_ws1,
    "covariate_step": q_step,
    "covariate_pre_window": lambda s, d: rounded(pairs(s, d).select("cell", "duration", "s0", "oe_i", "pre")),
    "event_covariate_pairs": lambda s, d: rounded(pairs(s, d).select("cell", "duration", "s0", "oe", "pre"), oe=8),
    "nearest_cell": q_nearest,
    "rounded_key_match": q_rounded,
    "affine_cell": q_affine,
    "quantile_regression": q_regression,
    "scaling_rates": q_scaling,
    "raster_bands": q_bands,
    "calendar_years": q_calendar,
    "calendar_step_years": q_step_years,
    "union_parts": q_union,
    "fixed_point_depth": q_fixed_point,
}

# --- the same in SQL ---

_T = f"date_diff('day', date '{EPOCH}', cast(l_shipdate as date))"
_YEAR = f"cast(year(date '{EPOCH}' + {{}}) as integer)"
_SUMS = f"sums as materialized (select cast(l_suppkey as integer) as cell, cast({_T} as integer) as t, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as v, avg(l_quantity) as q from lineitem group by 1, 2)"
_AXIS = "axis as materialized (select min(t) as lo, max(t) as hi, max(cell) // 5 + 1 as ny from sums)"
_DAYS = "days as materialized (select cell, cast(unnest(range(lo, hi + 1)) as integer) as t from (select distinct cell from sums), axis)"
_CUBE = "cube as materialized (select d.cell, cast(d.cell // 5 as integer) as y, d.cell % 5 as x, d.t, coalesce(s.v, 0) as v from days d left join sums s using (cell, t))"
_BASE = ", ".join([_SUMS, _AXIS, _DAYS, _CUBE])


def _storm(where: str, name: str = "storm") -> str:
    return f"""{name}_wet as (select cell, t from sums where {where}),
      {name}_m as (select *, case when t - lag(t) over (partition by cell order by t) <= {SEP} then 0 else 1 end as fresh from {name}_wet),
      {name}_n as (select *, sum(fresh) over (partition by cell order by t) as no from {name}_m),
      {name} as (select cell, min(t) as s0, max(t) as s1, count(*) as n_wet from {name}_n group by cell, no)"""


def _peaks() -> str:
    frames = ", ".join(f"sum(v) over (partition by c.cell, s0 order by t rows between {k // 2} preceding and {(k - 1) // 2} following) as m{k}" for k in DURATIONS)
    each = " union all ".join(f"select cell, s0, s1, t, {k} as duration, m{k} as m from framed" for k in DURATIONS)
    return f"""edged as (select storm.* from storm, axis where s0 - lo >= {SEP} and hi - s1 >= {SEP}),
      framed as (select c.cell, s0, s1, t, v, {frames} from cube c join edged e on c.cell = e.cell and t between s0 and s1),
      ranked as (select *, row_number() over (partition by cell, s0, duration order by m desc, t) as i from ({each})),
      whole as (select cell, s0, sum(v) as total from framed group by all),
      oe as (select r.cell, cast(r.cell // 5 as integer) as y, r.cell % 5 as x, duration, r.s0, s1,
        cast(case when s1 - r.s0 + 1 < duration then w.total else m end as bigint) as total,
        cast(case when s1 - r.s0 + 1 < duration then r.s0 + (s1 - r.s0 + 1) // 2 else t end as integer) as oe_i from ranked r join whole w on r.cell = w.cell and r.s0 = w.s0 where i = 1),
      events_ as materialized (select *, total::double / (duration * 1e6::double) as oe, {_YEAR.format("oe_i")} as year, cell * 10 + duration as key_no from oe)"""


_EVENTS = ", ".join([_BASE, _storm(f"v >= {WET}"), _peaks()])


def _fit(source: str, keys: str, name: str, censor: int = 85) -> str:
    return f"""{name}_i as (select *, row_number() over (partition by {keys} order by oe) as i, count(*) over (partition by {keys}) as n from {source}),
      {name}_u as (select {keys}, n, ln(oe) as lx, ln(-ln(1 - i / (n + 1)::double)) as ly from {name}_i
        where i > case when (n * {censor}) // 100 <= 1 then 0 else (n * {censor}) // 100 end),
      {name}_b as (select {keys}, max(n) as n, count(*) as n_used, regr_slope(lx, ly) as b, regr_intercept(lx, ly) as a from {name}_u group by all),
      {name} as (select {keys}, n, n_used, 1 / b as shape, exp(a) as scale from {name}_b where n_used >= 2 and abs(b) > 1e-12)"""


_RATE = "rate as (select cell, duration, count(*) / count(distinct year)::double as per_year from events_ group by all)"
_FITS = ", ".join([_EVENTS, _fit("events_", "cell, duration", "fit"), _RATE, "fits as (select * from fit join rate using (cell, duration))"])
_LEVEL = "scale * pow(-ln(1 - pow(1 - 1 / return_period::double, 1 / per_year)), 1 / shape)"
_LEVELS = f"{_FITS}, levels as (select *, {_LEVEL} as level from (select *, unnest({PERIODS}) as return_period from fits))"
_HIGHER = ", ".join(f"max(case when i = 1 + ((n - 1) * {p} + 99) // 100 then total end) as t{p}" for p in tails.PERCENTS)
_TAIL = f"""{_EVENTS}, sorted as (select *, row_number() over (partition by cell, duration order by total) as i, count(*) over (partition by cell, duration) as n from events_),
  higher as (select cell, duration, {_HIGHER} from sorted group by cell, duration),
  tail as materialized (select e.*, case when total >= t99 then 99 when total >= t95 then 95 when total >= t90 then 90 when total >= t85 then 85 end as pctl_class
    from events_ e join higher using (cell, duration) where total >= t85)"""


def _fields(source: str) -> str:
    return f"""offs as (select unnest(range(-1, 2)) as o),
      asked as (select e.cell, s0, duration, dy.o as dy, dx.o as dx, oe_i, y + dy.o as yy, x + dx.o as xx from {source} e, offs dy, offs dx),
      field as materialized (select a.cell, s0, duration, dy, dx, sum(case when v >= {DRIZZLE} then v else 0 end)::bigint as f from asked a join cube c
        on c.y = yy and c.x = xx and c.t between oe_i - duration // 2 and oe_i + (duration - 1) // 2 group by all)"""


_METRICS = """full_ as (select *, count(*) over w as n, sum(f) over w as tot, max(f) over w as mx, sum(f) over (partition by cell, s0, duration order by f desc rows unbounded preceding) as cum,
    row_number() over (partition by cell, s0, duration order by f desc) as i from field window w as (partition by cell, s0, duration)),
  summed as (select cell, s0, duration, max(tot)::double as tot, stddev_pop(f::double) as sd, avg(f::double) as m, sum(f::double * dy) as fy, sum(f::double * dx) as fx,
    sum(f::double * dy * dy) as fyy, sum(f::double * dx * dx) as fxx, min(case when 2 * cum >= tot then i end) as c50, sum(case when 2 * f >= mx then 1 else 0 end) as cmx
    from full_ where n = 9 group by all),
  metric as (select cell, s0, duration, round(case when tot > 0 then sd / m end, 6) as cv,
    round(case when tot > 0 then sqrt(greatest(0, fyy / tot - (fy / tot) ** 2 + fxx / tot - (fx / tot) ** 2)) / sqrt(8 / 6.0::double) else 0 end, 6) as rg_norm,
    round(case when tot > 0 then c50 / 9.0::double end, 6) as a_50, round(case when tot > 0 then cmx / 9.0::double end, 6) as pca_50, case when tot > 0 then c50 end as a_50_cells from summed)"""
_SPATIAL = ", ".join([_TAIL, _fields("tail"), _METRICS])
_PAIRS = f"""{_EVENTS}, qfill as (select d.cell, d.t, last_value(q ignore nulls) over (partition by d.cell order by d.t rows unbounded preceding) as q from days d left join sums s using (cell, t)),
  qpre as (select cell, t, case when count(q) over w = {PRE} then avg(q) over w end as pre from qfill window w as (partition by cell order by t range between {PRE} preceding and 1 preceding)),
  pairs as materialized (select e.*, pre from events_ e join qpre p on e.cell = p.cell and e.oe_i = p.t where pre is not null)"""
_AREAL = """select cell, t, case when n = {k} then round(s::double / {k}.0::double / 1e6::double, 8) end as mean from (select c.cell, c.t,
  sum(b.v) as s, count(b.v) as n from cube c join cube b on b.t = c.t and b.y between c.y - {a} and c.y + {b} and b.x between c.x - {a} and c.x + {b} group by c.cell, c.t)"""
_STATIONS = "stations as (select s_suppkey, 46.0::double + 0.0275::double * (s_suppkey % 12) + s_nationkey * 0.001::double as lat, 10.0::double + 0.0275::double * (s_suppkey % 14) + 0.001::double as lon from supplier)"
_NEAR = "greatest(0, least({n} - 1, cast(ceil(({c} - {o}::double) / 0.05::double - 0.5::double) as integer)))"
_ROUND = "select * replace ((xor(h, h >> 16) * {m}) & {w} as h) from {{}}".format(m=fit.ROUND, w=fit.WORD)


def _stirred(name: str, source: str) -> str:
    return f"{name}_1 as ({_ROUND.format(source)}), {name}_2 as ({_ROUND.format(name + '_1')}), {name} as (select * replace (xor(h, h >> 16) as h) from {name}_2)"


_DRAWS = f"""blocks as (select distinct cell, duration, key_no, year from events_),
  numbered as materialized (select *, row_number() over (partition by cell, duration order by year) - 1 as b, count(*) over (partition by cell, duration) as nb from blocks),
  keyed as (select cell, duration, nb, b, (key_no::bigint * {fit.SPREAD[0]}) & {fit.WORD} as h from numbered), {_stirred("by_key", "keyed")},
  tries as (select * replace ((h + (it + 1)::bigint * {fit.SPREAD[1]}) & {fit.WORD} as h) from (select *, unnest(range(0, {NITER})) as it from by_key)), {_stirred("by_try", "tries")},
  slots as (select * replace ((h + (b + 1)::bigint * {fit.SPREAD[2]}) & {fit.WORD} as h) from by_try), {_stirred("by_slot", "slots")},
  drawn as (select d.cell, d.duration, d.it, e.oe from by_slot d join numbered n on n.cell = d.cell and n.duration = d.duration and n.b = d.h % d.nb
    join events_ e on e.cell = n.cell and e.duration = n.duration and e.year = n.year)"""

_CAL_DAY = "((({i}) * time_res_min // 60) // 24)"


def _calendar(i: str) -> str:
    day = _CAL_DAY.format(i=i)
    leap = "case when month(t0) > 2 and dayofyear(make_date(year(t0), 12, 31)) = 366 then 1 else 0 end"
    return f"""cast(case cal_name when '360_day' then year(t0) + ((month(t0) - 1) * 30 + day(t0) - 1 + {day}) // 360
      when '365_day' then year(t0) + (dayofyear(t0) - 1 - {leap} + {day}) // 365 else year(cast(t0 as date) + cast({day} as integer)) end as integer)"""


SQL = {
    "cube_dense": f"with {_BASE} select * from cube",
    "areal_mean_ws2": f"with {_BASE} {_AREAL.format(k=4, a=1, b=0)}",
    "areal_mean_ws3": f"with {_BASE} {_AREAL.format(k=9, a=1, b=1)}",
    "areal_mean_edge_ws3": f"""with {_BASE}, offs as (select unnest(range(-1, 2)) as o), cells as (select distinct cell, y, x from cube),
      near as (select c.y, c.x, greatest(0, least(ny - 1, c.y + a.o)) as yy, greatest(0, least(4, c.x + b.o)) as xx from cells c, offs a, offs b, axis)
      select n.y, n.x, t, case when count(v) = 9 then round(sum(v)::double / 9.0::double / 1e6::double, 6) end as mean from near n join cube k on k.y = yy and k.x = xx group by n.y, n.x, t""",
    "grid_crop_odd": f"with {_BASE} select cell, y, x from cube, axis where t = lo and y between 1 and ny - 2 and x between 1 and 3",
    "grid_crop_even": f"""with {_BASE}, first_ as (select c.* from cube c, axis where t = lo),
      ok as (select c.y, c.x from first_ c join first_ b on b.y between c.y - 1 and c.y and b.x between c.x - 1 and c.x group by c.y, c.x having count(b.v) = 4),
      box as (select min(y) as a, max(y) as b, min(x) as c, max(x) as d from ok) select cell, y, x from first_, box where a is null or (y between a and b and x between c and d)""",
    "storms_raw": f"with {_SUMS}, {_storm(f'v >= {WET}')} select * from storm",
    "storms_gt_zero": f"with {_SUMS}, {_storm('v > 0')} select * from storm",
    "storms_edges": f"with {_SUMS}, {_AXIS}, {_storm(f'v >= {WET}')} select storm.* from storm, axis where s0 - lo >= {SEP} and hi - s1 >= {SEP}",
    "storms_min_duration": f"with {_SUMS}, {_storm(f'v >= {WET}')} select * from storm where s1 - s0 + 1 >= 4",
    "storms_gap_filtered": f"""with {_SUMS}, {_storm(f'v >= {WET} and t not between {GAP[0] + 1} and {GAP[1] - 1}')}
      select * from storm s where not exists (select 1 from storm_wet w where w.cell = s.cell and w.t between s.s0 and s.s1
        and ((w.t >= {GAP[0] - SEP} and w.t < {GAP[0]}) or (w.t >= {GAP[1]} and w.t < {GAP[1] + SEP})))""",
    "event_sessions_24h": """with e as (select user_id, epoch_us(ts) as us from events where ts is not null),
      m as (select *, case when us - lag(us) over (partition by user_id order by us) <= 86400000000 then 0 else 1 end as fresh from e),
      n as (select *, sum(fresh) over (partition by user_id order by us rows unbounded preceding) as no from m)
      select user_id, min(us) as start_us, max(us) as end_us, count(*) as n_events from n group by user_id, no""",
    "ordinary_events": f"with {_EVENTS} select cell, y, x, duration, s0, s1, total, round(oe, 8) as oe, oe_i, year from events_",
    "annual_maxima": f"with {_EVENTS}, r as (select *, row_number() over (partition by cell, duration, year order by total desc, s0) as i from events_) select cell, duration, year, total, s0, round(oe, 8) as oe, oe_i from r where i = 1",
    "mean_annual_max": f"with {_EVENTS}, m as (select cell, duration, year, max(total) as total from events_ group by all) select cell, duration, round(sum(total)::bigint::double / (count(*) * duration * 1e6::double), 6) as mam from m group by cell, duration",
    "events_per_year": f"with {_EVENTS} select cell, duration, count(*) as n, count(distinct year) as n_years, round(count(*) / count(distinct year)::double, 6) as per_year from events_ group by all",
    "year_completeness": f"with {_SUMS} select cell, {_YEAR.format('t')} as year, count(v) as n_valid, round(count(v) / 365.0::double, 6) as share, count(v) / 365.0::double >= 0.5 as complete from sums group by 1, 2",
    "complete_years": f"""with {_BASE}, y as (select *, {_YEAR.format('t')} as year from cube), n as (select *, count(v) over (partition by cell, year) / 365.0::double as share from y)
      select cell, y, x, t, v, year from n where share >= 1 - {config.DEFAULTS['tolerance']}::double""",
    "yearly_stats": f"with {_BASE}, p as (select *, {_YEAR.format('t')} as year, case when v > 0 then v / 1e6::double end as p from cube) select cell, year, cast(sum(v) as bigint) as total, round(avg(p), 9) as mean, round(stddev_samp(p), 6) as sd, count(p) as n_wet from p group by cell, year",
    "weibull_fit": f"with {_FITS} select cell, duration, n, n_used, round(shape, 6) as shape, round(scale, 6) as scale, round(per_year, 6) as per_year from fits",
    "weibull_fit_uncensored": f"with {_EVENTS}, {_fit('events_', 'cell, duration', 'fit', 0)}, {_RATE} select cell, duration, n, n_used, round(shape, 6) as shape, round(scale, 6) as scale, round(per_year, 6) as per_year from fit join rate using (cell, duration)",
    "return_levels": f"with {_LEVELS} select cell, duration, return_period, round(level, 6) as level from levels",
    "fit_summary_wide": f"with {_LEVELS} select cell, duration, round(max(shape), 4) as shape, round(max(scale), 4) as scale, " + ", ".join(f"round(max(case when return_period = {p} then level end), 4) as rl_{p}" for p in PERIODS) + " from levels group by cell, duration",
    "bootstrap_ci_rel": f"with {_FITS}, {_DRAWS}, {_fit('drawn', 'cell, duration, it', 'refit')}, l as (select cell, duration, return_period, {_LEVEL} as level from (select r.*, per_year, unnest({PERIODS}) as return_period from refit r join rate using (cell, duration) semi join fits using (cell, duration))) select cell, duration, return_period, round(quantile_cont(level, 0.05), 6) as lo, round(quantile_cont(level, 0.95), 6) as hi from l group by all",
    "thresholds_higher": f"with {_TAIL} select * from higher",
    "thresholds_linear": f"with {_EVENTS} select cell, duration, " + ", ".join(f"round(quantile_cont(oe, {p / 100}), 9) as t{p}" for p in tails.PERCENTS) + " from events_ group by all",
    "tail_class": f"with {_TAIL} select cell, s0, duration, pctl_class from tail",
    "tail_means": f"with {_PAIRS}, thr as (select cell, duration, " + ", ".join(f"quantile_cont(oe, {p / 100}) as t{p}" for p in tails.PERCENTS) + " from pairs group by all), long_ as (" + " union all ".join(f"select p.*, 'p{p}' as tail from pairs p join thr using (cell, duration) where oe >= t{p}" for p in tails.PERCENTS) + ") select cell, duration, tail, round(avg(oe), 9) as mean_oe, round(avg(pre), 9) as mean_covariate, count(*) as n_events from long_ group by all",
    "event_field_mean": f"with {_TAIL}, {_fields('tail')} select cell, s0, duration, dy, dx, round(f::double / (duration * 1e6::double), 8) as f from field",
    "spatial_cv": f"with {_SPATIAL} select cell, s0, duration, cv from metric",
    "spatial_rg": f"with {_SPATIAL} select cell, s0, duration, rg_norm from metric",
    "spatial_area_fraction": f"with {_SPATIAL} select cell, s0, duration, a_50, a_50_cells from metric",
    "spatial_peak_fraction": f"with {_SPATIAL} select cell, s0, duration, pca_50 from metric",
    "spatial_metrics_tail": f"with {_SPATIAL} select m.*, pctl_class, s1 - t.s0 + 1 as storm_len from metric m join tail t using (cell, s0, duration)",
    "spatial_metrics_ams": f"with {_EVENTS}, ranked_ as (select *, row_number() over (partition by cell, duration, year order by total desc, s0) as i from events_), ams as (select * from ranked_ where i = 1), {_fields('ams')}, {_METRICS} select m.*, year from metric m join ams a using (cell, s0, duration)",
    "spatial_metrics_ws1": f"with {_TAIL} select cell, s0, duration, case when oe >= {WET / 1e6} then 0.0::double end as cv, case when oe >= {WET / 1e6} then 0.0::double end as rg_norm, null::double as a_50, null::double as pca_50 from tail",
    "covariate_step": """with s as (select distinct run_id, cell_id, ts from tas_steps where ts is not null), d as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by run_id, cell_id order by ts) as d from s),
      g as (select run_id, cell_id, min(d) / 3.6e9::double as least_h, max(d) / 3.6e9::double as greatest_h from d group by all)
      select *, coalesce(least_h = greatest_h and least_h = floor(least_h) and 24.0::double % least_h = 0, false) as regular from g""",
    "covariate_pre_window": f"with {_PAIRS} select cell, duration, s0, oe_i, round(pre, 6) as pre from pairs",
    "event_covariate_pairs": f"with {_PAIRS} select cell, duration, s0, round(oe, 8) as oe, round(pre, 6) as pre from pairs",
    "nearest_cell": f"with {_STATIONS} select s_suppkey, {_NEAR.format(n=8, c='lat', o='46.0')} as y, {_NEAR.format(n=9, c='lon', o='10.0')} as x from stations",
    "rounded_key_match": """with a as (select distinct lat, y from grid_cell), b as (select distinct lon, x from grid_cell), l as (select distinct lat, lon from ordinary_event)
      select round(l.lat, 9) as lat, round(l.lon, 9) as lon, y, x from l left join a on round(l.lat, 4) = round(a.lat, 4) left join b on round(l.lon, 4) = round(b.lon, 4)""",
    "affine_cell": """with g as (select min(lon) as lon0, max(lon) as lon1, min(lat) as lat0, max(lat) as lat1, count(distinct x) as nx, count(distinct y) as ny from grid_cell),
      t as (select (lon1 - lon0) / (nx - 1) as dx, (lat1 - lat0) / (ny - 1) as dy, * from g), p as (select distinct lat, lon from ordinary_event),
      c as (select lat, lon, nx, ny, cast(floor((lat1 + dy / 2 - lat) / dy) as integer) as row, cast(floor((lon - (lon0 - dx / 2)) / dx) as integer) as col from p, t)
      select round(lat, 9) as lat, round(lon, 9) as lon, row, col from c where row between 0 and ny - 1 and col between 0 and nx - 1""",
    "scaling_rates": "with t as (select model, duration_h, ln(oe::double) as y, t_pre24::double as x from tail_temp join sim_run using (run_id) where t_pre24 is not null and not isnan(t_pre24) and oe > 0), s as (select model, duration_h, regr_slope(y, x) as b, regr_intercept(y, x) as a, count(*) as n_events from t group by all having count(*) >= 50) select model, duration_h, round((exp(b) - 1) * 100, 3) as \"slope_pct_K\", round(a, 5) as intercept, n_events from s",
    "raster_bands": f"with {_LEVELS} select cast((case duration when 1 then 0 when 3 then 1 else 2 end) * 6 + list_position({PERIODS}, return_period) - 1 as integer) as band, 'RL_' || duration || 'h_' || return_period || 'yr' as band_name, cast(ny - 1 - cell // 5 as integer) as row, cell % 5 as col, round(level, 6) as level from levels, axis",
    "calendar_years": f"select run_id, cal_name, {_calendar('0')} as first_year, {_calendar('n_steps - 1')} as last_year from sim_run",
    "calendar_step_years": f"""with s as (select distinct run_id, t_i from pr_hourly where t_i is not null)
      select run_id, t_i, cal_name, {_calendar('t_i')} as year from s left join sim_run using (run_id)""",
    "union_parts": f"with {_EVENTS} select cell, duration, s0, oe_i from events_",
    "fixed_point_depth": f"with {_EVENTS} select cell, duration, s0, cast(round_even(total / 1e6::double * 10000, 0) as bigint) as depth from events_",
}
