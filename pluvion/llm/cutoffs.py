"""A cutoff per source that keeps a target share of its records (problem 1).

Pass one builds a mergeable KLL sketch of every source (partial sketches per task, merged by Spark) and asks it for a bracket around the target
rank, wider than the sketch's rank error. Pass two counts the rows above the bracket and the rows of each value inside it. The cutoff is the value
at the target rank among them, so it is exact; should a bracket miss its rank, pass two is run again with a wider one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion.scratch import written
from pluvion.sources.tables import table, valid

#: Size of the sketches. The rank error of one sketch is below 2.3 / K ** 0.97 in 99 of 100 cases.
SKETCH_K = 4096
RANK_ERROR = 2.296 / SKETCH_K**0.9723
#: Ranks at which a sketch is read: 0, 1/GRID, ..., 1.
GRID = 1024


def kind_of(rows: DataFrame, value: str) -> str:
    """FLOAT values have sketches of their own, all other numbers those of DOUBLE."""
    return "float" if dict(rows.dtypes)[value] == "float" else "double"


def sketches(rows: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One KLL sketch of ``value`` (FLOAT or DOUBLE) per group; sketches of several days or runs go into ``merged``."""
    sketch = getattr(F, f"kll_sketch_agg_{kind_of(rows, value)}")
    return rows.where(valid(value)).groupBy(*keys).agg(sketch(value, F.lit(k)).alias("sketch"), F.count("*").alias("n_rows"))


def merged(parts: DataFrame, keys: list[str], kind: str = "float") -> DataFrame:
    return parts.groupBy(*keys).agg(getattr(F, f"kll_merge_agg_{kind}")("sketch").alias("sketch"), F.sum("n_rows").alias("n_rows"))


def kept_cutoffs(rows: DataFrame, targets: DataFrame, keys: list[str], value: str, share: str) -> DataFrame:
    """keys, ``share``, n_rows, cutoff, n_kept, n_ties, kept_share: one row per row of ``targets``.

    ``cutoff`` is the greatest value that at least ``ceil(share * n_rows)`` (one at least) of the rows reach; ``n_kept`` rows are >= cutoff, ``n_ties`` of
    them equal it. NULL and NaN are no rows. Keys that compare NULL match nothing; a target without rows gets zeros and a NULL cutoff. ``targets``
    has one row per key.
    """
    asked = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(share).alias("_share"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    kind = kind_of(rows, value)
    rows = rows.select(*keys, F.col(value).cast(kind).alias("_v")).where(valid("_v"))
    sketch = sketches(rows, keys, "_v").withColumnsRenamed({"sketch": "_sketch", "n_rows": "_rows"}).join(asked, on)
    rank = F.greatest(F.lit(1), F.ceil(F.col("_share") * F.col("_rows")))
    grid = getattr(F, f"kll_sketch_get_quantile_{kind}")("_sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    sketch = written(sketch.select(*[F.col(k).alias(f"_{k}") for k in keys], "_rows", rank.alias("_rank"), grid.alias("_grid")), "sketches")
    at = 1 - F.col("_rank") / F.col("_rows")
    width = 4 * RANK_ERROR
    while True:
        # beyond the ends the bracket is open
        below, above = F.floor((at - width) * GRID).cast("int"), F.ceil((at + width) * GRID).cast("int")
        lo = F.when(below > 0, F.get("_grid", below)).otherwise(F.lit(float("-inf")).cast(kind))
        hi = F.when(above < GRID, F.get("_grid", above)).otherwise(F.lit(float("inf")).cast(kind))
        bracket = written(sketch.withColumn("_lo", lo).withColumn("_hi", hi).drop("_grid"), "brackets")
        place = F.when(F.col("_v") > F.col("_hi"), 1).when(F.col("_v") >= F.col("_lo"), 0).otherwise(-1)
        bins = (
            rows.join(bracket, on).withColumn("_place", place)
            .groupBy(*[f"_{k}" for k in keys], "_place", F.when(F.col("_place") == 0, F.col("_v")).alias("_cut"))
            .agg(F.count("*").alias("_n"), F.first("_rows").alias("_rows"), F.first("_rank").alias("_rank"))
        )
        # distinct values of a bracket: a narrow range, however many rows
        down = W.partitionBy(*[f"_{k}" for k in keys]).orderBy(F.desc("_place"), F.desc("_cut")).rowsBetween(W.unboundedPreceding, 0)
        reached = bins.withColumn("_kept", F.sum("_n").over(down)).where((F.col("_kept") >= F.col("_rank")) & (F.col("_kept") - F.col("_n") < F.col("_rank")))
        cut = written(reached.drop("_rank"), "cutoffs")
        if width >= 1 or not cut.where("_place <> 0").limit(1).count():
            break
        width *= 8
    return targets.join(cut, on, "left").select(
        *keys, share, F.coalesce("_rows", F.lit(0)).alias("n_rows"), F.col("_cut").alias("cutoff"), F.coalesce("_kept", F.lit(0)).alias("n_kept"),
        F.coalesce("_n", F.lit(0)).alias("n_ties"), (F.col("_kept") / F.col("_rows")).alias("kept_share"),
    )


def with_model(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "sim_run").select(F.col("run_id").alias("_run"), "model")
    return df.join(runs, F.col("run_id") == F.col("_run")).drop("_run")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the cutoffs keep, each with its cutoff and whether it ties with it. Every row of the table counts, repeated ones too."""
    keys = ["model", "duration_h"]
    events = with_model(table(spark, sf_dir, "ordinary_event").select("run_id", "cell_id", "duration_h", "oe_i", "oe"), spark, sf_dir)
    cut = kept_cutoffs(events, table(spark, sf_dir, "keep_target").select(*keys, "keep_fraction"), keys, "oe", "keep_fraction")
    # written, so that the planner knows the size of the cutoffs
    cut = written(cut.where(F.col("cutoff").isNotNull()).select(*keys, "cutoff"), "cutoffs-of-sources")
    kept = events.where(valid("oe")).join(cut, keys).where(F.col("oe") >= F.col("cutoff"))
    return kept.select("run_id", "cell_id", *keys, "oe_i", "oe", "cutoff", (F.col("oe") == F.col("cutoff")).alias("is_tie"))


def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoffs and kept sizes of every model and duration, beside the class counts of ``tail_metric`` and the event numbers of ``tail_mean``."""
    keys = ["model", "duration_h"]
    events = with_model(table(spark, sf_dir, "ordinary_event").select("run_id", "duration_h", "oe"), spark, sf_dir)
    cut = kept_cutoffs(events, table(spark, sf_dir, "keep_target").select(*keys, "keep_fraction"), keys, "oe", "keep_fraction")
    classes = with_model(table(spark, sf_dir, "tail_metric").select("run_id", "duration_h", "pctl_class"), spark, sf_dir)
    classes = classes.groupBy(*keys).agg(*[F.count(F.when(F.col("pctl_class") == c, 1)).alias(f"n_class_{c}") for c in (85, 90, 95, 99)])
    means = with_model(table(spark, sf_dir, "tail_mean").select("run_id", "duration_h", "tail", "n_events"), spark, sf_dir)
    means = means.groupBy(*keys).agg(*[F.sum(F.when(F.col("tail") == t, F.col("n_events"))).alias(f"n_events_{t}") for t in ("p85", "p90", "p95", "p99")])
    cut = cut.withColumn("cutoff", F.round(F.col("cutoff").cast("double"), 6)).withColumn("kept_share", F.round("kept_share", 6))
    return cut.join(classes, keys, "left").join(means, keys, "left")


SQL = {
    "p1_cutoffs": """with r as (select model, duration_h, oe from ordinary_event join sim_run using (run_id) where oe is not null and not isnan(oe)),
      n as (select model, duration_h, keep_fraction, count(oe) as n_rows, greatest(1, cast(ceil(keep_fraction * count(oe)) as bigint)) as k
            from keep_target left join r using (model, duration_h) group by model, duration_h, keep_fraction),
      o as (select model, duration_h, oe, row_number() over (partition by model, duration_h order by oe desc) as i from r),
      c as (select model, duration_h, keep_fraction, n_rows, oe as cutoff from n left join o on n.model = o.model and n.duration_h = o.duration_h and i = k),
      k as (select c.model, c.duration_h, keep_fraction, n_rows, round(cutoff::double, 6) as cutoff, count(r.oe) as n_kept, count(case when r.oe = cutoff then 1 end) as n_ties
            from c left join r on r.model = c.model and r.duration_h = c.duration_h and r.oe >= cutoff group by 1, 2, 3, 4, c.cutoff),
      t as (select model, duration_h, """
    + ", ".join(f"count(case when pctl_class = {c} then 1 end) as n_class_{c}" for c in (85, 90, 95, 99))
    + """ from tail_metric join sim_run using (run_id) group by all),
      m as (select model, duration_h, """
    + ", ".join(f"cast(sum(case when tail = '{t}' then n_events end) as bigint) as n_events_{t}" for t in ("p85", "p90", "p95", "p99"))
    + """ from tail_mean join sim_run using (run_id) group by all)
      select k.*, round(n_kept / nullif(n_rows, 0)::double, 6) as kept_share, t.* exclude (model, duration_h), m.* exclude (model, duration_h)
      from k left join t using (model, duration_h) left join m using (model, duration_h)""",
}
SQL["p1_cutoffs"] = SQL["p1_cutoffs"].replace("select model, duration_h, keep_fraction, n_rows, oe as cutoff from n", "select n.model, n.duration_h, keep_fraction, n_rows, oe as cutoff from n")
SQL["p1_kept"] = """with r as (select * from ordinary_event join sim_run using (run_id) where oe is not null and not isnan(oe)),
  n as (select model, duration_h, max(greatest(1, cast(ceil(keep_fraction * c) as bigint))) as k
        from keep_target join (select model, duration_h, count(*) as c from r group by all) using (model, duration_h) group by all),
  o as (select model, duration_h, oe, row_number() over (partition by model, duration_h order by oe desc) as i from r),
  c as (select n.model, n.duration_h, oe as cutoff from n join o on n.model = o.model and n.duration_h = o.duration_h and i = k)
  select run_id, cell_id, r.model, r.duration_h, oe_i, oe, cutoff, oe = cutoff as is_tie from r join c on r.model = c.model and r.duration_h = c.duration_h where oe >= cutoff"""
QUERIES = {"p1_kept": p1_kept, "p1_cutoffs": p1_cutoffs}
