"""The field around an event's peak, and how its intensity is spread over the window."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pluvion.operators.grid import bounds, drizzle_to_zero


def fields(events: DataFrame, cube: DataFrame, event_keys: list[str], size: int, least: int, durations: list[int]) -> DataFrame:
    """event keys, duration, dy, dx, f: the sum over the duration's steps around the peak of each cell of the window; drizzle is zero.

    ``events``: event keys, y, x, duration, oe_i; ``cube``: y, x, t, v. The moving sums in time are made once per cell and duration, whatever the number of
    events; an event asks for those of its window at its peak, by an equal join on (y, x, t). Steps outside the record add nothing; cells outside the grid
    give no row; a NULL step gives a NULL field.
    """
    a, b = bounds(size)
    reach = F.sequence(F.lit(a), F.lit(b))
    series = W.partitionBy("y", "x").orderBy("t")
    moving = cube.select("y", "x", "t", drizzle_to_zero(F.col("v"), least).alias("v"))
    for k in durations:
        frame = series.rangeBetween(-(k // 2), (k - 1) // 2)
        moving = moving.withColumn(f"_f{k}", F.when(F.count("v").over(frame) == F.count("*").over(frame), F.sum("v").over(frame)))
    asked = (
        events.withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach))
        .select(*event_keys, "duration", "dy", "dx", F.col("oe_i").alias("t"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    )
    f = F.coalesce(*[F.when(F.col("duration") == k, F.col(f"_f{k}")) for k in durations])
    return asked.join(moving.drop("v"), ["y", "x", "t"]).select(*event_keys, "duration", "dy", "dx", f.alias("f"))


def metrics(field: DataFrame, event_keys: list[str], size: int, fractions: tuple[float, ...] = (0.5,), alphas: tuple[float, ...] = (0.5,)) -> DataFrame:
    """event keys, duration, cv, rg_norm, a_N and a_N_cells of each fraction, pca_N of each alpha, of the events whose whole window lies in the grid, without NULLs.

    cv: population deviation over mean. rg_norm: radius of gyration over that of an even field, 0 for an empty one. a_N: share of the window that holds N percent
    of the total, taking cells from the greatest on. pca_N: share of cells at N percent of the maximum or more. Empty fields have NULL cv, a_N and pca_N.
    """
    keys = [*event_keys, "duration"]
    cells = size * size
    w = W.partitionBy(*keys)
    rows = field.withColumn("_n", F.count("f").over(w)).where(F.col("_n") == cells)
    down = w.orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_tot", F.sum("f").over(w)).withColumn("_max", F.max("f").over(w)).withColumn("_cum", F.sum("f").over(down)).withColumn("_i", F.row_number().over(w.orderBy(F.desc("f"))))
    f = F.col("f").cast("double")
    percent = lambda share: round(share * 100)
    s = rows.groupBy(*keys).agg(
        F.first("_tot").alias("tot"), F.stddev_pop(f).alias("sd"), F.avg(f).alias("m"), *[F.sum(f * e).alias(n) for n, e in (("fy", F.col("dy")), ("fx", F.col("dx")), ("fyy", F.col("dy") * F.col("dy")), ("fxx", F.col("dx") * F.col("dx")))],
        *[F.min(F.when(F.col("_cum") * 100 >= F.col("_tot") * percent(q), F.col("_i"))).alias(f"_a{percent(q)}") for q in fractions],
        *[F.sum(F.when(F.col("f") * 100 >= F.col("_max") * percent(q), 1).otherwise(0)).alias(f"_p{percent(q)}") for q in alphas],
    )
    tot = F.col("tot").cast("double")
    spread = F.col("fyy") / tot - F.pow(F.col("fy") / tot, 2) + F.col("fxx") / tot - F.pow(F.col("fx") / tot, 2)
    some = F.col("tot") > 0
    a = [(F.when(some, F.col(f"_a{p}") / F.lit(float(cells))).alias(f"a_{p}"), F.when(some, F.col(f"_a{p}")).alias(f"a_{p}_cells")) for p in map(percent, fractions)]
    return s.select(
        *keys, F.when(some, F.col("sd") / F.col("m")).alias("cv"),
        F.when(some, F.sqrt(F.greatest(F.lit(0.0), spread)) / F.lit(((cells - 1) / 6) ** 0.5)).otherwise(0.0).alias("rg_norm"),
        *[c for pair in a for c in pair], *[F.when(some, F.col(f"_p{p}") / F.lit(float(cells))).alias(f"pca_{p}") for p in map(percent, alphas)],
    )
