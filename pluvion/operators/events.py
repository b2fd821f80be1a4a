"""Independent events in the series of a dense cube: storms, their filters, peaks per duration, annual maxima."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def in_storms(cube: DataFrame, keys: list[str], wet: Column, sep: int, t: str = "t") -> DataFrame:
    """The rows of a cube that lie in a storm, with ``no``, ``s0`` and ``s1``.

    Wet steps belong together unless more than ``sep`` steps apart; equality stays together. Dry steps between are kept, where the cube has them. One sort per series.
    """
    w = W.partitionBy(*keys).orderBy(t)
    at = F.when(wet, F.col(t))
    before = F.max(at).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = cube.withColumn("_at", at).withColumn("_new", F.when(wet & (before.isNull() | (F.col(t) - before > sep)), 1).otherwise(0))
    rows = rows.withColumn("no", F.sum("_new").over(w)).where(F.col("no") > 0)
    storm = W.partitionBy(*keys, "no")
    return rows.withColumn("s0", F.min("_at").over(storm)).withColumn("s1", F.max("_at").over(storm)).where(F.col(t) <= F.col("s1")).drop("_at", "_new")


def filled(rows: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """keys, no, s0, s1, t, v: the rows of storms with a row of 0 for every step inside a storm that has none. ``rows`` come from ``in_storms`` over the stored steps alone.

    Steps that are not stored are dry, so storms can be found without them, and only those between two rows of one storm are made. No join, no further shuffle.
    """
    until = F.coalesce(F.lead(t).over(W.partitionBy(*keys, "no").orderBy(t)) - 1, F.col(t))
    every = rows.withColumn("_until", until).withColumn("_t", F.explode(F.sequence(t, "_until")))
    return every.select(*keys, "no", "s0", "s1", F.col("_t").alias(t), F.when(F.col("_t") == F.col(t), F.col(v)).otherwise(F.lit(0)).alias(v))


def storms(wet_steps: DataFrame, keys: list[str], sep: int, t: str = "t") -> DataFrame:
    """keys, s0, s1, n_wet from the wet steps alone."""
    w = W.partitionBy(*keys).orderBy(t)
    rows = wet_steps.withColumn("_new", F.when(F.col(t) - F.lag(t).over(w) <= sep, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_no").agg(F.min(t).alias("s0"), F.max(t).alias("s1"), F.count("*").alias("n_wet")).drop("_no")


def longer_than(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("s1") - F.col("s0") + 1 >= least)


def away_from_edges(df: DataFrame, sep: int, first: int | Column, last: int | Column) -> DataFrame:
    """Drops storms that begin less than ``sep`` steps after the record's first step or end less than that before its last."""
    return df.where((F.col("s0") - first >= sep) & (F.lit(last) - F.col("s1") >= sep))


def away_from_gaps(df: DataFrame, wet_steps: DataFrame, gaps: list[tuple[int, int]], keys: list[str], sep: int, t: str = "t") -> DataFrame:
    """Drops storms with a wet step in the ``sep`` steps before the last step before a gap, or in the ``sep`` steps from the first step after it on.

    ``gaps``: (last step before, first step after). Half open: the last step before a gap does no harm by itself.
    """
    near = F.lit(False)
    for before, after in gaps:
        near = near | ((F.col(t) >= before - sep) & (F.col(t) < before)) | ((F.col(t) >= after) & (F.col(t) < after + sep))
    hit = wet_steps.where(near).select(*keys, F.col(t).alias("_at"))
    # a wet step near a gap lies in at most one storm of its series: as of the last storm that began before it
    w = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = df.select(*keys, F.col("s0").alias("_at"), F.lit(0).alias("_kind"), "s0").unionByName(hit.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    bad = both.withColumn("s0", F.last("s0", ignorenulls=True).over(w)).where("_kind = 1 and s0 is not null").select(*keys, "s0").distinct()
    return df.join(bad, [*keys, "s0"], "left_anti")


def peaks(rows: DataFrame, keys: list[str], durations: list[int], t: str = "t", v: str = "v") -> DataFrame:
    """keys, duration, s0, s1, total, oe_i: the greatest moving sum of every storm and duration, at its first place.

    The frame of ``k`` steps reaches from ``k/2`` before to ``(k-1)/2`` after, within the storm; a storm shorter than ``k`` gives its whole sum at its middle.
    A frame with a NULL does not count. ``rows`` come from ``in_storms``.
    """
    storm = W.partitionBy(*keys, "no").orderBy(t)
    sums = rows
    for k in durations:
        frame = storm.rowsBetween(-(k // 2), (k - 1) // 2)
        sums = sums.withColumn(f"_m{k}", F.when(F.count(v).over(frame) == F.count("*").over(frame), F.sum(v).over(frame)))
    best = sums.groupBy(*keys, "no").agg(
        F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.sum(v).alias("_all"), F.count(v).alias("_n"),
        *[F.max(F.when(F.col(f"_m{k}").isNotNull(), F.struct(F.col(f"_m{k}").alias("m"), (-F.col(t)).alias("t")))).alias(f"_b{k}") for k in durations],
    )
    m = F.col("s1") - F.col("s0") + 1
    whole = F.when(F.col("_n") == m, F.col("_all"))
    each = [
        F.struct(F.lit(k).alias("duration"), F.when(m < k, whole).otherwise(F.col(f"_b{k}.m")).alias("total"), F.when(m < k, F.col("s0") + F.floor(m / 2)).otherwise(-F.col(f"_b{k}.t")).cast("int").alias("oe_i"))
        for k in durations
    ]
    out = best.withColumn("_e", F.explode(F.array(*each))).select(*keys, "_e.duration", "s0", "s1", "_e.total", "_e.oe_i")
    return out.where(F.col("total").isNotNull())


def annual_maxima(events: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest event of each key and year, the first one on a tie."""
    rest = [c for c in events.columns if c not in (*keys, "year", "total", "s0")]
    best = F.max(F.struct("total", (-F.col("s0")).alias("_s0"), *rest)).alias("_b")
    return events.groupBy(*keys, "year").agg(best).select(*keys, "year", "_b.total", (-F.col("_b._s0")).alias("s0"), *[f"_b.{c}" for c in rest])


def complete_years(rows: DataFrame, keys: list[str], year: str, v: str, expected: float, tolerance: float) -> DataFrame:
    """The rows of each key's years of which a share of 1 - tolerance at least of ``expected`` steps is valid; missing values of those years become 0."""
    good = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    share = F.count(F.when(good, 1)).over(W.partitionBy(*keys, year)) / F.lit(float(expected))
    kept = rows.withColumn("_share", share).where(F.col("_share") >= 1 - tolerance).drop("_share")
    return kept.withColumn(v, F.when(good, F.col(v)).otherwise(F.lit(0).cast(rows.schema[v].dataType)))
