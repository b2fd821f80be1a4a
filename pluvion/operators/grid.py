"""Dense cubes, square windows over the grid, crops and coordinates.

A cube is a long table: y, x, t (integers) and v. NULL is a missing value. Windows count an even size from ``-size/2`` to ``size/2 - 1``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def densify(sums: DataFrame, keys: list[str], t: str, v: str, lo: int | Column, hi: int | Column) -> DataFrame:
    """A row for every key and every ``t`` from ``lo`` to ``hi``; absent values are 0. An empty table stays empty."""
    every = sums.select(*keys).distinct().withColumn(t, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return every.join(sums, [*keys, t], "left").withColumn(v, F.coalesce(v, F.lit(0)))


def drizzle_to_zero(v: Column, least: float) -> Column:
    """NULL stays NULL, values under ``least`` become 0."""
    return F.when(v >= least, v).when(v.isNotNull(), F.lit(0))


def is_wet(v: Column, least: float) -> Column:
    """NULL is dry. A least amount of 0 asks for more than nothing."""
    return F.coalesce(v > 0 if least == 0 else v >= least, F.lit(False))


def bounds(size: int) -> tuple[int, int]:
    p = size // 2
    return (-p, p) if size % 2 else (-p, p - 1)


def window_sums(cube: DataFrame, size: int, y: str = "y", x: str = "x", t: str = "t", v: str = "v") -> DataFrame:
    """Adds ``n_valid`` and ``total`` of the window around each cell, as two passes of sorted frames: along x, then along y."""
    a, b = bounds(size)
    along_x = W.partitionBy(t, y).orderBy(x).rangeBetween(a, b)
    along_y = W.partitionBy(t, x).orderBy(y).rangeBetween(a, b)
    rows = cube.withColumn("_s", F.sum(v).over(along_x)).withColumn("_n", F.count(v).over(along_x))
    return rows.withColumn("total", F.sum("_s").over(along_y)).withColumn("n_valid", F.sum("_n").over(along_y)).drop("_s", "_n")


def strict_mean(cube: DataFrame, size: int, **names: str) -> DataFrame:
    """Adds ``mean``: the window's mean where all of its cells exist and are valid, else NULL."""
    return window_sums(cube, size, **names).withColumn("mean", F.when(F.col("n_valid") == size * size, F.col("total") / F.lit(float(size * size))))


def edge_mean(cube: DataFrame, size: int, ny: int | Column, nx: int | Column) -> DataFrame:
    """y, x, t, mean with the border repeated outwards: a border cell counts as often as the window reaches beyond it. Any NULL gives NULL."""
    a, b = bounds(size)
    reach = F.sequence(F.lit(a), F.lit(b))

    def passed(df: DataFrame, axis: str, n: int | Column) -> DataFrame:
        # each cell is sent to the cells whose clamped window holds it, with the number of times it does
        hits = df.withColumn("_last", F.lit(n - 1)).withColumn("_to", F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - b), F.least(F.col("_last"), F.col(axis) - a))))
        far = F.transform(reach, lambda d: F.greatest(F.lit(0), F.least(F.col("_last"), F.col("_to") + d)))
        times = F.size(F.filter(far, lambda p: p == F.col(axis)))
        other = "x" if axis == "y" else "y"
        s = hits.withColumn("_w", times).groupBy(F.col("_to").alias(axis), other, "t")
        return s.agg(F.sum(F.col("_s") * F.col("_w")).alias("_s"), F.sum(F.col("_k") * F.col("_w")).alias("_k"))

    start = cube.select("y", "x", "t", F.coalesce("v", F.lit(0)).alias("_s"), F.when(F.col("v").isNull(), 0).otherwise(1).alias("_k"))
    out = passed(passed(start, "x", nx), "y", ny)
    return out.select("y", "x", "t", F.when(F.col("_k") == size * size, F.col("_s") / F.lit(float(size * size))).alias("mean"))


def crop_odd(cells: DataFrame, size: int, ny: int | Column, nx: int) -> DataFrame:
    """Cells whose window of odd size lies inside the grid."""
    m = (size - 1) // 2
    return cells.where(F.col("y").between(m, ny - 1 - m) & F.col("x").between(m, nx - 1 - m))


def crop_even(cells: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """Cells in the bounding box of the valid windows of the first step; all cells where none is valid. ``first``: y, x, v of that step."""
    ok = strict_mean(first.withColumn("t", F.lit(0)), size).where(F.col("mean").isNotNull())
    box = ok.agg(*[f(c).alias(f"{n}{c}") for c in ("y", "x") for n, f in (("lo_", F.min), ("hi_", F.max))])
    # one row by construction
    inside = F.col("lo_y").isNull() | (F.col("y").between(F.col("lo_y"), F.col("hi_y")) & F.col("x").between(F.col("lo_x"), F.col("hi_x")))
    return cells.join(F.broadcast(box), inside).select(*cells.columns)


def nearest_axis(points: DataFrame, value: str, origin: float, step: float, n: int) -> DataFrame:
    """Adds ``i``: the index on a regular axis nearest to a coordinate, the lower one on a tie; outside the axis its end."""
    i = F.ceil((F.col(value) - F.lit(origin)) / F.lit(step) - F.lit(0.5))
    return points.withColumn("i", F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int"))


def rounded_match(points: DataFrame, axis: DataFrame, value: str, digits: int = 7) -> DataFrame:
    """Joins points to axis rows with the same coordinate at ``digits`` digits; those without one keep a NULL index, for ``all_matched`` to refuse."""
    a = axis.select(F.round("coord", digits).alias("_c"), F.col("i"))
    return points.join(a, F.round(value, digits) == F.col("_c"), "left").drop("_c")


def all_matched(points: DataFrame, index: str) -> DataFrame:
    """The points, or an error when the plan runs and a point has no index."""
    return points.withColumn(index, F.coalesce(F.col(index), F.raise_error(F.lit(f"a point is not on the grid: {index} is missing"))))


def nearest_of(points: DataFrame, axis: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the index of the axis row (columns ``by``, coord, i) nearest to a coordinate, of two as near that of the lower coordinate; NULL without an axis.

    Points and axis are put in one order, and each point sees the axis value before it and the one after it. No pairs are formed.
    """
    both = points.withColumn("_at", F.col(value)).withColumn("_axis", F.lit(None).cast("struct<at:double,i:int>")).unionByName(
        axis.select(*by, F.col("coord").alias("_at"), F.struct(F.col("coord").cast("double").alias("at"), F.col("i").cast("int").alias("i")).alias("_axis")), allowMissingColumns=True
    )
    w = W.partitionBy(*by).orderBy("_at", F.col("_axis").isNull())
    both = both.withColumn("_lo", F.last("_axis", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_hi", F.first("_axis", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    x = F.col(value)
    lower = F.col("_hi").isNull() | (x - F.col("_lo.at") <= F.col("_hi.at") - x)
    return both.where(F.col("_axis").isNull()).withColumn(name, F.when(F.col("_lo").isNotNull() & lower, F.col("_lo.i")).otherwise(F.col("_hi.i"))).drop("_at", "_axis", "_lo", "_hi")


def geotransform(cells: DataFrame) -> DataFrame:
    """One row: west, north (edges of the outermost cells), dx, dy, nx, ny, and whether y grows northwards, from cell centres lat, lon at y, x."""
    a = cells.agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"),
        F.min_by("lat", "y").alias("first"), F.max_by("lat", "y").alias("last"),
    )
    step = lambda lo, hi, n: F.when(F.col(n) > 1, (F.col(hi) - F.col(lo)) / (F.col(n) - 1))
    a = a.withColumn("dx", step("lon0", "lon1", "nx")).withColumn("dy", step("lat0", "lat1", "ny"))
    return a.select((F.col("lon0") - F.col("dx") / 2).alias("west"), (F.col("lat1") + F.col("dy") / 2).alias("north"), "dx", "dy", "nx", "ny", (F.col("last") > F.col("first")).alias("flip"))


def affine_cell(points: DataFrame, lat: str, lon: str, north: float | Column, west: float | Column, dy: float | Column, dx: float | Column) -> DataFrame:
    """Adds ``row`` (from the north) and ``col`` of the raster cell that holds a point."""
    row, col = (F.lit(north) - F.col(lat)) / F.lit(dy), (F.col(lon) - F.lit(west)) / F.lit(dx)
    return points.withColumn("row", F.floor(row).cast("int")).withColumn("col", F.floor(col).cast("int"))


def in_raster(points: DataFrame, ny: int | Column, nx: int | Column) -> DataFrame:
    return points.where((F.col("row") >= 0) & (F.col("row") < F.lit(ny)) & (F.col("col") >= 0) & (F.col("col") < F.lit(nx)))
