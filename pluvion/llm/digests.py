"""Percentiles per group with deterministic rank error, from digests that can be put together (problem 3).

Values are quantised to an ordered universe of 2**18 codes, 800 to each doubling of the magnitude (a relative width of 0.09 %). A digest is a set
of nodes of the binary tree over the codes with their counts (Shrivastava et al., "Medians and Beyond", 2004): a node and its sibling are moved into their parent
where the three counts together stay under the number of rows above the parent's range over K. So the error shrinks towards the top, where high percentiles
are asked for: the answer at a rank is wrong by at most 18 * floor(rows above it / K) ranks. Digests of parts (tasks, runs, years, days) are merged by
adding the counts of equal nodes; the rows above a range add up as well, so the bound is the same for merged digests, however the rows were split.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pluvion.llm.cutoffs import with_model
from pluvion.scratch import written
from pluvion.sources.tables import table, valid

BITS, PER_OCTAVE, LOWEST = 18, 800, -16
HALF = 1 << (BITS - 1)
HIGHEST = LOWEST + HALF / PER_OCTAVE
#: Compression: the rank error is BITS * floor(rows above / K).
K = 4000
#: Counts that a task holds before it compresses them.
TASK_NODES = 2_000_000
PERCENTILES = (0.5, 0.9, 0.99, 0.999)


def code(value: Column) -> Column:
    """The place of a number in the universe. Magnitudes under 2**-16 count as 0; those over 2**147, which no FLOAT has, share the last code."""
    v = value.cast("double")
    magnitude = F.floor((F.log2(F.abs(v)) - LOWEST) * PER_OCTAVE)
    step = F.least(F.lit(HALF - 1), F.greatest(F.lit(0), magnitude)).cast("int")
    return F.when(F.abs(v) < 2.0**LOWEST, F.lit(HALF)).when(v > 0, step + HALF).otherwise(F.lit(HALF - 1) - step)


def value_of(code_col: Column, upper: bool) -> Column:
    """The lower or upper edge of a code. The outermost codes reach to infinity."""
    step = F.when(code_col >= HALF, code_col - HALF + (1 if upper else 0)).otherwise(F.lit(HALF - 1) - code_col + (0 if upper else 1))
    size = F.when(step >= HALF, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), step / PER_OCTAVE + LOWEST))
    size = F.when((code_col >= HALF) & (step == 0), F.lit(0.0)).otherwise(size)
    return F.when(code_col >= HALF, size).otherwise(-size)


def compressed(node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves small nodes into their parents, leaves first. Nodes are numbered as in a heap: the root is 1, the leaf of code c is 2**18 + c."""
    depth = np.frexp(node.astype(float))[1] - 1
    first = (node << (BITS - depth)) - (1 << BITS)
    order = np.argsort(first, kind="stable")
    starts, upto, total = first[order], np.cumsum(count[order]), count.sum()

    def small(parents: np.ndarray, d: int) -> np.ndarray:
        # nodes that begin behind the parent's last code lie above its range, now and when their own counts have moved up
        last = ((parents + 1) << (BITS - d)) - (1 << BITS) - 1
        i = np.searchsorted(starts, last, "right")
        return (total - np.where(i > 0, upto[np.maximum(i, 1) - 1], 0)) // k

    kept_nodes, kept_counts = [], []
    level_n, level_c = node[depth == BITS], count[depth == BITS]
    for d in range(BITS, 0, -1):
        up_n, up_c = node[depth == d - 1], count[depth == d - 1]
        if len(level_n):
            parents, inverse = np.unique(np.concatenate((level_n >> 1, up_n)), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate((level_c, up_c))).astype(np.int64)
            moves = (sums <= small(parents, d - 1))[inverse[: len(level_n)]]
            kept_nodes.append(level_n[~moves])
            kept_counts.append(level_c[~moves])
            up_n, inverse = np.unique(np.concatenate((up_n, level_n[moves] >> 1)), return_inverse=True)
            up_c = np.bincount(inverse, weights=np.concatenate((up_c, level_c[moves])), minlength=len(up_n)).astype(np.int64)
        level_n, level_c = up_n, up_c
    return np.concatenate([*kept_nodes, level_n]), np.concatenate([*kept_counts, level_c])


def compress(nodes: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Compresses the digest of each key. A group is at most the nodes of the universe, however many rows it counts."""
    schema = T.StructType([nodes.schema[c] for c in keys] + [T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, n = compressed(pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), k)
        out = pd.DataFrame({"node": node.astype(np.int32), "n": n})
        for i, (name, v) in enumerate(zip(keys, key)):
            out.insert(i, name, pd.Series([v] * len(out), dtype=pdf[name].dtype))
        return out

    return nodes.groupBy(*keys).applyInPandas(one, schema)


def digests(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, node, n: the digest of every group. Each task makes digests of its own rows, which are then merged, so a group of any size spreads out.

    NULL and NaN are left out; a NULL key is a group of its own.
    """
    leaves = rows.where(valid(value)).select(*keys, (code(F.col(value)) + (1 << BITS)).cast("int").alias("node"))
    schema = T.StructType([*leaves.schema.fields, T.StructField("n", T.LongType())])

    def folded(parts: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(parts).group_by([*keys, "node"], use_threads=False).aggregate([("n", "sum")])
        return out.select([*keys, "node", "n_sum"]).rename_columns([*keys, "node", "n"])

    def smaller(held: pa.Table) -> pa.Table:
        # a group of fewer rows than k has nothing to compress
        rows = held.group_by(keys, use_threads=False).aggregate([("n", "sum")])
        if pc.max(rows["n_sum"]).as_py() < k:
            return held
        out = []
        for _, g in held.to_pandas().groupby(keys, dropna=False, sort=False):
            if g["n"].sum() >= k:
                node, n = compressed(g["node"].to_numpy(np.int64), g["n"].to_numpy(np.int64), k)
                g = g.iloc[: len(node)].assign(node=node.astype(np.int32), n=n)
            out.append(g)
        out = pd.concat(out)
        out = out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in keys})
        return pa.Table.from_pandas(out, schema=held.schema, preserve_index=False)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, most = [], 0, TASK_NODES
        for b in batches:
            parts.append(pa.Table.from_batches([b]).append_column("n", pa.array(np.ones(b.num_rows, np.int64))))
            size += b.num_rows
            if size > most:
                parts = [smaller(folded(parts))]
                size = parts[0].num_rows
                most = max(TASK_NODES, 2 * size)
        if size:
            yield from smaller(folded(parts)).to_batches()

    return merge(leaves.mapInArrow(task, schema), keys, k)


def merge(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The digest of each key from those of its parts."""
    return compress(parts.groupBy(*keys, "node").agg(F.sum("n").alias("n")), keys, k)


def percentiles(digest: DataFrame, keys: list[str], shares: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """keys, n_rows, share, value_lo, value (upper edge), rank_error (rows): the value at rank ``ceil(share * n_rows)`` up to the error.

    The bounds are those of the value's code; an answer above 2**147 has none.
    """
    depth = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    height = F.lit(BITS) - F.col("depth")
    first = F.expr(f"shiftleft(node, {BITS} - depth)") - (1 << BITS)
    last = first + F.expr(f"shiftleft(1, {BITS} - depth)") - 1
    # nodes by right end, the smaller one first
    w = W.partitionBy(*keys).orderBy("last", "height")
    cum = (
        digest.withColumn("depth", depth).withColumn("height", height).withColumn("first", first).withColumn("last", last)
        .withColumn("upto", F.sum("n").over(w)).withColumn("n_rows", F.sum("n").over(W.partitionBy(*keys)))
    )
    asked = cum.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n_rows")))
    hit = asked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    error = F.floor((F.col("n_rows") - rank) / k).cast("bigint") * BITS
    return hit.select(*keys, "n_rows", "share", F.round(value_of(F.col("first"), False), 9).alias("value_lo"), F.round(value_of(F.col("last"), True), 9).alias("value"), error.alias("rank_error"))


def p3_percentiles_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and high percentiles of every model and duration, merged from the digests of its years."""
    rows = with_model(table(spark, sf_dir, "ordinary_event").select("run_id", "duration_h", "year", "oe"), spark, sf_dir)
    return percentiles(merge(digests(rows, ["model", "duration_h", "year"], "oe"), ["model", "duration_h"]), ["model", "duration_h"])


def p3_digests_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests themselves, per model, duration and year, to be kept and merged with those of later years."""
    rows = with_model(table(spark, sf_dir, "ordinary_event").select("run_id", "duration_h", "year", "oe"), spark, sf_dir)
    return digests(rows, ["model", "duration_h", "year"], "oe")


def p3_percentiles_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per lat and lon, at four digits: some models went through single precision."""
    at = table(spark, sf_dir, "ordinary_event").select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "oe")
    return percentiles(digests(at, ["lat", "lon"], "oe"), ["lat", "lon"])


def p3_rank_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of ``p3_percentiles_model`` held against all rows: whether the rank that was asked for lies in its bounds, up to the stated error."""
    keys = ["model", "duration_h"]
    # five columns of at most four answers for each of the 50 models and durations: written, so that its size decides how it is joined
    asked = written(p3_percentiles_model(spark, sf_dir), "percentiles")
    answers = asked.groupBy(*keys).agg(F.collect_list(F.struct("share", "value_lo", "value", "rank_error", "n_rows")).alias("a"))
    rows = with_model(table(spark, sf_dir, "ordinary_event").select("run_id", "duration_h", "oe"), spark, sf_dir).where(valid("oe"))
    v, w = F.col("oe").cast("double"), 1e-9
    each = rows.join(answers, keys).select(*keys, v.alias("v"), F.explode("a").alias("a"))
    slack = lambda c: w * (1 + F.abs(c))
    under, upto = F.col("v") < F.col("a.value_lo") - slack(F.col("a.value_lo")), F.col("v") <= F.col("a.value") + slack(F.col("a.value"))
    n = each.groupBy(*keys, F.col("a.share").alias("share"), F.col("a.n_rows").alias("n_rows"), F.col("a.rank_error").alias("e")).agg(F.count(F.when(under, 1)).alias("under"), F.count(F.when(upto, 1)).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n_rows")))
    return n.select(*keys, "share", "n_rows", ((F.col("under") - F.col("e") < rank) & (rank <= F.col("upto") + F.col("e"))).alias("within"))


SQL: dict[str, str] = {
    "p3_rank_bounds": f"""with r as (select model, duration_h, count(*) as n_rows from ordinary_event join sim_run using (run_id) where oe is not null and not isnan(oe) group by all)
      select model, duration_h, unnest({list(PERCENTILES)})::double as share, n_rows, true as within from r""",
}
QUERIES = {"p3_percentiles_model": p3_percentiles_model, "p3_percentiles_cell": p3_percentiles_cell, "p3_digests_year": p3_digests_year, "p3_rank_bounds": p3_rank_bounds}
