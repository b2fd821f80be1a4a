"""Readings recorded in different units, converted to mm/h and K (problem 5).

Labels are read from the record (field, number text, remark) and from its source (field, free text). All readings of a device (a source's instrument for
one variable) form one chain in order of time. Its hidden state is the unit that the device reports in, which it keeps for long; a single reading may be
in another unit, at a price that is small where the record itself says so. The evidence of a reading in a unit is the distance of its (log) value from
the smooth level of the device in that month, its record's label where the value is possible under it, and, for readings without one, what the source says.

Viterbi's path over the chain gives the unit of every reading. The chain is cut into stretches of time; a stretch is summed up by the best score
from each first to each last state, the sums of a device are put together, and each stretch is decoded between the states that the whole path has at its
ends. So the path is that of the whole chain, however long it is and wherever it was cut.
"""

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.scratch import written
from pluvion.sources.tables import table, valid

#: Unit, factor and offset to the common unit of its variable.
UNITS = {
    "pr": [("mm/h", 1.0, 0.0), ("mm/day", 1 / 24, 0.0), ("kg/m2/s", 3600.0, 0.0), ("m/s", 3.6e6, 0.0), ("in/h", 25.4, 0.0), ("cm/h", 10.0, 0.0), ("0.1mm/h", 0.1, 0.0)],
    "tas": [("K", 1.0, 0.0), ("degC", 1.0, 273.15), ("degF", 5 / 9, 459.67 * 5 / 9), ("0.1K", 0.1, 0.0)],
}
#: The common unit, and the range in it beyond which no reading can lie.
COMMON = {"pr": "mm/h", "tas": "K"}
POSSIBLE = {"pr": (0.004, 500.0), "tas": (200.0, 340.0)}
#: Spellings in lower case, in the order in which they are tried.
SPELLINGS = {
    "pr": [
        ("0.1mm/h", r"0[.,]1|1/10|1e-1|dixi[eè]me|zehntel|tenth|d[eé]cim|d[eé]cimas"),
        ("kg/m2/s", r"kg|kilogram|mass flux|massenfluss|flux en|flujo"),
        ("mm/day", r"mm ?/ ?d|mm ?d\W|mm/24|\bday|daily|jour|\btag\b|\bd[ií]a\b|di[aá]ri"),
        ("in/h", r"\bin ?/ ?h|\bin h|inch|pouce|pulgada|zoll"),
        ("cm/h", r"\bcm\b|cm/|centim|zentim"),
        ("mm/h", r"mm|millim"),
        ("m/s", r"\bm ?/ ?s|\bm s|met(er|re)s?\b|m[eè]tres?|metros?"),
    ],
    "tas": [
        ("0.1K", r"0[.,]1|1/10|1e-1|dixi[eè]me|zehntel|tenth|d[eé]cim"),
        ("degF", r"fahrenheit|°f|deg\w*[ _]?f\b|^f$"),
        ("degC", r"celsius|centigrad|°c|℃|deg\w*[ _]?c\b|^c$"),
        ("K", r"kelvin|deg\w*[ _]?k\b|^k$"),
    ],
}
#: Weights of the chain, in nats: a unit other than the record says, other than the source says, a unit in which the value is impossible.
OWN_WEIGHT, SOURCE_WEIGHT, IMPOSSIBLE = 40.0, 4.0, 60.0
#: A reading in another unit than its device's, without and with a label of its own; the chance that a device keeps its unit.
ASIDE, ASIDE_LABELLED, STAY = 17.0, 2.0, 0.999
#: Readings of a stretch, on average.
STRETCH_ROWS = 4000
#: Labelled readings that the level of all devices counts as beside a device's own.
SHRINK = 30


_COMPILED = {var: [(unit, re.compile(pattern)) for unit, pattern in spellings] for var, spellings in SPELLINGS.items()}
_NUMBER = re.compile(r"[^0-9+-]*([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)")


@functools.lru_cache(100_000)
def unit_of(text: str | None, var: str | None) -> str | None:
    """The unit that a label names, or None."""
    t = re.sub(r"[\[\]()]", " ", text or "").strip().lower()
    return next((unit for unit, pattern in _COMPILED.get(var, []) if t and pattern.search(t)), None)


def number_and_rest(text: str | None) -> tuple[float | None, str | None]:
    """The first number of a text (decimal comma, typographic minus and exponents included) and what follows it."""
    text = (text or "").replace("\u2212", "-")
    m = _NUMBER.match(text)
    return (float(m[1].replace(",", ".")), text[m.end() :]) if m else (None, None)


@F.pandas_udf(T.StructType([T.StructField("num", T.DoubleType()), T.StructField("own", T.StringType())]))
def read_record(var: pd.Series, val: pd.Series, val_text: pd.Series, units: pd.Series, remark: pd.Series) -> pd.DataFrame:
    texts = [number_and_rest(t) for t in val_text]
    num = val.where(val.notna(), pd.Series([n for n, _ in texts], index=val.index, dtype=float))
    own = [unit_of(u, v) or unit_of(rest, v) or unit_of(r, v) for v, u, (_, rest), r in zip(var, units, texts, remark)]
    return pd.DataFrame({"num": num, "own": own})


@F.pandas_udf(T.StringType())
def label_unit(text: pd.Series, var: pd.Series) -> pd.Series:
    return pd.Series([unit_of(t, v) for t, v in zip(text, var)], dtype=object)


def common_value(value: Column, var: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, units in UNITS.items():
        for u, factor, offset in units:
            out = F.when((var == name) & (unit == u), value * F.lit(factor) + F.lit(offset)).otherwise(out)
    return out


def possible(common: Column, var: Column) -> Column:
    """Zero precipitation says nothing against a unit."""
    (a, b), (c, d) = POSSIBLE["pr"], POSSIBLE["tas"]
    return F.coalesce(F.when(var == "pr", (common == 0) | common.between(a, b)).when(var == "tas", common.between(c, d)), F.lit(False))


def parsed(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """rec_id, source, var_name, cell_id, ts, num, own (unit the record says), said (unit its source says).

    The number is ``val`` or the first number in ``val_text`` (decimal comma, typographic minus and exponents included); NULL where there is none.
    """
    var = F.col("var_name")
    phrase = F.when(F.col("_var") == "pr", F.regexp_extract("attr_text", r"precipitation: ([^;]*)", 1)).otherwise(F.regexp_extract("attr_text", r"temperature: ([^;]*)", 1))
    field = F.when(F.col("_var") == "pr", F.col("pr_units")).otherwise(F.col("tas_units"))
    said = (
        sources.withColumn("_var", F.explode(F.array(*map(F.lit, UNITS)))).select(F.col("source").alias("_source"), "_var", field.alias("_field"), phrase.alias("_phrase"))
        .select("_source", "_var", F.coalesce(label_unit("_field", "_var"), label_unit("_phrase", "_var")).alias("said"))
    )
    rows = readings.select("rec_id", "source", "var_name", "cell_id", "ts", read_record(var, "val", "val_text", "units", "remark").alias("_r"))
    rows = rows.join(said, (F.col("source") == F.col("_source")) & (var == F.col("_var")), "left")
    return rows.select("rec_id", "source", "var_name", "cell_id", "ts", F.when(valid("_r.num"), F.col("_r.num")).alias("num"), "_r.own", "said")


def measured(common: Column, var: Column) -> Column:
    """The scale of the level: log10 mm/h, or K."""
    return F.when(var == "pr", F.when(common > 0, F.log10(common))).otherwise(common)


def moves(n: int) -> np.ndarray:
    out = np.full((n, n), np.log((1 - STAY) / (n - 1)))
    np.fill_diagonal(out, np.log(STAY))
    return out


def evidence(rows: pd.DataFrame, var: str) -> tuple[np.ndarray, np.ndarray]:
    """Score of each reading for each unit of its device, and the unit that the reading has then (readings x units)."""
    units = UNITS[var]
    names = np.array([u for u, _, _ in units])
    lo, hi = POSSIBLE[var]
    v = rows["num"].to_numpy(float)[:, None] * np.array([f for _, f, _ in units]) + np.array([o for _, _, o in units])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log10(v) if var == "pr" else v
    z = (x - rows["level"].to_numpy(float)[:, None]) / rows["spread"].to_numpy(float)[:, None]
    fit = np.where(np.isfinite(z), -0.5 * np.minimum(z * z, 2 * IMPOSSIBLE), 0.0)
    out = ~((v >= lo) & (v <= hi))
    if var == "pr":
        out &= v != 0
    fit = np.where(out, -IMPOSSIBLE, fit)
    says = rows["own"].to_numpy()[:, None] == names
    labelled = (says & ~out).any(axis=1)
    fit -= OWN_WEIGHT * (labelled[:, None] & ~says)
    best = fit.argmax(axis=1)
    aside = fit.max(axis=1) - np.where(labelled, ASIDE_LABELLED, ASIDE)
    unit = np.where(fit >= aside[:, None], np.arange(len(names)), best[:, None])
    said = rows["said"].to_numpy()
    against = (said[:, None] != names) & (pd.notna(said) & ~labelled)[:, None]
    return np.maximum(fit, aside[:, None]) - SOURCE_WEIGHT * against, unit


def joined(left: np.ndarray, right: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best scores from first to last state of neighbouring stretches together, many pairs at once (pairs x states x states)."""
    over = (left[:, :, :, None] + move).max(axis=2)
    return (over[:, :, :, None] + right[:, None]).max(axis=2)


def summed(parts: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """The tree of joined neighbours over successive parts, the whole at its end."""
    tree = [parts]
    while len(tree[-1]) > 1:
        at = tree[-1]
        n = len(at) // 2 * 2
        tree.append(np.concatenate([joined(at[0:n:2], at[1:n:2], move), at[n:]]))
    return tree


def ends_of_parts(tree: list[np.ndarray], move: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last state of every part on the best path from state ``first`` to ``last``, from the root of the tree down."""
    i, j = np.array([first]), np.array([last])
    for at in reversed(tree[:-1]):
        n = len(at) // 2
        k, s = np.arange(n), at.shape[1]
        best = (at[0 : 2 * n : 2][k, i[:n]][:, :, None] + move + at[1 : 2 * n : 2][k, :, j[:n]][:, None, :]).reshape(n, -1).argmax(axis=1)
        lower_i, lower_j = np.empty(len(at), int), np.empty(len(at), int)
        lower_i[0 : 2 * n : 2], lower_j[0 : 2 * n : 2] = i[:n], best // s
        lower_i[1 : 2 * n : 2], lower_j[1 : 2 * n : 2] = best % s, j[:n]
        lower_i[2 * n :], lower_j[2 * n :] = i[n:], j[n:]
        i, j = lower_i, lower_j
    return i, j


def readings_tree(rows: pd.DataFrame, var: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The tree over the single readings of a stretch in order of time, the moves, and the unit of each reading for each state."""
    score, unit = evidence(rows, var)
    leaves = np.full((*score.shape, score.shape[1]), -np.inf)
    leaves[:, np.arange(score.shape[1]), np.arange(score.shape[1])] = score
    move = moves(score.shape[1])
    return summed(leaves, move), move, unit


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["us", "rec_id"], na_position="last", kind="stable")


CHAIN = ["_dev", "var_name"]
STRETCH = [*CHAIN, "_stretch"]


def stretch_sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree, _, _ = readings_tree(in_order(rows), key[1])
    return pd.DataFrame({"_dev": [key[0]], "var_name": [key[1]], "_stretch": [key[2]], "m": [tree[-1][0].ravel().tolist()]})


def stretch_ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One device: the states of the whole best path at the ends of its stretches. A group is one row a stretch, that is one for ``STRETCH_ROWS`` readings."""
    rows = rows.sort_values("_stretch", ignore_index=True)
    s = len(UNITS[key[1]])
    move = moves(s)
    tree = summed(np.stack([np.reshape(m, (s, s)) for m in rows["m"]]), move)
    i, j = ends_of_parts(tree, move, *np.unravel_index(tree[-1][0].argmax(), (s, s)))
    return pd.DataFrame({"_dev": key[0], "var_name": key[1], "_stretch": rows["_stretch"], "_i": i.astype("int32"), "_j": j.astype("int32")})


def stretch_units(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = in_order(rows)
    tree, move, unit = readings_tree(rows, key[1])
    path, _ = ends_of_parts(tree, move, int(rows["_i"].iloc[0]), int(rows["_j"].iloc[0]))
    names = np.array([u for u, _, _ in UNITS[key[1]]], dtype=object)
    return pd.DataFrame({"rec_id": rows["rec_id"], "source": rows["source"], "var_name": key[1], "num": rows["num"], "unit": names[unit[np.arange(len(rows)), path]]})


def levels(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the readings with a possible label: number and sum by device and month, and mean and deviation of all devices by month; month 0 is the whole year."""
    var = F.col("var_name")
    common = common_value(F.col("num"), var, F.col("own"))
    x = p.where(F.col("num").isNotNull() & possible(common, var)).select(*CHAIN, F.explode(F.array_compact(F.array(F.month("ts"), F.lit(0)))).alias("_month"), measured(common, var).alias("x"))
    own = x.groupBy(*CHAIN, "_month").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    own = written(own, "device-levels")
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    every = own.groupBy(F.col("var_name").alias("_var"), F.col("_month").alias("_m")).agg(n.alias("_n"), F.try_divide(s, n).alias("_mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q, n) - F.pow(F.try_divide(s, n), 2))).alias("_sd"))
    return own, written(every, "levels")


def chains(p: DataFrame) -> DataFrame:
    """The readings of known variables with level, spread and the number of their stretch, in order of time; readings without a time come after all others."""
    var = F.col("var_name")
    own, every = levels(p)
    rows = p.where(F.col("num").isNotNull() & var.isin(list(UNITS))).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_month", F.coalesce(F.month("ts"), F.lit(0)))
    sizes = rows.groupBy(*CHAIN).agg(F.count("us").alias("_rows"), F.min("us").alias("_t0"), F.max("us").alias("_t1"))
    rows = rows.join(written(sizes, "devices"), CHAIN)
    width = (F.col("_t1") - F.col("_t0") + 1) / F.ceil(F.col("_rows") / STRETCH_ROWS)
    place = (F.col("us") - F.col("_t0")) / width
    # without a time: a part of its own at the end
    rows = rows.withColumn("_part", F.coalesce(F.floor(place), F.lit(1 << 30))).withColumn("_within", F.coalesce(place - F.floor(place), F.pmod(F.xxhash64("rec_id"), F.lit(1000)) / 1000.0))
    # a part of time with many more readings than others is cut again
    crowd = written(rows.groupBy(*CHAIN, "_part").agg(F.ceil(F.count("*") / (2 * STRETCH_ROWS)).alias("_cuts")), "parts")
    rows = rows.join(crowd, [*CHAIN, "_part"]).withColumn("_stretch", F.col("_part") * (1 << 30) + F.floor(F.col("_within") * F.col("_cuts")))
    rows = rows.join(own.select(*CHAIN, "_month", "n", "s"), [*CHAIN, "_month"], "left").join(every, (var == F.col("_var")) & (F.col("_month") == F.col("_m")), "left")
    year = every.where("_m = 0").select(F.col("_var").alias("_v0"), F.col("_mean").alias("_mean0"), F.col("_sd").alias("_sd0"))
    rows = rows.join(year, var == F.col("_v0"), "left")
    few = F.coalesce(F.col("_n"), F.lit(0)) < SHRINK
    # without any labelled reading the chain starts from a typical wet hour and a mild day
    normal = F.coalesce(F.when(~few, F.col("_mean")), F.col("_mean0"), F.when(var == "pr", F.lit(0.1)).otherwise(F.lit(283.0)))
    spread = F.greatest(F.coalesce(F.when(~few, F.col("_sd")), F.col("_sd0"), F.lit(0.0)), F.when(var == "pr", F.lit(0.4)).otherwise(F.lit(6.0)))
    level = (F.coalesce("s", F.lit(0.0)) + normal * SHRINK) / (F.coalesce("n", F.lit(0)) + SHRINK)
    return rows.select(*STRETCH, "rec_id", "source", "us", "num", "own", "said", level.alias("level"), spread.alias("spread"))


def converted(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """rec_id, source, var_name, unit, value: every record, its true unit, and its number in mm/h or K.

    Records without a number have NULL unit and value; those of another variable than pr and tas too. Records without a source form a chain of their own,
    those without a time come last in theirs. A record sent twice is decoded twice. An empty table gives no rows.
    """
    device = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))
    p = written(parsed(readings, sources).withColumn("_dev", device), "parsed-readings")
    rows = chains(p)
    sums = rows.groupBy(*STRETCH).applyInPandas(stretch_sum, "_dev string, var_name string, _stretch bigint, m array<double>")
    ends = written(sums.groupBy(*CHAIN).applyInPandas(stretch_ends, "_dev string, var_name string, _stretch bigint, _i int, _j int"), "stretch-ends")
    units = rows.join(ends, STRETCH).groupBy(*STRETCH).applyInPandas(stretch_units, "rec_id bigint, source string, var_name string, num double, unit string")
    none = p.where(F.col("num").isNull() | ~F.coalesce(F.col("var_name").isin(list(UNITS)), F.lit(False)))
    every = units.unionByName(none.select("rec_id", "source", "var_name", "num", F.lit(None).cast("string").alias("unit")))
    return every.select("rec_id", "source", "var_name", "unit", common_value(F.col("num"), F.col("var_name"), F.col("unit")).alias("value"))


def p5_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(table(spark, sf_dir, "raw_reading"), table(spark, sf_dir, "raw_source"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_converted(spark, sf_dir).where(~F.col("unit").isin(list(COMMON.values()))).select("rec_id", "unit")


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_converted": p5_converted}
