"""The runs of the chain, from the stored tables to the output tables.

    python -m pluvion.run --data DIR --out DIR [--settings FILE] [--niter N] extract | metrics | uncertainty | tpre24 | tpre24_means | scaling | both

``extract`` writes events, maxima, parameters and levels (and intervals, where the settings ask for them); the others begin from the events that it wrote.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion import config, sinks
from pluvion.operators import fit
from pluvion.plans import series
from pluvion.scratch import written

MODES = ("extract", "metrics", "uncertainty", "tpre24", "tpre24_means", "scaling", "both")


def extract(spark: SparkSession, data: str, out: str, s: dict) -> None:
    runs = series.runs(spark, data)
    e = written(series.events(spark, data, s), "series-events")
    sinks.write(e, "events", out, s, runs)
    sinks.write(series.maxima(e), "maxima", out, s, runs)
    p = written(series.parameters(e, s), "parameters")
    sinks.write(p, "parameters", out, s, runs)
    sinks.write(fit.return_levels(p, s["return_periods"]), "levels", out, s, runs)
    if s["uncertainty"]["enabled"]:
        sinks.write(intervals(spark, data, e, s), "intervals", out, s)


def stored(spark: SparkSession, data: str, out: str) -> DataFrame:
    """The events that a former run wrote, with place, period and whole totals."""
    e = sinks.read(spark, "events", out).join(series.table(spark, data, "grid_cell").select("cell_id", "y", "x"), "cell_id")
    total = F.bround(F.col("oe").cast("double") * F.col("duration_h") * series.UNIT).cast("bigint")
    return e.withColumn("oe", F.col("oe").cast("double")).withColumn("total", total)


def intervals(spark: SparkSession, data: str, e: DataFrame, s: dict) -> DataFrame:
    return series.bootstrapped(e.where((F.col("oe") > 0) & (F.col("oe") < float("inf"))), series.table(spark, data, "grid_cell"), s)


def uncertainty(spark: SparkSession, data: str, out: str, s: dict) -> None:
    sinks.write(intervals(spark, data, stored(spark, data, out), s), "intervals", out, s)


def metrics(spark: SparkSession, data: str, out: str, s: dict) -> None:
    sinks.write(series.single_cell_metrics(stored(spark, data, out), s), "tail_metrics", out, s, series.runs(spark, data))


def temperatures(spark: SparkSession, data: str, out: str, s: dict, mode: str) -> None:
    runs = series.runs(spark, data)
    p = written(series.pairs(spark, data, stored(spark, data, out), s), "series-pairs")
    place = p.select(*series.SERIES, "lat", "lon").distinct()
    if mode in ("tpre24", "both"):
        sinks.write(series.tail_events(p), "tail_events", out, s, runs)
    if mode == "tpre24_means":
        sinks.write(series.tail_means(p).join(place, series.SERIES), "tail_means", out, s, runs)
    if mode in ("scaling", "both"):
        sinks.write(series.scaling_table(p, s).join(place, series.SERIES), "scaling", out, s, runs)


def run(spark: SparkSession, data: str, out: str, mode: str = "extract", s: dict | None = None) -> None:
    s = config.checked(s or config.load())
    if mode not in MODES:
        raise config.SettingError(f"mode: must be one of {', '.join(MODES)}")
    if mode in ("extract", "metrics", "uncertainty"):
        {"extract": extract, "metrics": metrics, "uncertainty": uncertainty}[mode](spark, data, out, s)
    else:
        temperatures(spark, data, out, s, mode)


def main() -> None:
    a = argparse.ArgumentParser(description="Runs a stage of the chain.")
    a.add_argument("mode", choices=MODES)
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--settings")
    a.add_argument("--niter", type=int)
    args = a.parse_args()
    s = config.from_yaml(args.settings) if args.settings else config.load()
    if args.niter:
        s = config.merged(s, {"uncertainty": {"niter": args.niter}})
    spark = SparkSession.builder.appName("pluvion").getOrCreate()
    run(spark, args.data, args.out, args.mode, s)
    spark.stop()


if __name__ == "__main__":
    main()
