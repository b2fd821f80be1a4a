"""The output tables of the chain, in their stated schemas, as Parquet by model, period and window size."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion import config

_PLACE = "run_id int, cell_id int, lat double, lon double, duration_h tinyint"
#: Columns and types of each table; ``{shares}`` are the share columns of the settings.
SCHEMAS = {
    "events": f"{_PLACE}, year smallint, oe float, oe_i int, from_i int, to_i int",
    "maxima": f"{_PLACE}, year smallint, oe float, oe_i int, from_i int, to_i int",
    "parameters": "run_id int, cell_id int, duration_h tinyint, shape float, scale float, per_year float, mam float",
    "levels": "run_id int, cell_id int, duration_h tinyint, return_period int, level float",
    "intervals": "model string, period_name string, cell_id int, duration_h tinyint, return_period int, lo float, hi float",
    "tail_metrics": f"{_PLACE}, pctl_class tinyint, oe_i int, oe float, storm_len_h float, cv float, rg_norm float{{shares}}",
    "tail_events": f"{_PLACE}, oe float, oe_i int, t_pre24 float, tail string",
    "tail_means": f"{_PLACE}, tail string, mean_oe float, mean_t_pre24 float, n_events int",
    "scaling": f"{_PLACE}, quantile float, slope_pct float, slope_lo float, slope_hi float, intercept float, n_events int, converged boolean",
}
BY = ["model", "period_name", "ws"]


def schema(name: str, s: dict = config.DEFAULTS) -> list[tuple[str, str]]:
    shares = "".join(f", {config.column(p, q)} float" for p, qs in (("a", s["a_fractions"]), ("pca", s["pca_alphas"])) for q in qs)
    return [tuple(c.strip().split()) for c in SCHEMAS[name].format(shares=shares).split(",")]


def conformed(df: DataFrame, name: str, s: dict = config.DEFAULTS) -> DataFrame:
    """The columns of the table in order and type; other columns are dropped, a missing one is an error."""
    missing = [c for c, _ in schema(name, s) if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in schema(name, s)])


def write(df: DataFrame, name: str, root: str, s: dict = config.DEFAULTS, runs: DataFrame | None = None) -> str:
    """Writes a table in its schema; with ``runs`` (run_id, model, period_name, ws) into folders by model, period and window size. An empty table has its schema too."""
    path, out = f"{root}/{name}", conformed(df, name, s)
    by = []
    if runs is not None:
        out, by = out.join(runs.select("run_id", *BY), "run_id"), BY
    out.write.mode("overwrite").option("compression", s["output"]["compression"]).partitionBy(*by).parquet(path)
    return path


def read(spark: SparkSession, name: str, root: str, s: dict = config.DEFAULTS) -> DataFrame:
    """A written table. Its schema is the stated one, with the columns of the folders where it has run_id, so that a table without rows can be read too."""
    columns = schema(name, s)
    folders = [("model", "string"), ("period_name", "string"), ("ws", "tinyint")] if columns[0][0] == "run_id" else []
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in columns + folders)).parquet(f"{root}/{name}")
