"""Scans. NaN counts as missing: every floating column that an operator uses goes through ``present`` or ``valid``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid(c: Column | str) -> Column:
    """True for a number, false for NULL and NaN. The cast keeps isnan away from columns of other types."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def present(c: Column | str) -> Column:
    """The value, or NULL where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(valid(c), c)
