"""Holds a query against its SQL: over the smallest tables, or the next size where the smallest give no rows."""

import glob
import os

import duckdb
import pandas as pd

DATA, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def views(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "__float__") else str(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def assert_same(spark, name, query, sql):
    """Rows that are not there prove nothing, so both sides must have some."""
    for data in (DATA, NEXT):
        want = views(data).sql(sql).df()
        if len(want):
            break
    got = query(spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns), name
    assert canonical(got) == canonical(want) and len(got), name
