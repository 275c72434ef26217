"""Runs queries against their SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(d):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(d + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        v = [x.tolist() if hasattr(x, "tolist") else x for x in r]
        v = [None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else float(x) if isinstance(x, int) and not isinstance(x, bool) else round(x, 6) if isinstance(x, float) else x for x in v]
        out.append(tuple(map(str, v)))
    return sorted(out)


def differs(spark, d, query, sql):
    got, want = query(spark, d).toPandas(), connect(d).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} / {len(b)} rows, {list(set(a) ^ set(b))[:4]}"
