"""Comparison of a DataFrame with DuckDB's rows, whatever their order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 9)
    return x


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[columns].astype(object).itertuples(index=False))


def assert_same(df, con, sql):
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
