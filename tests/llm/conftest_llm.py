"""Small inputs and comparisons for this folder's tests."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df.select(cols).collect()), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.sql(sql)
    cols = list(r.columns)
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted((tuple(_norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
