"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from pixelframe.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(cols).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert cols and got is not None
        return
    want = duck.sql(ORACLE_SQL[name])
    names, kinds = list(want.columns), [str(t) for t in want.types]
    assert sorted(names) == cols
    assert [KINDS[dict(df.dtypes)[c]] for c in cols] == [kinds[names.index(c)] for c in cols]
    rows = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == rows
