"""Images, sources and catalogues derived from the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name -> SELECT over the driver's tables. Every part is a source and every line of lineitem lies in a pixel: each 200 part keys make a
#: field of 40 x 40 pixels, and fields stand 80 pixels apart along x, so that no box reaches a second one and crowding stays as it is in one field.
SQL = {
    "pixels": """SELECT CAST(l_linenumber AS INT) AS img, CAST(l_partkey % 40 + 80 * FLOOR(l_partkey / 200) AS INT) AS x, CAST(l_suppkey % 40 AS INT) AS y,
        SUM(l_quantity) AS d, CAST(COUNT(*) AS DOUBLE) AS iv FROM lineitem GROUP BY 1, 2, 3""",
    "srcs": """SELECT p_partkey AS sid, CAST((p_partkey * 7919) % 400 AS DOUBLE) / 10e0 + 80e0 * FLOOR(p_partkey / 200) AS px, CAST((p_partkey * 104729) % 400 AS DOUBLE) / 10e0 AS py,
        CAST(1 + (p_size % 3) AS DOUBLE) AS sig, p_retailprice AS flux, p_type AS ptype, p_size AS psize FROM part""",
    "cat1": """SELECT c_custkey AS id, CAST((c_custkey * 7919) % 3600 AS DOUBLE) / 10e0 AS ra, CAST((c_custkey * 104729) % 1200 AS DOUBLE) / 10e0 - 60e0 AS dec,
        c_acctbal AS val, c_mktsegment AS seg, c_nationkey AS nat FROM customer""",
    "cat2": """SELECT p_partkey AS id, CAST((p_partkey * 7927) % 3600 AS DOUBLE) / 10e0 AS ra, CAST((p_partkey * 104723) % 1200 AS DOUBLE) / 10e0 - 60e0 AS dec,
        p_retailprice AS val, p_size AS size, p_brand AS brand FROM part""",
    "expo": """SELECT o_orderkey AS exp_id, o_custkey AS src, o_orderpriority AS band, o_totalprice AS flux, o_orderdate AS ts FROM orders""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; only the columns it needs are read."""
    base = {"pixels": "lineitem", "srcs": "part", "cat1": "customer", "cat2": "part", "expo": "orders"}[name]
    return spark.sql(SQL[name].replace(f"FROM {base}", "FROM {base}"), base=read(spark, sf_dir, base))


def with_fixtures(*names: str) -> str:
    """WITH clause that defines the named tables, for SQL text."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
