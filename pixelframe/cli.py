"""Run one registered query from the shell: python -m pixelframe.cli QUERY DATA OUT [--where SQL] [--radec RA0 RA1 DEC0 DEC1]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.registry import QUERIES


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query", choices=sorted(QUERIES))
    p.add_argument("data", help="folder with the tables as Parquet")
    p.add_argument("out", help="folder for the result")
    p.add_argument("--where", help="SQL cut on the result")
    p.add_argument("--radec", nargs=4, type=float, help="box on columns ra and dec of the result; ra may wrap")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    df = QUERIES[a.query](spark, a.data)
    if a.radec:
        r0, r1, d0, d1 = a.radec
        df = df.where(f"dec BETWEEN {d0} AND {d1}").where(f"ra BETWEEN {r0} AND {r1}" if r0 <= r1 else f"ra >= {r0} OR ra <= {r1}")
    if a.where:
        df = df.where(a.where)
    df.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
