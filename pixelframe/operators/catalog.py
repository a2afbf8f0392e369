"""Catalogue operators built on matches: enrichment, ownership, runs, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .images import components


def left_zero(left: DataFrame, matched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left rows with the matched columns; unmatched rows get zeros, not nulls, and matched = false."""
    m = matched.select(key, *columns, F.lit(True).alias("matched"))
    out = left.join(m, key, "left")
    return out.select(*left.columns, *[F.coalesce(c, F.lit(0).cast(matched.schema[c].dataType)).alias(c) for c in columns], F.coalesce("matched", F.lit(False)).alias("matched"))


def exactly_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left key must meet exactly one right row; anything else raises when it runs."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    met = left.join(counts, key, "left").join(right, key, "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    return met.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not exactly one row for "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def owned_by_tile(candidates: DataFrame, dx: Column, dy: Column, inside: Column) -> DataFrame:
    """Sources on tiles: the tile with the least L-infinity distance to its centre owns the source, the lower tile on ties; others hold a copy for the margin."""
    d = F.greatest(F.abs(dx), F.abs(dy))
    w = Window.partitionBy("sid").orderBy(F.when(inside, 0).otherwise(1), d, "tile")
    ranked = candidates.withColumn("_k", F.row_number().over(w)).withColumn("dist", d)
    return ranked.withColumn("role", F.when((F.col("_k") == 1) & inside, "keep").otherwise("margin")).drop("_k")


def convex_overlap(ax: list[Column], ay: list[Column], bx: list[Column], by: list[Column]) -> Column:
    """Separating-axis test of two convex polygons given by their corners."""
    hit = F.lit(True)
    for px, py in ((ax, ay), (bx, by)):
        n = len(px)
        for k in range(n):
            nx, ny = py[(k + 1) % n] - py[k], px[k] - px[(k + 1) % n]
            a = [nx * x + ny * y for x, y in zip(ax, ay, strict=True)]
            b = [nx * x + ny * y for x, y in zip(bx, by, strict=True)]
            hit = hit & (F.greatest(*a) >= F.least(*b)) & (F.greatest(*b) >= F.least(*a))
    return hit


def groups_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components of pairs (a, b) over all nodes (id): id, grp, the least id of the component. Pairs with an end that is no node are left out."""
    ends = [nodes.select(F.col("id").alias(c)).distinct() for c in "ab"]
    links = pairs.select("a", "b").where("a <> b").distinct().join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi")
    return nodes.select("id").join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("least", "id").alias("grp"))
