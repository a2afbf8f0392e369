"""Connected components of a table of links, by alternating stars.

Each step replaces links by links to smaller neighbours: for every node, its larger neighbours
(large star) or its smaller ones (small star) are linked with its least neighbour. The steps
repeat until the links no longer change; every node is then linked with the least node of its
component. Each step's links are written to the shared folder. Neighbourhoods are reduced with
partial aggregates and never gathered, and a hub's join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """links: a > b. One large or small star step, again as distinct links a > b."""
    out = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        out = out.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = out.join(least, "u")
    if both_ways:
        new = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (columns a and b, any order, repeats and loops allowed)."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "links")
    state = _state(now)
    while state[0]:
        before, now = now, written(_star(_star(now, True), False), "links")
        discard(before)
        new = _state(now)
        if new == state:
            break
        state = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
