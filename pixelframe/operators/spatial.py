"""Cross-matches on the sky and in the plane.

Every match is an equi-join on grid cells plus an exact distance test: one side is kept at its
cell, the other is repeated into the neighbouring cells, so each pair meets once. The join is a merge: the planner doesn't know how
far the repeated side grows and would broadcast it. On the sky the grid is three-dimensional on unit vectors, which has no poles
and no wrap. Cells are as large as the matching distance, so the work grows with the local
density and not with the catalogue; crowded cells are ordinary skewed join keys, which
adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import unit_vector


def _neighbours(cols: list[str]) -> Column:
    """All cells around a cell, itself included."""
    rows = [()]
    for _ in cols:
        rows = [r + (k,) for r in rows for k in (-1, 0, 1)]
    return F.array(*[F.struct(*[(F.col(c) + k).alias(c) for c, k in zip(cols, r, strict=True)]) for r in rows])


def sky_pairs(left: DataFrame, right: DataFrame, radius: float, lid: str = "id", rid: str = "id", max_radius: Column | None = None) -> DataFrame:
    """All pairs within `radius` degrees: lid, rid, dist (degrees).

    max_radius: a Column over the right side with a radius of its own for each row, none larger than `radius`.
    """
    chord = 2 * math.sin(math.radians(radius) / 2)

    def cells(df: DataFrame, key: str, p: str, extra: Column | None) -> DataFrame:
        x, y, z = unit_vector(F.col("ra"), F.col("dec"))
        v = df.select(F.col(key).alias(f"{p}id"), x.alias(f"{p}x"), y.alias(f"{p}y"), z.alias(f"{p}z"), *([extra.alias("rmax")] if extra is not None else []))
        return v.select("*", *[F.floor(F.col(f"{p}{c}") / chord).alias(f"c{c}") for c in "xyz"])

    a = cells(left, lid, "l", None)
    b = cells(right, rid, "r", max_radius).withColumn("cell", F.explode(_neighbours(["cx", "cy", "cz"])))
    b = b.drop("cx", "cy", "cz").select("*", "cell.*").drop("cell")
    d2 = sum(((F.col(f"l{c}") - F.col(f"r{c}")) * (F.col(f"l{c}") - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    limit = F.lit(chord) if max_radius is None else 2.0 * F.sin(F.radians(F.least(F.col("rmax"), F.lit(radius))) / 2.0)
    return a.join(b.hint("merge"), ["cx", "cy", "cz"]).where(d2 <= limit * limit).select("lid", "rid", F.degrees(2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(d2) / 2.0))).alias("dist"))


def plane_pairs(left: DataFrame, right: DataFrame, radius: float, lid: str = "id", rid: str = "id") -> DataFrame:
    """All pairs within `radius` in x, y: lid, rid, dist."""
    a = left.select(F.col(lid).alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    b = right.select(F.col(rid).alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    b = b.withColumn("cell", F.explode(_neighbours(["cx", "cy"]))).drop("cx", "cy").select("*", "cell.*").drop("cell")
    d2 = (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry"))
    return a.join(b.hint("merge"), ["cx", "cy"]).where(d2 <= radius * radius).select("lid", "rid", F.sqrt(d2).alias("dist"))


def nearest(pairs: DataFrame) -> DataFrame:
    """The nearest right row of each left row; ties take the smaller id."""
    w = Window.partitionBy("lid").orderBy("dist", "rid")
    return pairs.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def without_close_pairs(cat: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Rows with no row of a smaller key within the radius."""
    close = sky_pairs(cat, cat, radius, key, key).where("rid < lid").select(F.col("lid").alias(key)).distinct()
    return cat.join(close, key, "left_anti")


def greedy_merge(cats: list[DataFrame], radius: float) -> DataFrame:
    """Catalogues in order of preference (columns src, id, ra, dec): a row joins if nothing kept so far lies within the radius. One anti join a catalogue; rows at one position join or stay out alike, so positions meet, each once."""
    kept = cats[0]
    for more in cats[1:]:
        at, held = (x.select("ra", "dec").distinct().withColumn("id", F.struct("ra", "dec")) for x in (more, kept))
        near = sky_pairs(at, held, radius).select("lid.ra", "lid.dec").distinct()
        kept = kept.unionByName(more.join(near.hint("merge"), ["ra", "dec"], "left_anti").select(*more.columns))
    return kept


def box_overlaps(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of half-open boxes (id, x0, x1, y0, y1) that overlap. Boxes are dealt into cells of `size`; a pair counts in the cell that holds the corner of its intersection, so it comes once."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        gx = F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x1") - 1) / size)))
        gy = F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor((F.col("y1") - 1) / size)))
        out = df.where("x1 > x0 AND y1 > y0").select("*", gx.alias("gx")).select("*", gy.alias("gy"))
        return out.select("gx", "gy", *[F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "x1", "y0", "y1")])

    met = dealt(a, "a").join(dealt(b, "b").hint("merge"), ["gx", "gy"])
    x, y = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    hit = (x < F.least("ax1", "bx1")) & (y < F.least("ay1", "by1"))
    return met.where(hit & (F.floor(x / size) == F.col("gx")) & (F.floor(y / size) == F.col("gy"))).select("aid", "bid")
