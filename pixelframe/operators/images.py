"""Operators on pixel tables (img, x, y, value). Neighbourhoods are equi-joins on shifted coordinates, never range joins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written


def coadd(pixels: DataFrame, tiny: float = 1e-16) -> DataFrame:
    """Inverse-variance weighted mean, its weight, and the weighted standard deviation, for each x, y."""
    w, d = F.col("iv"), F.col("d")
    sums = pixels.groupBy("x", "y").agg(F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd"))
    mean = F.col("wd") / F.greatest(F.col("w"), F.lit(tiny))
    var = F.when(F.col("w") > 0, F.col("wdd") / F.when(F.col("w") > 0, F.col("w"))).otherwise(0.0) - mean * mean
    return sums.select("x", "y", mean.alias("mean"), "w", F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def rejected(pixels: DataFrame, first: DataFrame, limit: float = 5.0, least: float = 1e-6) -> DataFrame:
    """Pixels further than `limit` standard deviations from the coadd, with their four neighbours: img, x, y."""
    off = F.abs(F.col("d") - F.col("mean")) / F.greatest(F.col("std"), F.lit(least))
    bad = pixels.join(first.select("x", "y", "mean", "std"), ["x", "y"]).where((F.col("iv") > 0) & (off >= limit)).select("img", "x", "y")
    return dilate(bad)


def dilate(marked: DataFrame, offsets: tuple[tuple[int, int], ...] = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) -> DataFrame:
    """Marked pixels (img, x, y) and their neighbours at the given offsets."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets]))
    return marked.select("img", "x", "y", o.alias("o")).select("img", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()


def coadd_reject(pixels: DataFrame, limit: float = 5.0) -> DataFrame:
    """Coadd, drop outliers and their neighbours, coadd again."""
    bad = rejected(pixels, coadd(pixels), limit)
    return coadd(pixels.join(bad, ["img", "x", "y"], "left_anti"))


SIDE = 64


def _before(sums: DataFrame, keys: list[str], along: str, last: str) -> DataFrame:
    """keys, along, v: the sum of what lies in lower pieces, for each piece up to number `last` (a column) that has any."""
    w = Window.partitionBy(*keys).orderBy(along)
    run = sums.select(*keys, last, F.col(along).alias("_at"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.coalesce(F.lead(along).over(w), F.col(last)).alias("_to"))
    return run.where(F.col("_to") > F.col("_at")).select(*keys, F.explode(F.sequence(F.col("_at") + 1, F.col("_to"))).alias(along), "v")


def _integral_blocks(pixels: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Pixels dealt into blocks of SIDE x SIDE, and each image's bounding grid.

    A block (img, bx, by, cells) has its pixels at 1 to SIDE along both axes, and at 0 what lies
    before it: in a row sums over the blocks to its left, in a column sums over those below, at
    (0, 0) the sum of all that are both. Its own two running sums then give the integral. Running
    sums over an image go over its blocks, not its pixels.
    """
    at = lambda c: F.floor(F.col(c) / SIDE).alias(f"b{c}")
    px = cut(pixels.select("img", "x", "y", at("x"), at("y"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))  # read four times
    last = [F.floor(F.col(f"{c}1") / SIDE).alias(f"last_{c}") for c in "xy"]
    box = px.groupBy("img").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).select("*", *last)
    ends = F.broadcast(box.select("img", "last_x", "last_y"))  # a row an image
    rows = px.groupBy("img", "y", "bx").agg(F.sum("v").alias("v")).join(ends, "img")
    cols = px.groupBy("img", "x", "by").agg(F.sum("v").alias("v")).join(ends, "img")
    left = _before(rows, ["img", "y"], "bx", "last_x").select("*", at("y"))
    below = _before(cols, ["img", "x"], "by", "last_y").select("*", at("x"))
    corner = _before(left.groupBy("img", "bx", "by").agg(F.sum("v").alias("v")).join(ends, "img"), ["img", "bx"], "by", "last_y")
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), "v").alias("cell")
    ix, iy, zero = (F.col(c) - SIDE * F.floor(F.col(c) / SIDE) + 1 if c in ("x", "y") else F.lit(0) for c in ("x", "y", ""))
    cells = px.select("img", "bx", "by", cell(ix, iy)).union(left.select("img", "bx", "by", cell(zero, iy))).union(below.select("img", "bx", "by", cell(ix, zero))).union(corner.select("img", "bx", "by", cell(zero, zero)))
    spark = pixels.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # rows grow many times over after the shuffle, so its bytes must not decide
    return cells.repartition(n, "img", "bx", "by").groupBy("img", "bx", "by").agg(F.collect_list("cell").alias("cells")), box


def _summed(cells: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """Number and integral (by x, then y) of each block; a block without a list is zero."""
    at, all_ = cells.offsets.to_numpy(), cells.values
    x, y, v = (all_.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "v"))
    for k, some in enumerate(cells.is_valid().to_pylist()):
        out = np.zeros((SIDE + 1, SIDE + 1))
        if some:
            i = slice(at[k], at[k + 1])
            out[x[i], y[i]] = v[i]
        yield k, out.cumsum(axis=0).cumsum(axis=1)[1:, 1:]


def integral(pixels: DataFrame, value: str = "d") -> DataFrame:
    """Sums over all pixels up to and including x, y, at every pixel of each image's bounding grid.

    Two running sums, along x and along y, in blocks that know what lies before them; missing
    pixels count zero. Pixels are unique by img, x, y.
    """
    blocks, box = _integral_blocks(pixels, value)
    pieces = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / SIDE), F.col(f"last_{c}"))).alias(f"b{c}")
    every = box.select("*", pieces("x")).select("*", pieces("y"))
    out = T.StructType([*(pixels.schema[c] for c in ("img", "x", "y")), T.StructField("s", T.DoubleType())])
    kinds = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = {c: np.maximum(b.column(f"{c}0").to_numpy(), SIDE * b.column(f"b{c}").to_numpy()) for c in "xy"}
            hi = {c: np.minimum(b.column(f"{c}1").to_numpy() + 1, SIDE * (b.column(f"b{c}").to_numpy() + 1)) for c in "xy"}
            for k, s in _summed(b.column("cells")):
                x, y = (np.arange(lo[c][k], hi[c][k]) for c in "xy")
                part = s[np.ix_(x % SIDE, y % SIDE)].ravel()
                made = [pa.repeat(b.column("img")[k], len(part)), *(pa.array(c) for c in (np.repeat(x, len(y)), np.tile(y, len(x)), part))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, kinds, strict=True)], schema=kinds)

    # bounds of the grid by img, cells of the blocks that have any
    met = every.hint("merge").join(blocks, ["img", "bx", "by"], "left").select("img", "bx", "by", "x0", "x1", "y0", "y1", "cells")
    return met.mapInArrow(task, out)


def rect_sums_in(pixels: DataFrame, rects: DataFrame, value: str = "d") -> DataFrame:
    """The rows of rect_sums(integral(pixels), rects): corners meet the block that they lie in, so the table of integrals is never written out."""
    blocks, box = _integral_blocks(pixels, value)
    at = _corners(rects, F.broadcast(box.select("img", F.col("x1").alias("fx"), F.col("y1").alias("fy"), "x0", "y0")))  # a row an image
    cell = lambda c: F.floor(F.col(c) / SIDE)
    at = at.where("x >= x0 AND y >= y0").select("img", cell("x").alias("bx"), cell("y").alias("by"), F.struct("rid", (F.col("x") - SIDE * cell("x")).alias("x"), (F.col("y") - SIDE * cell("y")).alias("y"), "sign").alias("at"))
    asked = at.groupBy("img", "bx", "by").agg(F.collect_list("at").alias("at"))
    out = T.StructType([rects.schema["rid"], T.StructField("s", T.DoubleType())])
    kinds = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ask = b.column("at").offsets.to_numpy(), b.column("at").values
            x, y, sign = (ask.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "sign"))
            for k, s in _summed(b.column("cells")):
                i = slice(at[k], at[k + 1])
                rid = ask.field("rid").slice(at[k], at[k + 1] - at[k])
                yield pa.RecordBatch.from_arrays([rid.cast(kinds[0].type), pa.array(s[x[i], y[i]] * sign[i])], schema=kinds)

    got = blocks.hint("merge").join(asked.hint("merge"), ["img", "bx", "by"]).select("at", "cells").mapInArrow(task, out)
    return got.unionByName(rects.select("rid", F.lit(0.0).alias("s"))).groupBy("rid").agg(F.sum("s").alias("total"))


def _corners(rects: DataFrame, far: DataFrame) -> DataFrame:
    """Signed corners of half-open rectangles, beyond an image's far edges (fx, fy) moved to the edge."""
    corner = F.explode(
        F.array(*[F.struct((F.col(a) - 1).alias("x"), (F.col(b) - 1).alias("y"), F.lit(s).alias("sign")) for a, b, s in (("x1", "y1", 1.0), ("x0", "y1", -1.0), ("x1", "y0", -1.0), ("x0", "y0", 1.0))])
    )
    at = rects.select("rid", "img", corner.alias("c")).select("rid", "img", "c.x", "c.y", "c.sign").join(far, "img", "left")
    return at.select(*[F.least(c, f"f{c}").alias(c) if c in ("x", "y") else c for c in at.columns if c not in ("fx", "fy")])


def rect_sums(table: DataFrame, rects: DataFrame) -> DataFrame:
    """Sum inside half-open rectangles (rid, img, x0, x1, y0, y1) by four corner lookups in an integral table; corners beyond its far edges are taken at the edge, before its near ones they count zero."""
    at = _corners(rects, table.groupBy("img").agg(F.max("x").alias("fx"), F.max("y").alias("fy")))
    got = at.join(table, ["img", "x", "y"], "left")
    return got.groupBy("rid").agg(F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0))).alias("total"))


def fold_quadrant(pixels: DataFrame, cx: int, cy: int, *keys: str) -> DataFrame:
    """Sum of the pixels that a quadrant symmetric about (cx, cy) maps onto each (|x - cx|, |y - cy|), for each image or set of keys."""
    return pixels.groupBy(*(keys or ["img"]), F.abs(F.col("x") - cx).alias("x"), F.abs(F.col("y") - cy).alias("y")).agg(F.sum("d").alias("d"))


def convolve_separable(pixels: DataFrame, kx: list[tuple[int, float]], ky: list[tuple[int, float]], value: str = "d") -> DataFrame:
    """Correlation with weights (offset, weight) along x, then y; what lies outside counts zero. Each pixel is spread to its targets and summed.

    Both axes are summed inside blocks of 64 x 64 source pixels, which one shuffle brings
    together; only sums leave a block and meet those of its neighbours.
    """

    def one(df: DataFrame, axis: str, kernel: list[tuple[int, float]]) -> DataFrame:
        k = F.explode(F.array(*[F.struct(F.lit(-o).alias("o"), F.lit(w).alias("w")) for o, w in kernel]))
        other = "y" if axis == "x" else "x"
        return df.select("img", "bx", "by", other, F.col(axis), "v", k.alias("k")).groupBy("img", "bx", "by", other, (F.col(axis) + F.col("k.o")).alias(axis)).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))

    spark = pixels.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # rows grow many times over after the shuffle, so its bytes must not decide
    at = pixels.select("img", "x", "y", F.col(value).alias("v"), F.floor(F.col("x") / 64).alias("bx"), F.floor(F.col("y") / 64).alias("by")).repartition(n, "img", "bx", "by")
    return one(one(at, "x", kx), "y", ky).groupBy("img", "x", "y").agg(F.sum("v").alias("v"))


def gaussian_kernel(sigma: float, reach: float = 4.0) -> list[tuple[int, float]]:
    r = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-r, r + 1), w, strict=True)]


def lanczos_kernel(shift: float) -> list[tuple[int, float]]:
    """Seven weights for a shift of less than a pixel, normalised to one."""
    f = lambda x: 1.0 if abs(x) < 1e-12 else 0.0 if abs(x) >= 3 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2
    w = [f(k + shift) for k in range(-3, 4)]
    return [(k, v / sum(w)) for k, v in zip(range(-3, 4), w, strict=True)]


EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. For every node its larger neighbours (large star), or its smaller ones and itself (small star), linked with its least neighbour."""
    out = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        out = out.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = out.join(out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
    if large:
        new = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, least: the least node of its connected component, for every node of links (columns a and b of any type with an order).

    Alternating large and small stars until the links no longer change. There is no bound on the
    rounds; their number grows with the logarithm of a component's nodes, whatever the order of
    its ids. Lineage is cut at every round in the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while before[0]:
        now = cut(_star(_star(now, True), False))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("least")).union(now.select("b", "b").distinct())


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], size: int = 64) -> DataFrame:
    """Rows of left and right with equal keys whose intervals (both ends inside) share a number, once each. Intervals are dealt into pieces of `size`, so that a row of many disjoint ones costs no more than its length."""
    dealt = lambda df, ends: df.select("*", F.explode(F.sequence(F.floor(F.col(ends[0]) / size), F.floor(F.col(ends[1]) / size))).alias("_cell"))
    met = dealt(left, a).join(dealt(right, b).hint("merge"), [*keys, "_cell"])
    first = F.greatest(a[0], b[0])
    return met.where((first <= F.least(a[1], b[1])) & (F.floor(first / size) == F.col("_cell"))).drop("_cell")


def blobs(marked: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Eight-connected components of marked pixels (img, x, y): label is the least y * width + x of the component.

    Pixels join into runs first (gaps and islands in pieces of 4,096 pixels of a row, so that a
    long row is no single task), then runs of neighbouring rows, and those that meet at the end
    of a piece, into components.
    """
    run = F.col("x") - F.row_number().over(Window.partitionBy("img", "y", "piece").orderBy("x"))
    px = marked.select("img", "x", "y").distinct().withColumn("piece", F.floor(F.col("x") / 4096)).withColumn("run", run)
    runs = px.groupBy("img", "y", "piece", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn("rid", F.col("y").cast("long") * width + F.col("x0"))
    runs = cut(runs.select("img", "y", "piece", "run", "x0", "x1", "rid"))
    up = runs.select("img", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("rid").alias("uid"))
    wide = runs.select("img", "y", "rid", (F.col("x0") - 1).alias("x0"), (F.col("x1") + 1).alias("x1"))
    links = interval_pairs(wide, up, ["img", "y"], ("x0", "x1"), ("u0", "u1")).select(F.struct("img", "rid").alias("a"), F.struct("img", F.col("uid").alias("rid")).alias("b"))
    on = runs.select("img", "y", (F.col("x1") + 1).alias("x0"), F.col("rid").alias("uid"))
    links = links.unionByName(runs.join(on, ["img", "y", "x0"]).select(F.struct("img", "rid").alias("a"), F.struct("img", F.col("uid").alias("rid")).alias("b")))
    label = components(links).select("node.img", "node.rid", F.col("least.rid").alias("label"))
    named = runs.join(label, ["img", "rid"], "left").select("img", "y", "piece", "run", F.coalesce("label", "rid").alias("label"))
    return px.join(named, ["img", "y", "piece", "run"]).select("img", "x", "y", "label")


def blob_boxes(hot: DataFrame) -> DataFrame:
    """img, label, bounding box (both ends inside), size and peak of each component of pixels (img, x, y, d). Labels repeat from image to image."""
    z = blobs(hot).join(hot.select("img", "x", "y", "d"), ["img", "x", "y"])
    return z.groupBy("img", "label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"), F.max("d").alias("peak"))


def blob_maxima(hot: DataFrame) -> DataFrame:
    """img, label, x, y, d of the brightest pixel of each component, the first by y, then x, on ties."""
    z = blobs(hot).join(hot.select("img", "x", "y", "d"), ["img", "x", "y"])
    best = z.groupBy("img", "label").agg(F.max_by(F.struct("x", "y", "d"), F.struct("d", -F.col("y"), -F.col("x"))).alias("b"))
    return best.select("img", "label", "b.x", "b.y", "b.d")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once as Parquet into the shared folder and read back (checkpoint() would compute it twice). session.clear() deletes such folders."""
    return written(df)


FILL = 128


def _windows(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 17) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys, in tables of whole windows of about `least` rows, with the number of each row's window."""

    def tied() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(kept).combine_chunks()
        new = np.zeros(len(t), bool)
        for key in keys:
            code = t.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return t, new.cumsum()

    kept, n = [], 0
    for b in batches:
        kept, n = [*kept, b], n + len(b)
        if n >= least:
            t, w = tied()
            end = int(np.searchsorted(w, w[-1]))  # the last window may go on
            if end:
                yield t.slice(0, end), w[:end]
            kept, n = t.slice(end).to_batches(), len(t) - end
    if n:
        yield tied()


def _fill(w: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, at: np.ndarray, free: np.ndarray, own: np.ndarray, size: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Open cells (free) of windows of size x size (w, x, y) filled from those that have a value v from round `at` on (-1: never). Open cells have none in round `sure`.

    Cells outside a window aren't seen: one round after `sure` open cells at its edge are in
    doubt, in each later one the open cells beside them. What is filled before doubt comes to it
    is final and stops it; so is what stays open without doubt. Returns values, rounds, whether
    a cell is in doubt, and whether one beside it may be so for its own block: it is in doubt
    here, not seen, or was open and is not one of this block's own.
    """
    key = (w * (size + 2) + x + 1) * (size + 2) + y + 1
    order, n, never = np.argsort(key), len(key), np.iinfo(np.int64).max
    key, beside = key[order], np.empty((4, n), np.int64)
    for k, step in enumerate((size + 2, -size - 2, 1, -1)):
        i = np.minimum(np.searchsorted(key, key + step), n - 1)
        beside[k, order] = np.where(key[i] == key + step, order[i], n)  # n: no such cell
    edge = (x == 0) | (x == size - 1) | (y == 0) | (y == size - 1)
    live = (at >= 0) & np.isfinite(v)
    late = np.flatnonzero(live & (at > sure))
    front, dim, k, last = np.flatnonzero(live & (at == sure)), np.flatnonzero(edge & free), sure, at[late].max(initial=sure)
    v, at = np.append(np.where(live, v, np.nan), np.nan), np.append(np.where(at >= 0, at, never), never)
    free, doubt, others = np.append(free, False), np.zeros(n + 1, bool), np.append(free & ~own, False)
    while front.size or dim.size or k < last:
        k += 1
        doubt[dim], free[dim] = True, False
        to = np.unique(beside[:, front])
        to = to[free[to]]
        near = beside[:, to]
        ok = np.isfinite(v[near]) & (at[near] < k)
        with np.errstate(over="ignore"):
            v[to] = np.where(ok, v[near], 0.0).sum(axis=0) / ok.sum(axis=0)
        at[to], free[to] = k, False
        front = np.concatenate([to[np.isfinite(v[to])], late[at[late] == k]])
        dim = np.unique(beside[:, dim])
        dim = dim[free[dim]]
    return v[:n], np.where(at[:n] == never, -1, at[:n]), doubt[:n], edge | (doubt | others)[beside].any(axis=0)


def _fill_blocks(cells: DataFrame, sure: int, halo: int, side: int) -> DataFrame:
    """What blocks of side x side can tell of their cells (img, x, y, v, round, open): open ones are filled, closed for good (no longer open, without a round), or still open.

    Cells within `halo` of a block are seen there, so that whatever is filled up to round
    sure + halo is filled here. near marks what the next call needs: open cells, and those beside
    them that have a value from that round on or a later one.
    """
    spark, size = cells.sparkSession, side + 2 * halo
    piece = lambda c, by: F.floor((F.col(c) + by) / side)
    at = cells
    for c in "xy":
        at = at.select("*", (F.explode(F.sequence(piece(c, -halo), piece(c, halo))) if halo else piece(c, 0)).alias(f"b{c}"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # the work is Python's, so bytes must not decide
    out = T.StructType([*cells.schema, T.StructField("near", T.BooleanType())])
    kinds = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, w in _windows(batches, ["bx", "by", "img"]):
            x, y, v, free = (t.column(c).to_numpy() for c in ("lx", "ly", "v", "open"))
            own = (x >= halo) & (x < side + halo) & (y >= halo) & (y < side + halo)
            v, at, doubt, beside = _fill(w, x, y, v, t.column("round").fill_null(-1).to_numpy().astype(np.int64), free, own, size, sure)
            made = {
                "v": pc.if_else(pa.array(free & (at >= 0)), pa.array(v), t.column("v")),
                "round": pa.array(at, mask=at < 0),
                "open": pa.array(doubt),
                "near": pa.array(doubt | (beside & np.isfinite(v) & (at >= sure + halo))),
            }
            told = pa.table([made[c] if c in made else t.column(c) for c in kinds.names], names=kinds.names)
            yield from told.filter(pa.array(own)).cast(kinds).combine_chunks().to_batches()

    at = at.repartition(n, "bx", "by", "img").sortWithinPartitions("bx", "by", "img")
    return at.select("*", *[F.coalesce(F.col(c) - side * F.col(f"b{c}") + halo, F.lit(0)).cast("int").alias(f"l{c}") for c in "xy"]).mapInArrow(task, out)


def filled(pixels: DataFrame, good: Column, wanted: Column | None = None, value: str = "d") -> DataFrame:
    """img, x, y, the value, and round: pixels that are not good filled from their edges inwards by the mean of their four neighbours.

    A pixel is filled in the first round in which a neighbour has a finite value, so all its known
    neighbours date from the round before. good marks those known at the start (round 0); with
    wanted, other pixels keep their value and a null round. So do pixels that no good one reaches
    and those without a place (a null in img, x or y), and there is no bound on the rounds.
    Pixels are unique by img, x, y; a null in good or wanted counts as false.

    Blocks of FILL x FILL pixels take all their rounds in one task. What depends on other blocks
    is left to calls that see half a block further, and these get only such pixels and the fronts
    beside them: one table in the shared folder a call, and FILL / 2 rounds or more in each.
    """
    no, placed = F.lit(False), F.col("img").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    px = pixels.select("img", "x", "y", F.col(value).cast("double").alias("v"), (F.coalesce(good, no) & placed).alias("_ok"), ((F.lit(True) if wanted is None else F.coalesce(wanted, no)) & placed).alias("_go"))
    now = px.select("img", "x", "y", "v", F.when(F.col("_ok"), F.lit(0)).alias("round"), (~F.col("_ok") & F.col("_go")).alias("open"), F.lit(True).alias("asked"))
    done, sure, halo = [], 0, 0
    row = ["img", "x", "y", "v", "round"]
    while True:
        state = cut(_fill_blocks(now, sure, halo, FILL))
        sure += halo
        now = state.where("near").select(*row, "open", F.col("open").alias("asked"))
        if now.where("open").isEmpty() or now.where("NOT open").isEmpty():  # nobody asks, or nobody has an answer
            break
        done.append(state.where("asked AND NOT open").select(*row))
        if len(done) == 32:  # plans stay small however deep the mask
            done = [cut(reduce(DataFrame.unionByName, done))]
        halo = FILL // 2
    return reduce(DataFrame.unionByName, [*done, state.where("asked").select(*row)]).withColumnRenamed("v", value)


def box_medians(pixels: DataFrame, step: int, half: int, w: int | None, h: int | None) -> DataFrame:
    """Medians over overlapping boxes of half-size `half` around a grid of centres every `step` pixels: img, gx, gy, median, n. A size of None has no far edge."""

    def centres(c: str, size: int | None) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((F.col(c) - half) / step))
        hi = F.floor((F.col(c) + half) / step)
        if size is not None:
            hi = F.least(F.lit((size - 1) // step), hi)
        return F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))

    rows = pixels.select("img", "d", "y", centres("x", w).alias("gx")).select("img", "d", "gx", centres("y", h).alias("gy"))
    return rows.groupBy("img", "gx", "gy").agg(F.median("d").alias("median"), F.count(F.lit(1)).alias("n"))
