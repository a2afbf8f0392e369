"""Rendering: sources meet the pixels of their boxes in an equi-join.

A source is dealt into blocks of pixels that its box touches, and pixels carry their block, so
source x image x pixel is a join on (img, block) with a box test on top: no range join, and a
bright source over many blocks is spread over as many keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import mixtures as mog

BLOCK = 8


def boxed(sources: DataFrame, half: Column, x: str = "px", y: str = "py") -> DataFrame:
    """sources with the half-open box of half-width `half` around the rounded position, dealt into blocks."""
    cx, cy = F.bround(F.col(x), 0).cast("int"), F.bround(F.col(y), 0).cast("int")
    h = half.cast("int")
    box = sources.select("*", (cx - h).alias("bx0"), (cx + h + 1).alias("bx1"), (cy - h).alias("by0"), (cy + h + 1).alias("by1"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor((F.col(b) - 1) / BLOCK)))
    return box.select("*", blocks("bx0", "bx1").alias("gx")).select("*", blocks("by0", "by1").alias("gy"))


def render_join(pixels: DataFrame, sources: DataFrame) -> DataFrame:
    """Every pixel inside the box of every source; sources come from boxed(). With a column img on the sources, images must agree."""
    p = pixels.select("*", F.floor(F.col("x") / BLOCK).alias("gx"), F.floor(F.col("y") / BLOCK).alias("gy"))
    keys = ["gx", "gy"] + (["img"] if "img" in sources.columns else [])
    inside = (F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1"))
    # a merge: a table of sources grows many times over as it is dealt into blocks, which the planner's estimate doesn't know, so it would be broadcast at any size
    return p.join(sources.hint("merge"), keys).where(inside).drop("gx", "gy", "bx0", "bx1", "by0", "by1")


def blocks_join(pixels: DataFrame, sources: DataFrame, *made: Column) -> DataFrame:
    """The rows of render_join with columns `made` from the sources' own, which are worked out once for each source and block after the shuffle: what is wide, as mixtures are, isn't dealt with the sources.

    Blocks are dealt over all cores: few bytes, but many exponentials, so sizes in bytes must not decide.
    """
    spark = pixels.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["gx", "gy"] + (["img"] if "img" in sources.columns else [])
    at = pixels.select("img", F.floor(F.col("x") / BLOCK).alias("gx"), F.floor(F.col("y") / BLOCK).alias("gy"), F.struct(*[c for c in pixels.columns if c != "img"]).alias("_px"))
    packed = at.repartition(n, *keys).groupBy("img", "gx", "gy").agg(F.collect_list("_px").alias("_px"))  # at most BLOCK x BLOCK pixels
    met = packed.join(sources.hint("merge"), keys).drop("gx", "gy").select("*", *made).withColumn("_px", F.explode("_px")).select("*", "_px.*")
    inside = (F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1"))
    return met.where(inside).drop("_px", "bx0", "bx1", "by0", "by1")


def boxes_in_tasks(pixels: DataFrame, sources: DataFrame, half: Column, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, side: int = 64, of_images: DataFrame | None = None) -> DataFrame:
    """Rows of task(sources, pixels) for the sources that lie in each tile of side x side pixels in each image, and all pixels of their boxes, which other tiles may get as well.

    Pixels meet a tile once, however many of its sources hold them, so a source's box is cut out
    inside the task (columns bx0 to by1, half-open). Sources without a pixel's block get no call.
    of_images: a row an image (img, ...), which comes once a tile, as the row of sources whose
    column head is true; images without one get no call.
    """
    spark = pixels.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # fits and renders: bytes must not decide
    home = [F.floor(F.bround(c, 0) / side).alias(t) for c, t in (("px", "tx"), ("py", "ty"))]
    box = boxed(sources.select("*", *home), half)
    need = box.select("tx", "ty", "gx", "gy").distinct()
    at = pixels.select("*", F.floor(F.col("x") / BLOCK).alias("gx"), F.floor(F.col("y") / BLOCK).alias("gy"))
    at = at.join(need.hint("merge"), ["gx", "gy"]).drop("gx", "gy").repartition(n, "img", "tx", "ty")
    has = at.select(F.col("img").alias("s_img"), F.col("tx").alias("s_tx"), F.col("ty").alias("s_ty")).distinct()
    cx, cy, h = F.bround("px", 0).cast("int"), F.bround("py", 0).cast("int"), half.cast("int")
    mine = sources.select("*", *[c.alias(f"s_{t}") for c, t in zip(home, ("tx", "ty"), strict=True)], (cx - h).alias("bx0"), (cx + h + 1).alias("bx1"), (cy - h).alias("by0"), (cy + h + 1).alias("by1"))
    near = mine.hint("merge").join(has, ["s_tx", "s_ty"])
    if of_images is not None:
        head = has.join(F.broadcast(of_images.withColumnRenamed("img", "s_img")), "s_img")  # a row an image
        zero = [F.lit(0).cast(f.dataType).alias(f.name) for f in near.schema if f.name not in head.columns and isinstance(f.dataType, NumericType)]
        near = near.withColumn("head", F.lit(False)).unionByName(head.select("*", *zero, F.lit(True).alias("head")), allowMissingColumns=True)
    near = near.repartition(n, "s_img", "s_tx", "s_ty")
    both = near.groupBy("s_img", "s_tx", "s_ty").cogroup(at.groupBy("img", "tx", "ty"))
    return both.applyInPandas(lambda s, p: task(s, p) if len(s) and len(p) else pd.DataFrame(), schema)


def pixels_of_boxes(s: pd.DataFrame, p: pd.DataFrame, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of sources with about as many pixels in their boxes: numbers of their rows, an array of row numbers of p, a source a row, and which of them are no filling."""
    order = np.argsort(p.x.to_numpy(), kind="stable")
    x, y = p.x.to_numpy()[order], p.y.to_numpy()[order]
    lo, hi = np.searchsorted(x, s.bx0), np.searchsorted(x, s.bx1)
    inside = [order[a:b][(y[a:b] >= y0) & (y[a:b] < y1)] for a, b, y0, y1 in zip(lo, hi, s.by0, s.by1, strict=True)]
    size = np.array([len(i) for i in inside])
    by_size = np.argsort(size, kind="stable")
    by_size = by_size[size[by_size] > 0]
    k = len(by_size)
    while k:
        step = max(1, cells // int(size[by_size[k - 1]]))
        rows = by_size[max(0, k - step) : k]
        k -= len(rows)
        at, on = np.zeros((len(rows), size[rows].max()), int), np.arange(size[rows].max())[None] < size[rows][:, None]
        at[on] = np.concatenate([inside[r] for r in rows])
        yield rows, at, on


#: Pixels x sources of one dense array in a task.
CELLS = 1 << 19


def in_tiles(pixels: DataFrame, sources: DataFrame, half: Column, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, side: int = 64, margin: int = 0, home: bool = False) -> DataFrame:
    """Rows of task(sources, pixels) for each tile of side x side pixels that has both: its pixels in all images and all sources whose boxes reach into it (columns bx0 to by1, half-open).

    Sources are rendered where their pixels are, so only what task returns leaves it. A source gets
    a call for each tile that its box touches, and its sums are to be added up. With margin, pixels
    that near to the tile come as well; the column own tells the tile's from them. With home, a
    source gets one call, in the tile of its centre, which has its box if no half is above margin.
    """
    spark = pixels.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # renders: bytes must not decide
    tile = lambda a, b: F.floor(a / side) if a is b else F.explode(F.sequence(F.floor(a / side), F.floor(b / side)))
    x, y = F.col("x"), F.col("y")
    at = pixels.where("x IS NOT NULL AND y IS NOT NULL").select("*", *([] if not margin else [(F.lit(True)).alias("own")]))
    for c, t in ((x, "tx"), (y, "ty")):
        at = at.withColumn(t, tile(c - margin, c + margin) if margin else tile(c, c))
    if margin:
        at = at.withColumn("own", (F.floor(x / side) == F.col("tx")) & (F.floor(y / side) == F.col("ty")))
    cx, cy, h = F.bround("px", 0).cast("int"), F.bround("py", 0).cast("int"), half.cast("int")
    near = sources.where(cx.isNotNull() & cy.isNotNull() & h.isNotNull()).select("*", *[c.alias(k) for c, k in ((cx - h, "bx0"), (cx + h + 1, "bx1"), (cy - h, "by0"), (cy + h + 1, "by1"))])
    near = near.withColumn("s_tx", tile(cx, cx) if home else tile(F.col("bx0"), F.col("bx1") - 1)).withColumn("s_ty", tile(cy, cy) if home else tile(F.col("by0"), F.col("by1") - 1))
    both = near.repartition(n, "s_tx", "s_ty").groupBy("s_tx", "s_ty").cogroup(at.repartition(n, "tx", "ty").groupBy("tx", "ty"))
    return both.applyInPandas(lambda s, p: task(s, p) if len(s) and len(p) else pd.DataFrame(), schema)


def by_images(p: pd.DataFrame, sources: int) -> Iterator[tuple[float, dict[str, np.ndarray]]]:
    """Each image with the columns of its pixels, not more at a time than CELLS has room for with so many sources."""
    img = p.img.to_numpy()
    order = np.argsort(img, kind="stable")
    columns, step = {c: p[c].to_numpy()[order] for c in p.columns}, max(1, CELLS // max(1, sources))
    ends = [0, *(np.flatnonzero(img[order][1:] != img[order][:-1]) + 1), len(p)]
    for a, b in zip(ends, ends[1:], strict=False):
        for k in range(a, b, step):
            yield img[order[a]], {c: v[k : min(b, k + step)] for c, v in columns.items()}


def factors(at: np.ndarray, centre: np.ndarray, var: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """exp(-(at - centre)^2 / 2 var) of each source (a column) at the places `at` of one axis, none outside its box: a round Gaussian is the product of one factor in x and one in y."""
    at = at[:, None]
    return np.where((at >= lo) & (at < hi), np.exp(-0.5 * (at - centre) ** 2 / var), 0.0)


def gaussians(s: pd.DataFrame, x: np.ndarray, y: np.ndarray, parts: tuple[tuple[float, float], ...] = ((1.0, 1.0),)) -> np.ndarray:
    """(pixels, sources): unit flux of round sources (px, py, sig) at the pixels inside their boxes; parts are amplitudes and variances in units of sig squared."""
    x0, y0, var, out = int(x.min()), int(y.min()), s.sig.to_numpy(float) ** 2, 0.0
    for a, v in parts:
        fx, fy = (factors(np.arange(o, int(k.max()) + 1), s[c].to_numpy(float), v * var, s[lo].to_numpy(), s[hi].to_numpy()) for o, k, c, lo, hi in ((x0, x, "px", "bx0", "bx1"), (y0, y, "py", "by0", "by1")))
        out = out + (fx * (a / (2 * math.pi * v * var)))[x - x0] * fy[y - y0]
    return out


def gauss_unit(dx: Column, dy: Column, sigma: Column) -> Column:
    """Unit-flux round Gaussian."""
    return F.exp(-0.5 * (dx * dx + dy * dy) / (sigma * sigma)) / (2 * math.pi * sigma * sigma)


def unit_models(pixels: DataFrame, sources: DataFrame, psf: Column, half: Column, shape: Column | None = None, parts: int | None = None) -> DataFrame:
    """img, sid, x, y, d, iv, u: unit flux of each source under a PSF mixture, convolved with its own profile where one is given. parts: the most components the result can have, where it is known; that makes plain columns of them."""
    met = blocks_join(pixels, boxed(sources, half), mog.prepared(psf if shape is None else mog.convolve(shape, psf)).alias("_mog"))
    return met.withColumn("u", mog.evaluate_prepared(F.col("_mog"), F.col("x") - F.col("px"), F.col("y") - F.col("py"), parts)).drop("_mog")


def model_image(pixels: DataFrame, umod: DataFrame, sky: Column | float = 0.0) -> DataFrame:
    """img, x, y, d, iv, m: sky and all patches added up at every pixel. Patches are summed before they meet the pixels."""
    patches = umod.groupBy("img", "x", "y").agg(F.sum(F.col("u") * F.col("flux")).alias("_m"))
    s = F.lit(sky) if not isinstance(sky, Column) else sky
    return pixels.join(patches, ["img", "x", "y"], "left").select("img", "x", "y", "d", "iv", (F.coalesce("_m", F.lit(0.0)) + s).alias("m"))


def chi(d: Column, m: Column, iv: Column) -> Column:
    return (d - m) * F.sqrt(iv)


def log_likelihood(model: DataFrame) -> DataFrame:
    """-1/2 sum of squared residuals, for each image."""
    c = chi(F.col("d"), F.col("m"), F.col("iv"))
    return model.groupBy("img").agg((F.sum(c * c) * -0.5).alias("lnl"), F.sum(F.when(F.col("iv") > 0, 1).otherwise(0)).alias("n"))
