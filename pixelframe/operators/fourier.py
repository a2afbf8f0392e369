"""Sources under pixelised PSFs: profiles multiply the PSF's Fourier transform, sub-pixel shifts are Lanczos kernels, parts too wide for the transform stay mixtures.

A stamp of the PSF is a row an image. Sources meet it by image, partitions are sorted by image
and size of the transform, and a task keeps the one transform that its present rows share, so a
crowded image is spread over any number of tasks. What a task holds is a chunk of sources of
bounded area and one source's own box; the boxes of sources must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import BLOCK, boxes_in_tasks, pixels_of_boxes
from .solve import em_fit

#: Cells of one chunk of transforms.
AREA = 1 << 19
#: Between these many standard deviations inside half the transform's side, a part goes over from a mixture to the transform.
RAMP = (3.0, 4.0)


def psf_table(stamps: DataFrame, parts: int = 2) -> DataFrame:
    """img, side, stamp, amp, mx, my, vxx, vxy, vyy: the normalised stamp of each image, row by row, and its approximation by a mixture.

    stamps: img, dx, dy (from the centre), v; pixels that are absent or below zero count zero, the
    side is the least odd one that holds all others. Images whose stamp has no flux get no row.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        half = int(max(pdf.dx.abs().max(), pdf.dy.abs().max()))
        stamp = np.zeros((2 * half + 1, 2 * half + 1))
        np.add.at(stamp, (pdf.dy + half, pdf.dx + half), np.maximum(pdf.v.to_numpy(float), 0.0))
        if not stamp.sum() > 0:
            return pd.DataFrame()
        stamp /= stamp.sum()
        fit = em_fit(stamp, parts, alpha=0.1)
        fit[:, 0] /= fit[:, 0].sum()
        fit[:, 1:3] -= half
        row = {"img": pdf.img.iloc[0], "side": 2 * half + 1, "stamp": stamp.ravel(), **dict(zip(("amp", "mx", "my", "vxx", "vxy", "vyy"), fit.T, strict=True))}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    lists = ", ".join(f"{c} array<double>" for c in ("stamp", "amp", "mx", "my", "vxx", "vxy", "vyy"))
    return stamps.where("v IS NOT NULL").groupBy("img").applyInPandas(one, f"img int, side int, {lists}")


def transform(stamp: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Transform of a stamp set into the middle of size x size zeros, and the place of its centre along each axis."""
    side = len(stamp)
    at = (size - side) // 2
    pad = np.zeros((size, size))
    pad[at : at + side, at : at + side] = stamp
    return np.fft.rfft2(pad), at + side // 2


def shifted(g: np.ndarray, shift: np.ndarray, axis: int) -> np.ndarray:
    """Each image of g moved by its own shift of at most a pixel along an axis: seven Lanczos weights of sum one, zeros beyond the edges."""
    at = np.arange(-3, 4) + shift[:, None]
    w = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
    w /= w.sum(axis=1, keepdims=True)
    n = g.shape[axis]
    padded = np.pad(g, [(3, 3) if a == axis else (0, 0) for a in range(3)])
    return sum(w[:, t, None, None] * (padded[:, :, t : t + n] if axis == 2 else padded[:, t : t + n]) for t in range(7))


def wide_share(vxx: np.ndarray, vyy: np.ndarray, size: int) -> np.ndarray:
    """Share of each part that is left to the mixture: one where half a transform holds at most three of its standard deviations, none from four on."""
    n = size / 2 / np.maximum(1e-6, np.sqrt(vxx + vyy))
    return np.clip((RAMP[1] - n) / (RAMP[1] - RAMP[0]), 0.0, 1.0)


def patches(psf: dict, size: int, px: np.ndarray, py: np.ndarray, boxes: np.ndarray, mix: np.ndarray) -> list[np.ndarray]:
    """Unit-flux images of sources inside their boxes.

    psf: a row of psf_table, with the stamp's transform and centre; boxes: (x0, y0, w, h) a source;
    mix: (source, part, (amp, vxx, vxy, vyy)) about the source, parts without flux as filling. A
    source whose centre lies outside of its box is a mixture altogether.
    """
    amp, vxx, vxy, vyy = np.moveaxis(mix, 2, 0)
    x0, y0, w, h = boxes.T
    out = (px < x0) | (px > x0 + w - 1) | (py < y0) | (py > y0 + h - 1)
    wide = np.where(out[:, None], 1.0, wide_share(vxx, vyy, size))
    fy, fx = np.fft.fftfreq(size)[:, None], np.fft.rfftfreq(size)[None]
    spec = np.zeros((len(px), size, size // 2 + 1))
    for k in range(amp.shape[1]):
        a, p, q, r = ((c[:, k])[:, None, None] for c in (amp * (1 - wide), vxx, vxy, vyy))
        if a.any():
            spec += a * np.exp(-2 * np.pi**2 * (p * fx * fx + 2 * q * fx * fy + r * fy * fy))
    g = np.fft.irfft2(spec * psf["transform"], s=(size, size))
    mx, my = px - psf["centre"] - x0, py - psf["centre"] - y0
    sx, sy = np.floor(mx + 0.5).astype(int), np.floor(my + 0.5).astype(int)
    g = shifted(shifted(g, mx - sx, 2), my - sy, 1)
    got = []
    for i in range(len(px)):
        img = np.zeros((h[i], w[i]))
        ya, yb, xa, xb = max(0, sy[i]), min(h[i], sy[i] + size), max(0, sx[i]), min(w[i], sx[i] + size)
        if ya < yb and xa < xb:
            img[ya:yb, xa:xb] = g[i, ya - sy[i] : yb - sy[i], xa - sx[i] : xb - sx[i]]
        for k in np.flatnonzero(amp[i] * wide[i]):
            for a, ux, uy, p, q, r in zip(*(psf[c] for c in ("amp", "mx", "my", "vxx", "vxy", "vyy")), strict=True):
                dx, dy = np.arange(w[i])[None] + x0[i] - px[i] - ux, np.arange(h[i])[:, None] + y0[i] - py[i] - uy
                p, q, r = p + vxx[i, k], q + vxy[i, k], r + vyy[i, k]
                det = p * r - q * q
                img += amp[i, k] * wide[i, k] * a / (2 * np.pi * np.sqrt(det)) * np.exp(-0.5 * (r * dx * dx - 2 * q * dx * dy + p * dy * dy) / det)
        got.append(img)
    return got


def _in_blocks(img: np.ndarray, x0: int, y0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of pixels that an image touches: their places, and their values with NaN outside of it."""
    gx, gy = x0 // BLOCK, y0 // BLOCK
    nx, ny = (x0 + img.shape[1] - 1) // BLOCK - gx + 1, (y0 + img.shape[0] - 1) // BLOCK - gy + 1
    full = np.full((ny * BLOCK, nx * BLOCK), np.nan)
    full[y0 - gy * BLOCK : y0 - gy * BLOCK + img.shape[0], x0 - gx * BLOCK : x0 - gx * BLOCK + img.shape[1]] = img
    values = full.reshape(ny, BLOCK, nx, BLOCK).transpose(0, 2, 1, 3).reshape(-1)
    return np.tile(np.arange(gx, gx + nx), ny), np.repeat(np.arange(gy, gy + ny), nx), values


def image_sources(pixels: DataFrame, sources: DataFrame, half: Column) -> DataFrame:
    """sources (px, py) with x0, y0, w, h of the box of half-width `half` about the rounded position, once for each image that has pixels in a block of it."""
    x, y, b = F.bround("px", 0).cast("long"), F.bround("py", 0).cast("long"), half.cast("long")
    box = sources.withColumns({"x0": x - b, "y0": y - b, "w": 2 * b + 1, "h": 2 * b + 1})
    blocks = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor((F.col(a) + F.col(n) - 1) / BLOCK)))
    met = box.select("sid", "x0", "y0", "w", "h", blocks("x0", "w").alias("gx")).select("sid", "gx", blocks("y0", "h").alias("gy"))
    has = pixels.select("img", F.floor(F.col("x") / BLOCK).alias("gx"), F.floor(F.col("y") / BLOCK).alias("gy")).distinct()
    # merges: the planner doesn't know how far sources grow in blocks and with arrays, and would broadcast them
    return box.hint("merge").join(met.hint("merge").join(has, ["gx", "gy"]).select("sid", "img").distinct(), "sid")


def transform_size() -> Column:
    """The least power of two that holds twice the way from the source to the far edge of its box, and the stamp."""
    c = F.col
    far = F.greatest(c("w") / 2, c("h") / 2, 1 + c("px") - c("x0"), 1 + c("x0") + c("w") - c("px"), 1 + c("py") - c("y0"), 1 + c("y0") + c("h") - c("py"), c("side") / 2)
    return F.pow(F.lit(2.0), F.length(F.bin(2 * F.ceil(far) - 1))).cast("int")


def unit_blocks(sources: DataFrame, psf: DataFrame, shape: Column | None = None) -> DataFrame:
    """sid, img, gx, gy, u: unit-flux values of each source in each block of its box, row by row, NaN outside of the box.

    sources: sid, img, px, py, x0, y0, w, h; psf: from psf_table; shape: a mixture about the source
    (means are not read), none for point sources. Sources in images without a PSF get no row, nor do
    those with a null among these columns.
    """
    names = ("amp", "vxx", "vxy", "vyy")
    mix = {f"s_{c}": shape.getField(c) if shape is not None else F.array(F.lit(1.0 if c == "amp" else 0.0)) for c in names}
    s = sources.dropna(subset=["sid", "img", "px", "py", "x0", "y0", "w", "h"]).where("w > 0 AND h > 0").select("sid", "img", "px", "py", "x0", "y0", "w", "h", *[c.alias(n) for n, c in mix.items()])
    rows = s.join(psf, "img").withColumn("size", transform_size())
    spark = sources.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "sid", "img").sortWithinPartitions("img", "size")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, {}
        for batch in batches:
            pdf = batch.to_pandas()
            for (img, size), part in pdf.groupby(["img", "size"], sort=False):
                if key != (img, size):
                    one = part.iloc[0]
                    key, now = (img, size), {c: one[c] for c in ("amp", "mx", "my", "vxx", "vxy", "vyy")}
                    now["transform"], now["centre"] = transform(np.asarray(one.stamp).reshape(one.side, one.side), int(size))
                step = max(1, AREA // int(size) ** 2)
                for k in range(0, len(part), step):
                    yield _rendered(now, int(size), part.iloc[k : k + step])

    return rows.mapInArrow(task, "sid long, img int, gx long, gy long, u array<double>")


def _rendered(psf: dict, size: int, part: pd.DataFrame) -> pa.RecordBatch:
    columns = [part[f"s_{c}"].to_list() for c in ("amp", "vxx", "vxy", "vyy")]
    mix = np.zeros((len(part), max(map(len, columns[0])), 4))
    for j, column in enumerate(columns):
        for i, v in enumerate(column):
            mix[i, : len(v), j] = v
    boxes = part[["x0", "y0", "w", "h"]].to_numpy(np.int64)
    cut = [_in_blocks(p, int(b[0]), int(b[1])) for p, b in zip(patches(psf, size, part.px.to_numpy(float), part.py.to_numpy(float), boxes, mix), boxes, strict=True)]
    times = [len(c[0]) for c in cut]
    u = np.concatenate([c[2] for c in cut])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(u) + 1, BLOCK * BLOCK, dtype=np.int32)), pa.array(u))
    ids = [pa.array(np.repeat(part.sid.to_numpy(np.int64), times)), pa.array(np.repeat(part.img.to_numpy(np.int32), times)), *(pa.array(np.concatenate([c[k] for c in cut]).astype(np.int64)) for k in (0, 1))]
    return pa.RecordBatch.from_arrays([*ids, lists], names=["sid", "img", "gx", "gy", "u"])


def unit_models(pixels: DataFrame, blocks: DataFrame) -> DataFrame:
    """sid and u with all columns of pixels (img, x, y, ...), for every pixel inside the box of every source. Only pixels that exist count: masked ones are left out beforehand."""
    p = pixels.withColumns({"gx": F.floor(F.col("x") / BLOCK), "gy": F.floor(F.col("y") / BLOCK)})
    at = F.get("u", ((F.col("y") - BLOCK * F.col("gy")) * BLOCK + F.col("x") - BLOCK * F.col("gx")).cast("int"))
    met = p.join(blocks.hint("merge"), ["img", "gx", "gy"]).withColumn("u", at)
    return met.where(~F.isnan("u")).drop("gx", "gy")


def pixel_sums(pixels: DataFrame, sources: DataFrame, half: Column, psf: DataFrame, shape: str | None = None) -> DataFrame:
    """sid, img, total, b, a: sums of u, u d iv and u u iv over the pixels (img, x, y, d, iv) in the box of each source in each image, u being its unit-flux image as in unit_blocks.

    Sources are rendered in the task that holds their pixels, so no image of a source is shuffled.
    sources: sid, px, py and the mixture named by shape, none for point sources.
    """

    def task(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        head, s = s[s["head"]], s[~s["head"]].reset_index(drop=True)
        if not len(head) or not len(s):
            return pd.DataFrame()
        one = head.iloc[0]
        side, px, py = int(one.side), s.px.to_numpy(float), s.py.to_numpy(float)
        boxes = np.column_stack([s.bx0, s.by0, s.bx1 - s.bx0, s.by1 - s.by0]).astype(np.int64)
        x0, y0, w, h = boxes.T
        far = np.max([w / 2, h / 2, 1 + px - x0, 1 + x0 + w - px, 1 + py - y0, 1 + y0 + h - py, np.full(len(s), side / 2)], axis=0)
        size = np.array([1 << int(2 * np.ceil(f) - 1).bit_length() for f in far])
        mix = np.zeros((len(s), max([1, *map(len, s["s_amp"])]) if shape else 1, 4))
        if shape:
            for j, c in enumerate(("amp", "vxx", "vxy", "vyy")):
                for i, v in enumerate(s[f"s_{c}"]):
                    mix[i, : len(v), j] = v
        else:
            mix[:, 0, 0] = 1.0
        x, y, d, iv = (p[c].to_numpy() for c in ("x", "y", "d", "iv"))
        psfs, out = {}, []
        for rows, at, on in pixels_of_boxes(s, p):
            for n in np.unique(size[rows]):
                if n not in psfs:
                    turned, centre = transform(np.asarray(one.stamp).reshape(side, side), int(n))
                    psfs[n] = {**{c: one[c] for c in ("amp", "mx", "my", "vxx", "vxy", "vyy")}, "transform": turned, "centre": centre}
                mine = np.flatnonzero(size[rows] == n)
                step = max(1, AREA // int(n) ** 2)
                for part in (mine[k : k + step] for k in range(0, len(mine), step)):
                    r = rows[part]
                    for i, k, img in zip(part, r, patches(psfs[n], int(n), px[r], py[r], boxes[r], mix[r]), strict=True):
                        q = at[i][on[i]]
                        u = img[y[q] - y0[k], x[q] - x0[k]]
                        out.append((s.sid[k], one.s_img, u.sum(), (u * d[q] * iv[q]).sum(), (u * u * iv[q]).sum()))
        return pd.DataFrame(out, columns=["sid", "img", "total", "b", "a"])

    mixed = sources.select("sid", "px", "py", *([F.col(shape).getField(c).alias(f"s_{c}") for c in ("amp", "vxx", "vxy", "vyy")] if shape else [])).dropna(subset=["sid", "px", "py"])
    px = pixels.select("img", "x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("d", "iv")])  # nulls add nothing
    return boxes_in_tasks(px, mixed, half, task, "sid long, img int, total double, b double, a double", of_images=psf)
