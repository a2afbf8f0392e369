"""Holes, blobs, peaks and bitmasks against flood fills over dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import detection as det
from pixelframe.operators import images as im
from pixelframe.plans.image_queries import SEDS
from pixelframe.plans.registry import QUERIES
from pixelframe.sources.fixtures import fixture


def flood(free, starts, diagonal):
    """Cells of `free` that chains of neighbours join to the starts."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a or not b)]
    seen, todo = np.zeros_like(free), [s for s in starts if free[s]]
    for s in todo:
        seen[s] = True
    while todo:
        y, x = todo.pop()
        for a, b in steps:
            p = y + a, x + b
            if 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p] and not seen[p]:
                seen[p] = True
                todo.append(p)
    return seen


def brute_filled(mask):
    wide = np.pad(mask, 1)
    return ~flood(~wide, [(0, 0)], False)[1:-1, 1:-1]


def brute_labels(mask):
    """Label of each marked cell: the least (y, x) of its component, as y * 2^20 + x."""
    out = np.full(mask.shape, -1, np.int64)
    for y, x in np.argwhere(mask):
        if out[y, x] < 0:
            out[flood(mask, [(y, x)], True)] = (y << 20) + x
    return out


@pytest.mark.parametrize("chunk", [4096, 7])
def test_holes(spark, monkeypatch, chunk):
    """Random masks, rings in rings, a spiral that leads out, and rows longer than a piece."""
    monkeypatch.setattr(det, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    masks = [rng.random((20, 30)) < p for p in (0.4, 0.6, 0.75)]
    ring = np.zeros((15, 15), bool)
    for k in (1, 4):
        ring[k : 15 - k, k : 15 - k] = True
        ring[k + 1 : 14 - k, k + 1 : 14 - k] = False
    spiral = ring.copy()
    spiral[1, 7] = spiral[4, 5] = False
    masks += [ring, spiral, np.ones((1, 3), bool)]
    rows = [(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    got = {(r.img, r.x, r.y) for r in det.filled(spark.createDataFrame(rows, "img int, x int, y int")).collect()}
    assert got == {(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in np.argwhere(brute_filled(m))}


def test_long_rows(spark):
    """A bar over the end of a piece of a row is one blob."""
    rows = [(1, x, 3) for x in range(4090, 4102)] + [(1, 4095, 4), (1, 4200, 3)]
    got = {(r.x, r.y): r.label for r in im.blobs(spark.createDataFrame(rows, "img int, x int, y int")).collect()}
    assert set(got.values()) == {(3 << 20) + 4090, (3 << 20) + 4200} and got[4101, 3] == got[4095, 4] == (3 << 20) + 4090


def test_detections_query(spark):
    """Every field and all images: peaks, sizes, new ones and bitmasks."""
    sf = "/root/testdata/sf0.001"
    p = fixture(spark, sf, "pixels").toPandas()
    band = np.array(["z", "g", "r"])[p.img % 3]
    h, w = p.y.max() + 1, p.x.max() + 1
    mean, iv = {}, {}
    for b in "grz":
        q = p[band == b]
        iv[b], top = np.zeros((h, w)), np.zeros((h, w))
        np.add.at(iv[b], (q.y, q.x), q.iv)
        np.add.at(top, (q.y, q.x), q.iv * q.d)
        mean[b] = np.divide(top, iv[b], out=np.zeros((h, w)), where=iv[b] > 0)
    peaks, detmask, peakmask, kept = [], np.zeros((h, w), int), np.zeros((h, w), int), []
    for k, (name, fs) in enumerate(SEDS):
        there = sum(iv[b] for b in fs) > 0
        den = np.sqrt(sum(f * f * iv[b] for b, f in fs.items()))
        sn = np.divide(sum(f * mean[b] * iv[b] for b, f in fs.items()), den, out=np.full((h, w), -np.inf), where=there)
        mask = brute_filled(sn > 130)
        detmask |= mask << k
        labels, new = brute_labels(mask), []
        for label in np.unique(labels[mask]):
            at = sorted((-sn[y, x], y, x) for y, x in np.argwhere(labels == label) if there[y, x])[0]
            near = any((x - at[2]) ** 2 + (y - at[1]) ** 2 <= 2.5**2 for x, y in kept)
            new += [] if near else [(at[2], at[1])]
            peakmask[at[1], at[2]] |= 1 << k
            peaks.append((name, int(label), int(at[2]), int(at[1]), int((labels == label).sum()), not near))
        kept += new
    got = QUERIES["sed_detections"](spark, sf).collect()
    assert sorted((r.sed, r.label, r.x, r.y, r.n, r.fresh) for r in got) == sorted(peaks) and {r.fresh for r in got} == {True, False}
    assert max(r.n for r in got) > 3
    bits = {(r.x, r.y): (r.detmask, r.peakmask) for r in QUERIES["sed_bitmask"](spark, sf).where(F.col("x") >= 0).collect()}
    assert bits == {(int(x), int(y)): (int(detmask[y, x]), int(peakmask[y, x])) for y, x in np.argwhere(detmask > 0)}


def test_rows_of_many_runs(spark, monkeypatch):
    """Runs and gaps of neighbouring rows meet inside pieces of a row: work grows with its length, not with the square of its runs."""
    from pyspark.sql import functions as F

    from pixelframe.operators import detection, images

    plans, of = [], images.components

    def spy(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return of(links)

    monkeypatch.setattr(images, "components", spy)
    monkeypatch.setattr(detection, "components", spy)
    mask = spark.range(300).select(F.lit(1).alias("img"), (F.col("id") * 3).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y"))
    labels = images.blobs(mask).groupBy("label").count().collect()
    assert sorted(r.label for r in labels) == [3 * k for k in range(300)] and {r["count"] for r in labels} == {4}
    assert detection.holes(mask).count() == 0
    assert len(plans) == 2 and all("_cell" in p for p in plans)


def test_interval_pairs(spark):
    """Each pair once, whichever pieces the intervals span."""
    import random

    from pixelframe.operators.images import interval_pairs

    rng = random.Random(4)
    one = [(k, k % 2, a, a + rng.choice([0, 3, 70, 400])) for k in range(60) for a in [rng.randint(-200, 600)]]
    two = [(k, k % 2, a, a + rng.choice([0, 5, 64, 300])) for k in range(60) for a in [rng.randint(-200, 600)]]
    got = interval_pairs(spark.createDataFrame(one, "i long, y int, a0 int, a1 int"), spark.createDataFrame(two, "j long, y int, b0 int, b1 int"), ["y"], ("a0", "a1"), ("b0", "b1")).collect()
    want = sorted((p[0], q[0]) for p in one for q in two if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert sorted((r.i, r.j) for r in got) == want
