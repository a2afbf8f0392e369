"""Queries without SQL see whole tables: every source, every image."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import catalog, images, solve
from pixelframe.plans import model_queries
from pixelframe.plans.registry import QUERIES
from pixelframe.sources.fixtures import fixture, read

SF = "/root/testdata/sf0.01"


def keys(df, *cols):
    return {tuple(r) for r in df.select(*(cols or ["*"])).collect()}


def test_whole_sources(spark):
    parts = keys(read(spark, SF, "part"), "p_partkey")
    s = fixture(spark, SF, "srcs")
    assert keys(s, "sid") == parts and s.select("px", "py").distinct().count() == len(parts)
    assert keys(QUERIES["varying_psf"](spark, SF), "sid") == parts
    p = fixture(spark, SF, "pixels")
    line = read(spark, SF, "lineitem")
    assert tuple(p.agg(F.sum("iv"), F.sum("d")).first()) == tuple(line.agg(F.count(F.lit(1)).cast("double"), F.sum("l_quantity")).first())
    assert p.count() == p.select("img", "x", "y").distinct().count()


def test_whole_blended(spark):
    """Sources beyond the first field get fluxes."""
    assert max(keys(QUERIES["forced_phot_blended"](spark, SF), "sid")) > (1900,)


@pytest.mark.parametrize("name", ["galaxy_fft", "gauss_newton_fit", "optimise_loop", "multi_image_fit"])
def test_whole_ids(spark, name):
    """No source is left out by a filter on its id."""
    assert keys(QUERIES[name](spark, SF), "sid") == keys(read(spark, SF, "part"), "p_partkey")


def test_whole_samples(spark):
    small = SF.replace("0.01", "0.001")
    assert keys(QUERIES["mcmc_flux"](spark, small), "sid") == keys(model_queries._umod(spark, small), "sid")


def test_brightest(spark):
    """The source that lbfgs_fit takes in each image, against linear least squares."""
    u = model_queries._umod(spark, SF).where("img IN (1, 5)").toPandas()
    got = {r.img: r for r in QUERIES["lbfgs_fit"](spark, SF).collect()}
    assert set(got) == set(range(1, 8))
    for img, pdf in u.groupby("img"):
        one = pdf[pdf.flux == pdf.flux.max()]
        one = one[one.sid == one.sid.min()]
        w = np.sqrt(one.iv.to_numpy())
        flux, sky = np.linalg.lstsq(np.stack([one.u * w, w], axis=1), one.d * w, rcond=None)[0]
        assert got[img].flux == pytest.approx(flux, rel=1e-3, abs=0.5) and got[img].sky == pytest.approx(sky, rel=1e-3, abs=0.05)


@pytest.mark.parametrize("name", ["forced_phot_blended", "nonneg_phot"])
def test_whole_images(spark, name):
    small = SF.replace("0.01", "0.001")
    least = {"forced_phot_blended": "u > 1e-4", "nonneg_phot": "u > 1e-3"}[name]
    got = QUERIES[name](spark, small).select("sid", "img").collect()
    want = keys(model_queries._umod(spark, small).where(least), "sid", "img")
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {i for _, i in want} == set(range(1, 8))


def test_blobs_of_images(spark):
    """Two images with the same pixels and labels: neither values nor components meet."""
    hot = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, 6.0), (2, 0, 0, 7.0), (2, 1, 1, 1.0), (2, 9, 9, 2.0)], "img int, x int, y int, d double")
    far = (9 << 20) + 9
    assert keys(images.blob_boxes(hot)) == {(1, 0, 0, 1, 0, 0, 2, 6.0), (2, 0, 0, 1, 0, 1, 2, 7.0), (2, far, 9, 9, 9, 9, 1, 2.0)}
    assert keys(images.blob_maxima(hot)) == {(1, 0, 1, 0, 6.0), (2, 0, 0, 0, 7.0), (2, far, 9, 9, 2.0)}


def test_long_chains(spark):
    """Chains whose labels move one node a round under minimum labels with pointer jumping, however long."""
    for order in ([0, *range(299, 0, -1)], random.Random(8).sample(range(2000), 2000)):
        pairs = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
        got = catalog.groups_of(pairs, spark.range(max(order) + 3)).collect()
        assert sorted((r.id, r.grp) for r in got) == [(i, 0) for i in range(len(order))] + [(i, i) for i in range(len(order), len(order) + 2)]


def test_tall_blob(spark):
    """A U with arms of 450 rows, in two images, and a pixel of its own."""
    u = [(0, y) for y in range(451)] + [(2, y) for y in range(1, 451)] + [(1, 450)]
    px = spark.createDataFrame([(i, x, y) for i in (1, 2) for x, y in u] + [(2, 7, 7)], "img int, x int, y int")
    got = images.blobs(px).groupBy("img", "label").count()
    assert keys(got) == {(1, 0, len(u)), (2, 0, len(u)), (2, (7 << 20) + 7, 1)}


def test_fits_read_pixels(spark, tmp_path):
    """Pixels that hold a source of another place, flux and width than the catalogue says, in the second field and on a sky of each image's own."""
    spark.createDataFrame([(203, "n", "b", "t", 4, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    px, py = (203 * 7919) % 400 / 10 + 0.3, (203 * 104729) % 400 / 10 - 0.4

    def fits(name, sig):
        grid = [(1, 200 + x, y, i, 700 * math.exp(-0.5 * ((x - px) ** 2 + (y - py) ** 2) / sig(i) ** 2) / (2 * math.pi * sig(i) ** 2) + 2.0 * i) for x in range(40) for y in range(40) for i in (1, 2)]
        spark.createDataFrame(grid, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        return QUERIES[name](spark, str(tmp_path)).collect()

    got = fits("gauss_newton_fit", lambda i: 1.5)
    assert sorted(r.img for r in got) == [1, 2]
    for r in got:
        assert (r.sid, r.flux, r.px, r.py, r.sig) == pytest.approx((203, 700, 80 + px, py, 1.5), abs=2e-3)
    (r,) = fits("multi_image_fit", lambda i: 1 + 0.5 * (i % 3))
    assert (r.sid, r.flux, r.px, r.py, r.sky) == pytest.approx((203, 700, 80 + px, py, 6.0), abs=2e-3)


@pytest.mark.parametrize("name", ["tile_assign", "in_image_margin", "edge_cut", "patch_clip", "polygon_mask", "roi_clip", "fold_quadrant"])
def test_every_field(spark, name):
    """Ten times as many fields give about ten times as many rows."""
    small, large = (QUERIES[name](spark, SF.replace("0.01", sf)).count() for sf in ("0.001", "0.01"))
    assert large > 8 * small > 0


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_nonneg_to_the_end(n):
    """All positive, mixed and repeated columns: no gradient points inwards at zero, none is left where a flux is free."""
    rng = np.random.default_rng(n)
    m, true = rng.normal(size=(2 * n, n)), rng.uniform(1, 5, n)
    assert solve.nonneg_solve(m.T @ m, m.T @ m @ true) == pytest.approx(true)
    true[::3] *= -1
    twice = np.concatenate([m, m[:, : n // 4]], axis=1)
    for a in (m, twice):
        b = a.T @ (m @ true + rng.normal(size=2 * n))
        x = solve.nonneg_solve(a.T @ a, b)
        grad = b - a.T @ a @ x
        assert x.min(initial=0) >= 0 and grad.max(initial=0) < 1e-5 and np.abs(grad[x > 0]).max(initial=0) < 1e-5


def test_fits_of_a_chunk(monkeypatch):
    """Many fits at once end where one at a time ends, whatever stands beside them, and no fit runs by itself any more."""
    rng = np.random.default_rng(5)
    y, x = (np.tile(v.ravel().astype(float), (9, 1)) for v in np.mgrid[:11, :11])
    true = np.column_stack([rng.uniform(400, 900, 9), rng.uniform(4, 6, (9, 2)), rng.uniform(1, 2, 9), rng.uniform(0, 9, 9)])
    f = lambda p, k: p[0] * np.exp(-0.5 * ((x[k] - p[1]) ** 2 + (y[k] - p[2]) ** 2) / p[3] ** 2) / (2 * np.pi * p[3] ** 2) + p[4]
    v = np.stack([f(t, k) for k, t in enumerate(true)]) + rng.normal(size=x.shape)
    w = np.where(rng.random(x.shape) < 0.8, 1.0, 0.0)
    start = true * [0.7, 1.1, 0.9, 1.2, 1.0]
    got = solve.gaussian_fits(x, y, v, w, start)
    for k in range(9):
        one, _ = solve.levenberg(lambda p: (f(p, k) - v[k]) * w[k], start[k])  # noqa: B023
        assert got[k] == pytest.approx(one, rel=1e-6, abs=1e-6)


def test_fits_do_not_shuffle_pixels_of_sources(spark):
    """Pixels meet a tile once; no row for each pixel of each source is shuffled."""
    text = QUERIES["gauss_newton_fit"](spark, SF.replace("0.01", "0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in text and "FlatMapGroupsInPandas" not in text
