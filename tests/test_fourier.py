"""Galaxies and stars under pixelised PSFs: against mixtures, explicit sums and masks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import fourier as fo
from pixelframe.operators import mixtures as mog
from pixelframe.plans import model_queries as mq
from pixelframe.sources.fixtures import fixture

SF = "/root/testdata/sf0.001"
PSF_VAR = (6.0, -1.0, 6.0)


def gauss(x, y, var):
    p, q, r = var
    det = p * r - q * q
    return np.exp(-0.5 * (r * x * x - 2 * q * x * y + p * y * y) / det) / (2 * np.pi * np.sqrt(det))


def psf_row(half=15, var=PSF_VAR, size=64):
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    stamp = gauss(x, y, var)
    spec, centre = fo.transform(stamp, size)
    p, q, r = var
    return {"transform": spec, "centre": centre, "stamp": stamp, "amp": [1.0], "mx": [0.0], "my": [0.0], "vxx": [p], "vxy": [q], "vyy": [r]}


def galaxy(kind, re=2.0, ab=0.5, phi=math.pi / 4):
    c, s = math.cos(phi), math.sin(phi)
    m = np.array([[re * c, -re * ab * s], [re * s, re * ab * c]])
    return np.array([[[a, *(v * m @ m.T)[[0, 0, 1], [0, 1, 1]]] for a, v in mog.profile(kind)]])


def direct(mix, x, y):
    return sum(a * gauss(x, y, (p + PSF_VAR[0], q + PSF_VAR[1], r + PSF_VAR[2])) for a, p, q, r in mix[0])


@pytest.mark.parametrize("kind", ["exp", "dev"])
@pytest.mark.parametrize(("px", "py"), [(49.5, 50.0), (49.5, 50.5), (50.31, 49.83)])
def test_transform_and_mixture(kind, px, py):
    """A Gaussian PSF, pixelised and as it is, give nearly the same galaxy."""
    mix, box = galaxy(kind), np.array([[35, 34, 30, 31]])
    (got,) = fo.patches(psf_row(), 64, np.array([px]), np.array([py]), box, mix)
    want = direct(mix, np.arange(30)[None] + 35 - px, np.arange(31)[:, None] + 34 - py)
    assert got.shape == (31, 30) and np.abs(got - want).max() < 0.02 * want.max() < 2e-3


def test_masked():
    """The box decides which pixels are given, not what they hold; a centre outside of it is a mixture."""
    mix, at = galaxy("exp"), (np.array([49.7]), np.array([50.2]))
    (whole,) = fo.patches(psf_row(), 64, *at, np.array([[30, 30, 41, 41]]), mix)
    (part,) = fo.patches(psf_row(), 64, *at, np.array([[44, 41, 12, 22]]), mix)
    assert np.abs(part - whole[11:33, 14:26]).max() < 1e-6
    (out,) = fo.patches(psf_row(), 64, *at, np.array([[51, 41, 9, 22]]), mix)
    want = direct(mix, np.arange(9)[None] + 51 - at[0], np.arange(22)[:, None] + 41 - at[1])
    assert np.abs(out - want).max() < 1e-12


def test_wide_parts():
    """Parts of 3 to 4 standard deviations are shared out, so that a galaxy's image goes on smoothly as it grows; large ones don't wrap around."""
    assert fo.wide_share(np.array([1.0, 128.0 / 9, 64.0, 32 / 12.25]), np.array([1.0, 0.0, 64.0, 0.0]), 16) == pytest.approx([0, 1, 1, 0], abs=1e-12)
    assert fo.wide_share(np.array([(8 / 3.5) ** 2]), np.zeros(1), 16) == pytest.approx(0.5)
    box, row = np.array([[34, 34, 31, 31]]), psf_row()
    for re in (2.0, 6.0, 10.0, 20.0):
        mix = galaxy("exp", re)
        (got,) = fo.patches(row, 64, np.array([49.4]), np.array([49.1]), box, mix)
        want = direct(mix, np.arange(31)[None] + 34 - 49.4, np.arange(31)[:, None] + 34 - 49.1)
        assert np.abs(got - want).max() < 0.02 * want.max()


def test_explicit_sums():
    """An uneven stamp: the sum over all frequencies, and Lanczos weights, written out."""
    rng, size = np.random.default_rng(3), 32
    stamp = rng.random((5, 5))
    stamp /= stamp.sum()
    spec, centre = fo.transform(stamp, size)
    row = {"transform": spec, "centre": centre, **{c: [] for c in ("amp", "mx", "my", "vxx", "vxy", "vyy")}}
    mix = np.array([[[0.7, 6.0, 0.8, 6.4], [0.3, 5.0, 0.0, 7.0]]])
    px, py = 20.3, 11.5
    (got,) = fo.patches(row, size, np.array([px]), np.array([py]), np.array([[15, 6, 11, 12]]), mix)
    f = np.fft.fftfreq(size)
    prof = sum(a * np.exp(-2 * np.pi**2 * (p * f[None] ** 2 + 2 * q * f[None] * f[:, None] + r * f[:, None] ** 2)) for a, p, q, r in mix[0])
    n = np.arange(size)
    wave = np.exp(2j * np.pi * np.outer(f, n))
    pad = np.zeros((size, size))
    pad[13:18, 13:18] = stamp
    flat = (wave.T @ ((wave.conj() @ pad @ wave.conj().T) * prof) @ wave).real / size**2
    lan = lambda t: 0.0 if abs(t) >= 3 else float(np.sinc(t) * np.sinc(t / 3))
    ix, iy = math.floor(px + 0.5), math.floor(py + 0.5)
    wx, wy = ([lan(k + s) for k in range(-3, 4)] for s in (px - ix, py - iy))
    for y in range(6, 18):
        for x in range(15, 26):
            want = 0.0
            for i, a in enumerate(wy):
                for j, b in enumerate(wx):
                    u, v = y - iy + centre + i - 3, x - ix + centre + j - 3
                    want += a * b / sum(wx) / sum(wy) * (flat[u, v] if 0 <= u < size and 0 <= v < size else 0.0)
            assert got[y - 6, x - 15] == pytest.approx(want, abs=1e-12)


def test_query(spark):
    """Every galaxy in every image whose pixels it meets, against its own rendering of one source at a time."""
    px = fixture(spark, SF, "pixels").toPandas()
    psf = {r.img: r for r in fo.psf_table(mq._stamps(spark, SF)).collect()}
    got = {(r.sid, r.img): r for r in mq.galaxy_fft(spark, SF).collect()}
    srcs = fixture(spark, SF, "srcs").toPandas()
    seen = 0
    for s in srcs.itertuples():
        x0, y0 = round(s.px) - 12, round(s.py) - 12
        kind, r, phi = ("exp", "dev")[s.psize % 2], 1.0 + s.psize % 3, s.psize / 10
        mix = galaxy(kind, r, 0.4 + s.psize % 7 / 10, phi)
        near = px[(px.x >= x0) & (px.x <= x0 + 24) & (px.y >= y0) & (px.y <= y0 + 24)]
        for img, p in near.groupby("img"):
            row = psf[img].asDict()
            row["transform"], row["centre"] = fo.transform(np.reshape(row["stamp"], (9, 9)), 32)
            (u,) = fo.patches(row, 32, np.array([s.px]), np.array([s.py]), np.array([[x0, y0, 25, 25]]), mix)
            v = u[p.y - y0, p.x - x0]
            g = got[s.sid, img]
            a = (v * v * p.iv).sum()
            assert (g.total, g.flux_iv) == pytest.approx((v.sum(), a), abs=2e-6)
            assert g.flux is None if a < 9e-5 else a < 1.1e-4 or g.flux == pytest.approx((v * p.d * p.iv).sum() / a, abs=2e-3)
            seen += 1
    assert seen == len(got) > len(srcs)


def test_odd_rows(spark):
    """Nulls, images without a PSF, stamps without flux, empty tables and sources that repeat."""
    stamps = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 0, -5.0), (1, 1, 0, None), (2, 0, 0, 0.0)], "img int, dx int, dy int, v double")
    psf = fo.psf_table(stamps)
    (r,) = psf.collect()
    assert r.img == 1 and r.side == 3 and r.stamp == [0.0] * 4 + [1.0] + [0.0] * 4
    rows = [(1, 1, 4.0, 4.0), (1, 1, 4.0, 4.0), (2, 2, 4.0, 4.0), (3, 1, None, 4.0), (4, None, 4.0, 4.0)]
    s = spark.createDataFrame(rows, "sid long, img int, px double, py double").withColumns({k: F.lit(v).cast("long") for k, v in {"x0": 1, "y0": 2, "w": 7, "h": 5}.items()})
    pixels = spark.createDataFrame([(1, x, y, 1.0) for x in range(12) for y in range(12)], "img int, x int, y int, d double")
    got = fo.unit_models(pixels, fo.unit_blocks(s, psf)).collect()
    assert len(got) == 70 and {r.sid for r in got} == {1}
    assert {(r.x, r.y) for r in got} == {(x, y) for x in range(1, 8) for y in range(2, 7)}
    assert sum(r.u for r in got) == pytest.approx(2) and all(r.u == pytest.approx(float((r.x, r.y) == (4, 4)), abs=1e-12) for r in got)
    assert fo.unit_blocks(s.limit(0), psf).count() == 0 and fo.psf_table(stamps.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["pixel_psf_phot", "galaxy_fft"])
def test_no_image_of_a_source_is_shuffled(spark, name):
    """Sources are rendered where their pixels are: no rows with blocks of values leave a task."""
    from pixelframe.plans.registry import QUERIES

    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in text and "MapInArrow" not in text
