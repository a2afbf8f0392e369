"""Derivatives of Sersic profiles against every pixel written out, and what meets the pixels."""

import duckdb
import numpy as np
import pytest

from pixelframe.operators import splines
from pixelframe.plans.registry import QUERIES
from pixelframe.sources.fixtures import SQL

SF = "/root/testdata/sf0.001"


def profile(n, r, d2):
    n = min(max(n, splines.SERSIC_LOW), splines.SERSIC_HIGH)
    k = min(splines.SERSIC_PIECES - 1, int((n - splines.SERSIC_LOW) // splines.SERSIC_STEP))
    t = n - (splines.SERSIC_LOW + k * splines.SERSIC_STEP)
    raw = [max(0.0, sum(c * t**p for p, c in enumerate(row))) for row in np.asarray(splines.sersic_table())[k].tolist()]
    return sum(a / sum(raw) / (2 * np.pi * (v * r * r + 2)) * np.exp(-0.5 * d2 / (v * r * r + 2)) for a, v in zip(raw, splines.SERSIC_VARIANCES, strict=True))


def test_derivatives(spark):
    got = {(r.sid, r.img): (r.total, r.peak) for r in QUERIES["sersic_derivs"](spark, SF).collect()}
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    img, x, y = con.sql(f"SELECT img, x, y FROM ({SQL['pixels']})").fetchnumpy().values()
    want = {}
    for sid, px, py, sig, size in con.sql(f"SELECT sid, px, py, sig, psize FROM ({SQL['srcs']})").fetchall():
        h, cx, cy = np.ceil(sig * 5), round(px), round(py)
        inside = (abs(x - cx) <= h) & (abs(y - cy) <= h)
        v = np.zeros(len(x))
        d2 = (x[inside] - px) ** 2 + (y[inside] - py) ** 2
        v[inside] = (profile(0.51 + size / 10, 1 + size % 3, d2) - profile(0.5 + size / 10, 1 + size % 3, d2)) / 0.01
        want |= {(sid, int(i)): (v[(img == i) & inside].sum(), abs(v[(img == i) & inside]).max()) for i in np.unique(img[inside])}
    assert got.keys() == want.keys() and len(got) > 500
    for k, (total, peak) in want.items():
        assert got[k] == (pytest.approx(total, abs=6e-5), pytest.approx(peak, abs=6e-6))


@pytest.mark.parametrize("name", ["sersic_render", "sersic_derivs"])
def test_pixels_meet_tiles_once(spark, name):
    """Sources dealt into blocks ask for pixels without their profiles, each block once a tile."""
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in text and "array<array<double>>" not in text and "EXP(" not in text
