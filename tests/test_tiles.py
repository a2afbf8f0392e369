"""Sources are rendered in the task that holds their pixels: what such queries give on odd tables, and that no rendered pixel is shuffled."""

import math

import duckdb
import numpy as np
import pytest

from pixelframe.operators import photometry as ph
from pixelframe.operators import render as rd
from pixelframe.operators import solve
from pixelframe.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SUMS = "fitstats_source position_derivs mog_cutoff normal_matrix shared_columns forced_phot_pairs pair_covariance render_psf render_exp render_dev render_composite".split()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*SUMS, "mcmc_flux", "multi_image_fit"])
def test_no_rendered_pixel_leaves_its_task(spark, name):
    text = plan(spark, name)
    assert "FlatMapCoGroupsInPandas" in text and "Join" not in text and "Window" not in text


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Two fields that lie in three tiles, the second one over an edge of two; values that are null, and all of a pixel's; an image without them; sources that come twice, one of them with another width."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{SF}/part.parquet' WHERE p_partkey % 3 < 2 UNION ALL SELECT * REPLACE (p_partkey + 400 AS p_partkey) FROM '{SF}/part.parquet' UNION ALL SELECT * REPLACE (CASE p_partkey WHEN 109 THEN p_size + 1 ELSE p_size END::INT AS p_size) FROM '{SF}/part.parquet' WHERE p_partkey IN (31, 54, 109)) TO '{path}/part.parquet'")
    line = f"SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM '{SF}/lineitem.parquet'"
    con.sql(f"COPY ({line} UNION ALL SELECT * REPLACE (l_partkey + 400 AS l_partkey) FROM '{SF}/lineitem.parquet' WHERE l_linenumber <> 2) TO '{path}/lineitem.parquet'")
    return str(path)


@pytest.mark.parametrize("name", [n for n in [*SUMS, "psfex_eval", "resample_lanczos"] if n != "position_derivs"])
def test_odd_tables(spark, odd, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, odd).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_resampling_shuffles_pixels_only(spark):
    text = plan(spark, "resample_lanczos")
    assert "Join" not in text and text.count("Exchange hashpartitioning(") + text.count("REPARTITION_BY_NUM") <= 3


def test_stamps_are_broadcast_not_sources(spark):
    text = plan(spark, "psfex_eval")
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text
    assert "p_partkey" not in text[text.index("BroadcastExchange") :]


def test_brightest_is_rendered_alone(spark):
    text = plan(spark, "lbfgs_fit")
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 1


def test_nonneg_leaves_no_equation(spark, monkeypatch):
    monkeypatch.setattr(ph, "normal_equations", None)
    assert {r.img for r in QUERIES["nonneg_phot"](spark, SF).select("img").distinct().collect()} == set(range(1, 8))


def test_nonneg_of_long_chains(spark, monkeypatch):
    """Chains beyond a task's bound give what chains in tasks give."""
    rows = lambda: sorted(map(tuple, QUERIES["nonneg_phot"](spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(ph, "BLOCK_UNKNOWNS", 2)
    got = rows()
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-3)


def test_optimise_loop_reads_pixels_once(spark, monkeypatch):
    calls = []
    tiles = rd.in_tiles
    monkeypatch.setattr(rd, "in_tiles", lambda *a, **k: calls.append(1) or tiles(*a, **k))
    monkeypatch.setattr(rd, "render_join", None)
    got = {(r.sid, r.img): r for r in QUERIES["optimise_loop"](spark, SF).collect()}
    want = {(r.sid, r.img): r.flux for r in _isolated(spark)}
    assert calls == [1] and set(got) == set(want) and all(r.converged for r in got.values())
    assert [got[k].flux for k in sorted(want)] == pytest.approx([want[k] for k in sorted(want)], abs=2e-3)


def _isolated(spark):
    """Linear fluxes over the pixels of u above 1e-4, by SQL."""
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = ORACLE_SQL["forced_phot_isolated"].replace("FROM u GROUP BY", "FROM u WHERE u > 1e-4 GROUP BY")
    return con.sql(sql).df().itertuples()


def test_samples_together_are_those_alone():
    a, best = np.array([[0.5], [2.0], [9.0]]), np.array([[3.0], [-1.0], [700.0]])
    start = best + a**-0.5 * np.random.default_rng(1).normal(size=(3, 10))
    chain = solve.stretch_moves(lambda p: -0.5 * a * (p - best) ** 2, start, 60, seed=3)
    for k in range(3):
        alone, _ = solve.stretch_move(lambda p, k=k: -0.5 * a[k, 0] * (p[0] - best[k, 0]) ** 2, start[k][:, None], 60, seed=3)
        assert chain[:, k].ravel() == pytest.approx(alone[:, 0], abs=1e-12)


@pytest.mark.parametrize("far", [0.0, 80.0 * 6000])
def test_fits_of_far_fields(far):
    """Derivatives don't depend on how far along x a field stands: a fit there ends where it ends in the first field."""
    y, x = (v.ravel().astype(float)[None] for v in np.mgrid[:21, :21])
    true = np.array([[700.0, 9.7, 10.4, 2.0, 5.0]])
    v = true[:, :1] * np.exp(-0.5 * ((x - 9.7) ** 2 + (y - 10.4) ** 2) / 4) / (8 * math.pi) + 5
    got = solve.gaussian_fits(x + far, y, v, np.ones_like(v), np.array([[900.0, 10.5 + far, 10.0, 3.0, 7.0]]))
    assert got - [[0, far, 0, 0, 0]] == pytest.approx(true, abs=1e-5)


def test_fits_of_images_together():
    """One place and flux in three images with skies of their own, one image without pixels in a source."""
    rng = np.random.default_rng(2)
    y, x = (np.tile(v.ravel().astype(float), (2, 3)) for v in np.mgrid[:11, :11])
    img = np.repeat(np.arange(3), 121)[None].repeat(2, axis=0)
    var, sky = 1.0 + img * 0.5, np.array([[3.0, 5.0, 8.0], [1.0, 2.0, 4.0]])
    true = np.array([[500.0, 5.3, 4.8], [800.0, 4.6, 5.5]])
    v = true[:, :1] * np.exp(-0.5 * ((x - true[:, 1:2]) ** 2 + (y - true[:, 2:]) ** 2) / var) / (2 * np.pi * var) + np.take_along_axis(sky, img, 1)
    w = np.where((rng.random(v.shape) < 0.8) & ((img < 2) | (np.arange(2)[:, None] == 0)), 1.0, 0.0)
    got = solve.image_fits(x, y, v, w, var, img, true * [0.8, 1.1, 0.9])
    assert got[:, :3] == pytest.approx(true, abs=1e-4)
    assert got[0, 3:] == pytest.approx(sky[0], abs=1e-4) and got[1, 3:] == pytest.approx([1.0, 2.0, 0.0], abs=1e-4)
