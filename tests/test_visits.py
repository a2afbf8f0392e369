"""Visits fitted as state of a stream: the same rows whatever the number of batches and restarts."""

import datetime as dt

import numpy as np
import pytest

from pixelframe.streaming import lightcurves as lc

BASE = dt.datetime(2024, 3, 1)


def drain(spark, folder, batches):
    for rows in batches:
        df = spark.createDataFrame([(i, s, BASE + dt.timedelta(hours=h) if h is not None else None, "a", v, "") for i, (s, h, v) in enumerate(rows)], lc.EVENTS)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = lc.drained(lc.visit_fits(lc.measurements(spark, f"{folder}/in", "*.parquet"), 6 * 3600, "1 hour"), "visits", folder)
    return sorted((r.src, r.start, r.end, r.n, r.flux, r.slope) for r in out.collect())


def test_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(s), float(h), float(2 + 0.5 * h + rng.normal())) for s, h in zip(rng.integers(1, 6, 200), np.round(np.sort(rng.uniform(0, 240, 200)), 3), strict=True)]
    rows += [(9, 1.0, 5.0), (9, 1.0, 7.0), (9, 3.0, None), (None, 3.0, 1.0), (9, None, 1.0)]
    key = lambda r: r[1] if r[1] is not None else 0.0
    rows.sort(key=key)
    cut = [[r for r in rows if 60 * k <= key(r) < 60 * (k + 1)] for k in range(4)]
    for part in cut:
        rng.shuffle(part)  # any order inside a batch
    many, one = (drain(spark, f"file://{tmp_path}/{n}", b) for n, b in (("many", cut), ("one", [rows])))
    want, mark = [], max(key(r) for r in rows) - 1
    for src in {r[0] for r in rows if r[0]}:
        own, visit = sorted((h, v) for s, h, v in rows if s == src and h is not None and v is not None), []
        for h, v in [*own, (None, None)]:
            if visit and (h is None and visit[-1][0] + 6 < mark or h is not None and h - visit[-1][0] > 6):
                hs, vs = (np.array(c) for c in zip(*visit, strict=True))
                slope = np.polyfit(hs, vs, 1)[0] if hs[-1] > hs[0] else None
                want.append((src, *(BASE + dt.timedelta(hours=float(x)) for x in (hs[0], hs[-1])), len(hs), vs.mean(), slope))
                visit = []
            visit.append((h, v))
    assert len(many) == len(one) == len(want) > 60
    for got in (many, one):
        for g, w in zip(got, sorted(want, key=lambda r: r[:2]), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == (None if w[5] is None else pytest.approx(w[5], abs=1e-6))


def test_sources_share_a_state(spark, tmp_path):
    """Neighbouring sources are one group and one state; visits of the same block end by gaps, by timers, and not at all."""
    folder = f"file://{tmp_path}/block"
    rows = [(s, h, float(s)) for s in range(100) for h in (0.0, 1.0)] + [(s, 100.0, 0.0) for s in range(50)] + [(3, 98.0, 1.0)]
    got = drain(spark, folder, [rows[:200], rows[200:]])
    assert [r[0] for r in got] == list(range(100))
    assert all(r[2:5] == (BASE + dt.timedelta(hours=1), 2, float(r[0])) for r in got)
    assert spark.read.format("statestore").load(f"{folder}/visits-mark").count() == 1  # 64 sources a block; all of the second one's visits have ended
