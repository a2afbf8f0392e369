"""Columns of the least-squares problem in the order of the parameters: images first, then sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derivatives as dv
from ..sources.fixtures import fixture, with_fixtures
from .core import query

C = F.col
REACH = 5
#: Point-spread width of every image in pixels, and the steps of the parameters.
WIDTH, STEP = 0.5, {"ra": 1e-3, "dec": 1e-3, "flux": 1.0, "sig": 1e-2, "crval1": 1e-3, "crval2": 1e-3, "psf": 1e-2}

# Each image has a sky-to-pixel matrix of its own: these are the entries of its inverse, in pixels for a unit of the sky.
_CD = "SELECT img, x, y, d, iv, -(0.4e0 + 0.01e0 * img) c11, 0.02e0 * img c12, 0.01e0 * img c21, 0.4e0 + 0.02e0 * img c22 FROM pixels"
_G = "flux{0} * exp(-0.5e0 * ((x - px{0}) * (x - px{0}) + (y - py{0}) * (y - py{0})) / (sig{0} * sig{0} + w{0} * w{0})) / (2e0 * pi() * (sig{0} * sig{0} + w{0} * w{0}))"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with the inverse matrix of their image."""
    p = spark.sql(_CD.replace("FROM pixels", "FROM {p}"), p=fixture(spark, d, "pixels"))
    det = C("c11") * C("c22") - C("c12") * C("c21")
    return p.select("img", "x", "y", "d", "iv", (C("c22") / det).alias("i11"), (-C("c12") / det).alias("i12"), (-C("c21") / det).alias("i21"), (C("c11") / det).alias("i22"))


SOURCE, IMAGE = ("ra", "dec", "flux", "sig"), ("crval1", "crval2", "psf", "sky")


def _base() -> dict[str, Column]:
    return {"px": C("px"), "py": C("py"), "sig": C("sig"), "flux": C("flux"), "w": F.lit(WIDTH)}


def _model(v: dict[str, Column]) -> Column:
    var = v["sig"] * v["sig"] + v["w"] * v["w"]
    dx, dy = C("x") - v["px"], C("y") - v["py"]
    return v["flux"] * F.exp(-0.5 * (dx * dx + dy * dy) / var) / (2 * math.pi * var)


def _moved(name: str, to: int) -> dict[str, Column]:
    """A step along a sky axis, as pixels of the image."""
    return {"px": C("px") + STEP[name] * C(f"i1{to}"), "py": C("py") + STEP[name] * C(f"i2{to}")}


def _of_sources() -> list[dv.Param]:
    changes = [_moved("ra", 1), _moved("dec", 2), {"flux": C("flux") + STEP["flux"]}, {"sig": C("sig") + STEP["sig"]}]
    free = [C("psize") % 4 != 0, C("psize") % 4 != 0, None, C("psize") % 2 == 0]
    return [dv.Param(n, STEP[n], c, f) for n, c, f in zip(SOURCE, changes, free, strict=True)]


def _of_images() -> list[dv.Param]:
    changes = [_moved("crval1", 1), _moved("crval2", 2), {"w": F.lit(WIDTH + STEP["psf"])}]
    return [dv.Param(n, STEP[n], c, f) for n, c, f in zip(IMAGE, changes, [None, None, C("img") % 2 == 1], strict=False)]


def _sql(params: list[tuple[str, dict[str, str]]], free: str) -> str:
    """Joined rows with the stepped quantities of each parameter (its name, and what it changes)."""
    case = {}
    for k, (_, changes) in enumerate(params):
        for c, e in changes.items():
            case.setdefault(c, []).append(f"WHEN {k} THEN {e}")
    after = ", ".join(f"CASE k {' '.join(case[c])} ELSE {c}0 END {c}1" if c in case else f"{c}0 {c}1" for c in ("px", "py", "sig", "flux", "w"))
    step = "CASE k " + " ".join(f"WHEN {k} THEN {STEP[n]!r}::DOUBLE" for k, (n, _) in enumerate(params)) + " END step"
    return f"""{with_fixtures('pixels', 'srcs')}, cd AS ({_CD}), im AS (SELECT *, c22 / (c11 * c22 - c12 * c21) i11, -c12 / (c11 * c22 - c12 * c21) i12, -c21 / (c11 * c22 - c12 * c21) i21, c11 / (c11 * c22 - c12 * c21) i22 FROM cd),
met AS (SELECT s.sid, s.psize, s.px px0, s.py py0, s.sig sig0, s.flux flux0, {WIDTH!r}::DOUBLE w0, im.*, k FROM srcs s JOIN im ON abs(im.x - round_even(s.px, 0)) <= {REACH} * s.sig AND abs(im.y - round_even(s.py, 0)) <= {REACH} * s.sig, range({len(params)}) t(k) WHERE {free}),
ends AS (SELECT *, {after}, {step} FROM met), dm AS (SELECT *, (({_G.format(1)}) - ({_G.format(0)})) / step dm FROM ends)"""


def _move_sql(name: str, to: int) -> dict[str, str]:
    return {"px": f"px0 + {STEP[name]!r}::DOUBLE * i1{to}", "py": f"py0 + {STEP[name]!r}::DOUBLE * i2{to}"}


_SRC = _sql([("ra", _move_sql("ra", 1)), ("dec", _move_sql("dec", 2)), ("flux", {"flux": "flux0 + 1e0"}), ("sig", {"sig": "sig0 + 0.01e0"})], "(k > 1 OR psize % 4 <> 0) AND (k <> 3 OR psize % 2 = 0)")
_IMG = _sql([("crval1", _move_sql("crval1", 1)), ("crval2", _move_sql("crval2", 2)), ("psf", {"w": "0.51e0"})], "k <> 2 OR img % 2 = 1")
_NAMES, _INAMES = (f"{list(names)}[k + 1]" for names in (SOURCE, IMAGE))


@query("source_param_derivs", f"""{_SRC} SELECT sid, k::INT k, {_NAMES} par, img, round(sum(dm * sqrt(iv)), 2) + 0e0 total, round(sqrt(sum(dm * dm * iv)), 2) norm FROM dm WHERE dm <> 0 GROUP BY sid, k, img""")
def source_param_derivs(spark: SparkSession, d: str) -> DataFrame:
    """Sum and norm of the column of each free source parameter in each image: sky position through the image's inverse matrix, flux, size."""
    srcs = fixture(spark, d, "srcs").select("sid", "px", "py", "sig", "flux", "psize")
    rows = dv.of_sources(_images(spark, d), srcs, _of_sources(), _base(), _model, F.ceil(C("sig") * REACH))
    name = F.element_at(F.array(*[F.lit(n) for n in SOURCE]), C("k") + 1)
    sums = rows.groupBy("sid", "k", "img").agg((F.round(F.sum(C("dm") * F.sqrt("iv")), 2) + 0.0).alias("total"), F.round(F.sqrt(F.sum(C("dm") * C("dm") * C("iv"))), 2).alias("norm"))
    return sums.select("sid", "k", name.alias("par"), "img", "total", "norm")


@query("image_param_derivs", f"""{_IMG}, px AS (SELECT img, k, x, y, any_value(iv) iv, sum(dm) dm FROM dm GROUP BY img, k, x, y UNION ALL SELECT img, 3, x, y, iv, 1e0 FROM pixels)
SELECT img, k::INT k, {_INAMES} par, count(*)::BIGINT n, round(sum(dm * sqrt(iv)), 1) + 0e0 total, round(sqrt(sum(dm * dm * iv)), 2) norm FROM px WHERE dm <> 0 GROUP BY img, k""")
def image_param_derivs(spark: SparkSession, d: str) -> DataFrame:
    """The same for the parameters of the images: reference position, point-spread width, sky."""
    srcs, pixels = fixture(spark, d, "srcs").select("sid", "px", "py", "sig", "flux"), _images(spark, d)
    rows = dv.of_images(pixels, srcs, _of_images(), _base(), _model, F.ceil(C("sig") * REACH)).unionByName(dv.sky_of_images(pixels, IMAGE.index("sky")))
    name = F.element_at(F.array(*[F.lit(n) for n in IMAGE]), C("k") + 1)
    sums = rows.groupBy("img", "k").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(C("dm") * F.sqrt("iv")), 1) + 0.0).alias("total"), F.round(F.sqrt(F.sum(C("dm") * C("dm") * C("iv"))), 2).alias("norm"))
    return sums.select("img", "k", name.alias("par"), "n", "total", "norm")
