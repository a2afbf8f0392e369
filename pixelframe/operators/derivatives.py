"""Derivatives of the model with respect to every free parameter, by one render join.

A parameter is a step of some of the quantities that the model reads: a table of sources is
exploded into one row for each of its free parameters, meets the pixels once, and each joined
row evaluates the model at both ends of the step. Quantities of an image (its sky-to-pixel
matrix, its point-spread width) are columns of the pixels, so a step in sky coordinates moves
a source by the inverse matrix of the image it is seen in, and a parameter of an image is a
step of all sources in it, added up at each pixel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import render

C = F.col
Model = Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Param:
    """A step of a parameter: what the quantities it touches become, and where it is free (a condition on the source, or on the image for an image's parameter)."""

    name: str
    step: float
    changes: dict[str, Column]
    free: Column | None = None


def _differences(met: DataFrame, params: list[Param], base: dict[str, Column], model: Model) -> Column:
    """Change of the model for one unit of the parameter whose number is in column k."""
    after = {}
    for name, value in base.items():
        case = None
        for k, p in enumerate(params):
            if name in p.changes:
                case = F.when(C("k") == k, p.changes[name]) if case is None else case.when(C("k") == k, p.changes[name])
        after[name] = value if case is None else case.otherwise(value)
    step = F.element_at(F.array(*[F.lit(p.step) for p in params]), C("k") + 1)
    return (model(after) - model(base)) / step


def _free(params: list[Param]) -> Column:
    """Numbers of the free parameters, in order."""
    return F.filter(F.array(*[F.when(p.free if p.free is not None else F.lit(True), F.lit(k)) for k, p in enumerate(params)]), lambda k: k.isNotNull())


def of_sources(pixels: DataFrame, sources: DataFrame, params: list[Param], base: dict[str, Column], model: Model, half: Column) -> DataFrame:
    """sid, k, img, x, y, iv, dm for each free parameter of each source at each pixel of the source's box where it changes the model."""
    boxes = render.boxed(sources.withColumn("k", F.explode(_free(params))), half)
    met = render.render_join(pixels, boxes)
    return met.withColumn("dm", _differences(met, params, base, model)).where("dm <> 0").select("sid", "k", "img", "x", "y", "iv", "dm")


def of_images(pixels: DataFrame, sources: DataFrame, params: list[Param], base: dict[str, Column], model: Model, half: Column) -> DataFrame:
    """img, k, x, y, iv, dm for each free parameter of each image: the changes of all sources, added up at each pixel before anything is joined to them."""
    met = render.render_join(pixels, render.boxed(sources, half)).withColumn("k", F.explode(_free(params)))
    return met.withColumn("dm", _differences(met, params, base, model)).groupBy("img", "k", "x", "y").agg(F.first("iv").alias("iv"), F.sum("dm").alias("dm")).where("dm <> 0")


def sky_of_images(pixels: DataFrame, k: int) -> DataFrame:
    """The same rows for the sky level: one at every pixel."""
    return pixels.select("img", F.lit(k).alias("k"), "x", "y", "iv", F.lit(1.0).alias("dm"))
