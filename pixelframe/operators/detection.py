"""Detection of sources under several spectra: blobs without holes, a peak in each, bitmasks, and a list of peaks without repeats.

Masks are tables of pixels, so nothing here walks over a grid: a row of a mask is a list of
runs, the background between two runs of a row is a gap, and a hole is a chain of gaps (each
over or under the next) none of which meets the open background. Rows are cut every 4,096
pixels before they are sorted, so that a long row is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .images import blobs, components, cut, interval_pairs

C = F.col
CHUNK = 4096


def row_runs(mask: DataFrame) -> DataFrame:
    """img, y, x0, x1: maximal runs of pixels in each row, cut at multiples of CHUNK."""
    chunk = F.floor(C("x") / CHUNK)
    px = mask.select("img", "x", "y").distinct().withColumn("c", chunk)
    run = C("x") - F.row_number().over(Window.partitionBy("img", "y", "c").orderBy("x"))
    return px.withColumn("run", run).groupBy("img", "y", "c", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("img", "y", "x0", "x1")


def gaps(runs: DataFrame) -> DataFrame:
    """img, y, g0, g1: background between two runs of a row. The next run is sought in the run's own chunk, then among the first runs of later chunks."""
    at = runs.withColumn("c", F.floor(C("x0") / CHUNK))
    row = Window.partitionBy("img", "y").orderBy("c")
    later = at.groupBy("img", "y", "c").agg(F.min("x0").alias("first")).withColumn("later", F.lead("first").over(row)).drop("first")
    near = at.withColumn("next", F.lead("x0").over(Window.partitionBy("img", "y", "c").orderBy("x0")))
    end = near.join(later, ["img", "y", "c"]).select("img", "y", (C("x1") + 1).alias("g0"), (F.coalesce("next", "later") - 1).alias("g1"))
    return end.where("g1 >= g0")


def holes(mask: DataFrame) -> DataFrame:
    """img, x, y: pixels off the mask from which no chain of neighbours in rows and columns leads out of it."""
    runs = cut(row_runs(mask))
    g = cut(gaps(runs))
    rows = runs.groupBy("img", "y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    out = None
    for dy in (-1, 1):  # a gap that reaches beyond the ends of the row above or below, or an empty row, is open
        beside = rows.select("img", (C("y") - dy).alias("y"), "lo", "hi")
        open_ = g.join(beside, ["img", "y"], "left").where("lo IS NULL OR g0 < lo OR g1 > hi").select("img", "y", "g0")
        out = open_ if out is None else out.union(open_)
    node = F.struct("img", "y", "g0")
    below = g.select("img", (C("y") + 1).alias("y"), C("g0").alias("h0"), C("g1").alias("h1"))
    links = interval_pairs(g, below, ["img", "y"], ("g0", "g1"), ("h0", "h1")).select(node.alias("a"), F.struct("img", (C("y") - 1).alias("y"), C("h0").alias("g0")).alias("b"))
    part = g.select("*", node.alias("node")).join(components(links), "node", "left").withColumn("part", F.coalesce("least", "node"))
    part = cut(part.select("img", "y", "g0", "g1", "part"))
    leaking = part.join(out.distinct(), ["img", "y", "g0"], "left_semi").select("part").distinct()
    closed = part.join(leaking, "part", "left_anti")
    return closed.select("img", F.explode(F.sequence("g0", "g1")).alias("x"), "y")


def filled(mask: DataFrame) -> DataFrame:
    """The mask with its holes."""
    px = mask.select("img", "x", "y").distinct()
    return px.unionByName(holes(px).select("img", C("x").cast(px.schema["x"].dataType).alias("x"), "y"))


def sed_maps(pixels: DataFrame, seds: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """sed (its number), x, y, sn: bands combined under each spectrum. Pixels: band, x, y, d, iv."""
    band = pixels.groupBy("band", "x", "y").agg((F.sum(C("d") * C("iv")) / F.sum("iv")).alias("m"), F.sum("iv").alias("iv"))
    share = lambda fs: F.coalesce(*[F.when(C("band") == b, F.lit(float(f))) for b, f in fs.items()], F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("sed"), share(fs).alias("f")) for k, (_, fs) in enumerate(seds)]))
    rows = band.select("x", "y", "m", "iv", each.alias("s")).where("s.f <> 0")
    return rows.groupBy("s.sed", "x", "y").agg((F.sum(C("s.f") * C("m") * C("iv")) / F.sqrt(F.sum(C("s.f") * C("s.f") * C("iv")))).alias("sn"))


def detections(maps: DataFrame, least: float, radius: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """Peaks and masks of the maps (sed, x, y, sn).

    Pixels above `least` make blobs of eight neighbours, holes filled; a blob's peak is its
    brightest pixel, the first by row, then column, on ties. A spectrum's peaks are new unless a
    peak kept for an earlier spectrum lies within the radius; the list grows spectrum by spectrum.

    peaks: sed, label, x, y, sn, n (pixels of the blob), fresh. masks: x, y, detmask, peakmask,
    with bit k for spectrum k.
    """
    maps = cut(maps)
    hot = maps.where(C("sn") > least).select(C("sed").alias("img"), "x", "y")
    blob = cut(blobs(cut(filled(hot))).withColumnRenamed("img", "sed"))
    size = blob.groupBy("sed", "label").agg(F.count(F.lit(1)).alias("n"))
    lit = blob.join(maps, ["sed", "x", "y"])
    best = lit.groupBy("sed", "label").agg(F.max_by(F.struct("x", "y", "sn"), F.struct("sn", -C("y"), -C("x"))).alias("p"))
    peak = cut(best.join(size, ["sed", "label"]).select("sed", "label", "p.x", "p.y", "p.sn", "n"))
    kept = None
    for sed in sorted(r["sed"] for r in peak.select("sed").distinct().collect()):  # a few spectra
        mine = peak.where(C("sed") == sed).withColumn("id", C("label"))
        if kept is None:
            kept = mine
            continue
        known = kept.select(F.struct("sed", "label").alias("id"), C("x").cast("double").alias("x"), C("y").cast("double").alias("y"))
        near = spatial.plane_pairs(mine.select("id", C("x").cast("double").alias("x"), C("y").cast("double").alias("y")), known, radius).select(C("lid").alias("id")).distinct()
        kept = cut(kept.unionByName(mine.join(near, "id", "left_anti")))
    if kept is None:
        kept = peak.withColumn("id", C("label"))
    peaks = peak.join(kept.select("sed", "label", F.lit(True).alias("fresh")), ["sed", "label"], "left").fillna(False, ["fresh"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), C("sed").cast("int"))
    marked = blob.select("x", "y", bit.alias("det"), F.lit(0).cast("long").alias("top")).unionByName(peak.select("x", "y", F.lit(0).cast("long").alias("det"), bit.alias("top")))
    masks = marked.groupBy("x", "y").agg(F.bit_or("det").alias("detmask"), F.bit_or("top").alias("peakmask"))
    return peaks, masks
