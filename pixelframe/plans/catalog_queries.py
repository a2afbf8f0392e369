"""Catalogue queries: scans, cuts, conversions, aggregates, windows and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import units as u
from ..sources.fixtures import SQL, fixture, read, with_fixtures
from .core import query

C = F.col


def _n(x):
    return F.count(F.lit(1)).alias(x)


# --- fixtures as queries ------------------------------------------------------------------


@query("pixels_fixture", SQL["pixels"])
def pixels_fixture(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "pixels")


@query("sources_fixture", SQL["srcs"])
def sources_fixture(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "srcs")


# --- scans and sinks -----------------------------------------------------------------------


@query("scan_rename", "SELECT p_partkey AS id, p_retailprice AS mag, p_brand AS band FROM part WHERE p_size > 25")
def scan_rename(spark: SparkSession, d: str) -> DataFrame:
    """Column list and rename map; the scan reads four columns and gets the filter."""
    return read(spark, d, "part").where("p_size > 25").select(C("p_partkey").alias("id"), C("p_retailprice").alias("mag"), C("p_brand").alias("band"))


@query("scan_two_phase", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3 AND o_totalprice > 100000e0)")
def scan_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """Keys first, the other columns for the chosen rows: a semi join on the row id."""
    o = read(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice").join(o.where("o_custkey % 7 = 3 AND o_totalprice > 100000e0").select("o_orderkey"), "o_orderkey", "left_semi")


@query("scan_dec_zones", f"{with_fixtures('cat1')} SELECT id, ra, dec, CAST(floor((dec + 90e0) / 3.6e0) AS INT) zone FROM cat1 WHERE dec >= -10e0 AND dec < 5e0")
def scan_dec_zones(spark: SparkSession, d: str) -> DataFrame:
    """Fifty declination zones; only the zones that overlap the range are kept before the exact cut."""
    cat = fixture(spark, d, "cat1").withColumn("zone", F.floor((C("dec") + 90.0) / 3.6).cast("int"))
    lo, hi = math.floor(80 / 3.6), math.floor(95 / 3.6)
    return cat.where(C("zone").between(lo, hi) & (C("dec") >= -10) & (C("dec") < 5)).select("id", "ra", "dec", "zone")


@query("image_roi", f"{with_fixtures('pixels')} SELECT img, x - 10 AS x, y - 5 AS y, d, iv FROM pixels WHERE x >= 10 AND x < 20 AND y >= 5 AND y < 25")
def image_roi(spark: SparkSession, d: str) -> DataFrame:
    """Sub-image with shifted coordinates (half-open box)."""
    return fixture(spark, d, "pixels").where("x >= 10 AND x < 20 AND y >= 5 AND y < 25").withColumns({"x": C("x") - 10, "y": C("y") - 5})


@query("image_with_maps", f"""{with_fixtures('pixels')}, e AS (SELECT img, x, y, count(*) n FROM (SELECT CAST(l_linenumber AS INT) img, CAST(l_partkey % 40 AS INT) x, CAST(l_suppkey % 40 AS INT) y FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2, 3)
SELECT p.img, p.x, p.y, d, CASE WHEN coalesce(n, 0) > 2 THEN 0e0 ELSE iv END iv, coalesce(n, 0)::BIGINT nmask FROM pixels p LEFT JOIN e USING (img, x, y)""")
def image_with_maps(spark: SparkSession, d: str) -> DataFrame:
    """Image joined with an ancillary map; flagged pixels get inverse variance zero."""
    e = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(C("l_linenumber").cast("int").alias("img"), (C("l_partkey") % 40).cast("int").alias("x"), (C("l_suppkey") % 40).cast("int").alias("y")).agg(_n("n"))
    p = fixture(spark, d, "pixels").join(e, ["img", "x", "y"], "left").withColumn("nmask", F.coalesce("n", F.lit(0).cast("long")))
    return p.select("img", "x", "y", "d", F.when(C("nmask") > 2, 0.0).otherwise(C("iv")).alias("iv"), "nmask")


@query("wide_to_arrays", "SELECT p_partkey AS id, p_retailprice AS f0, p_retailprice + p_size AS f1, p_retailprice * 2e0 AS f2, 3::INT AS n FROM part")
def wide_to_arrays(spark: SparkSession, d: str) -> DataFrame:
    """One column a band into an array a row, and back by position."""
    f = F.array(C("p_retailprice"), C("p_retailprice") + C("p_size"), C("p_retailprice") * 2.0)
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), f.alias("f"))
    return p.select("id", *[C("f")[k].alias(f"f{k}") for k in range(3)], F.size("f").alias("n"))


@query("calibration_json", "SELECT p_partkey AS id, 'mag' AS kind, p_retailprice AS scale, CAST(20 + p_size AS DOUBLE) AS zp FROM part")
def calibration_json(spark: SparkSession, d: str) -> DataFrame:
    """Calibration structs to JSON and back."""
    cal = F.to_json(F.struct(F.lit("mag").alias("kind"), C("p_retailprice").alias("scale"), (C("p_size") + 20).cast("double").alias("zp")))
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), F.from_json(cal, "kind string, scale double, zp double").alias("c"))
    return p.select("id", "c.*")


@query("sql_flag_into", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderkey & 17) = 0 AND o_totalprice > 150000e0")
def sql_flag_into(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE (o_orderkey & 17) = 0 AND o_totalprice > 150000e0", o=read(spark, d, "orders"))


_EQUI = "SELECT c.c_custkey AS id, n.n_name AS name, c.c_acctbal AS bal FROM {c} c JOIN {n} n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2"


@query("sql_equijoin", _EQUI.format(c="customer", n="nation"))
def sql_equijoin(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_EQUI, c=read(spark, d, "customer"), n=read(spark, d, "nation"))


@query("sql_bit_columns", "SELECT o_orderkey, CASE WHEN (o_orderkey & 1) <> 0 THEN 1 ELSE 0 END::INT b0, CASE WHEN (o_orderkey & 4) <> 0 THEN 1 ELSE 0 END::INT b2, CASE WHEN (o_orderkey & 64) <> 0 THEN 1 ELSE 0 END::INT b6 FROM orders")
def sql_bit_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey, IF((o_orderkey & 1) <> 0, 1, 0) b0, IF((o_orderkey & 4) <> 0, 1, 0) b2, IF((o_orderkey & 64) <> 0, 1, 0) b6 FROM {o}", o=read(spark, d, "orders"))


@query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sql_order_limit(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", o=read(spark, d, "orders"))


# --- cuts -----------------------------------------------------------------------------------


@query("flag_filter", "SELECT o_orderkey, (o_orderkey % 256)::BIGINT flags FROM orders WHERE ((o_orderkey % 256) & 145) = 0 AND ((o_orderkey % 256) & 2) <> 0")
def flag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Or-ed mask of bad bits must be clear, one required bit set."""
    bad = 1 | 16 | 128
    o = read(spark, d, "orders").select("o_orderkey", (C("o_orderkey") % 256).alias("flags"))
    return o.where((C("flags").bitwiseAND(bad) == 0) & (C("flags").bitwiseAND(2) != 0))


@query("flag_chain", """SELECT bit::INT bit, count(*)::BIGINT n FROM (SELECT o_orderkey % 256 f FROM orders) , (SELECT unnest([1, 2, 4, 8]) bit)
WHERE (f & (bit - 1)) = 0 AND (f & bit) <> 0 GROUP BY bit""")
def flag_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rejections one bit after another: rows that each bit removes from those still left."""
    f = read(spark, d, "orders").select((C("o_orderkey") % 256).alias("f"))
    first = F.when(C("f").bitwiseAND(1) != 0, 1).when(C("f").bitwiseAND(2) != 0, 2).when(C("f").bitwiseAND(4) != 0, 4).when(C("f").bitwiseAND(8) != 0, 8)
    return f.select(first.alias("bit")).where("bit IS NOT NULL").groupBy("bit").agg(_n("n"))


@query("box_cut", f"{with_fixtures('cat1')} SELECT id, ra, dec FROM cat1 WHERE ra BETWEEN 100e0 AND 150e0 AND dec BETWEEN -20e0 AND 20e0")
def box_cut(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").where("ra BETWEEN 100e0 AND 150e0 AND dec BETWEEN -20e0 AND 20e0").select("id", "ra", "dec")


@query("ra_wrap_cut", f"""{with_fixtures('cat1')}, t AS (SELECT * FROM cat1 WHERE ra < 12e0 OR ra > 350e0),
m AS (SELECT avg(cos(radians(ra))) c, avg(sin(radians(ra))) s FROM t), k AS (SELECT ra, c * sin(radians(ra)) - s * cos(radians(ra)) k FROM t, m)
SELECT min_by(ra, k) ra_lo, max_by(ra, k) ra_hi, count(*)::BIGINT n, round(degrees(atan2(any_value(s), any_value(c))), 6) + 0e0 mid FROM k, m""")
def ra_wrap_cut(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest right ascension of a group across zero, by the sine of the angle from its mean direction."""
    t = fixture(spark, d, "cat1").where("ra < 12e0 OR ra > 350e0").select("ra")
    m = t.agg(F.avg(F.cos(F.radians("ra"))).alias("c"), F.avg(F.sin(F.radians("ra"))).alias("s"))
    k = t.crossJoin(F.broadcast(m)).withColumn("k", C("c") * F.sin(F.radians("ra")) - C("s") * F.cos(F.radians("ra")))  # m has one row
    return k.agg(F.min_by("ra", "k").alias("ra_lo"), F.max_by("ra", "k").alias("ra_hi"), _n("n"), (F.round(F.degrees(F.atan2(F.first("s"), F.first("c"))), 6) + 0.0).alias("mid"))


@query("roi_clip", f"""{with_fixtures('srcs')}, b AS (SELECT sid, floor(px / 80e0)::BIGINT field, greatest(0e0, round_even(px % 80e0, 0) - 4e0) x0, least(40e0, round_even(px % 80e0, 0) + 5e0) x1, greatest(0e0, round_even(py, 0) - 4e0) y0, least(40e0, round_even(py, 0) + 5e0) y1 FROM srcs)
SELECT sid, field, x0::INT x0, x1::INT x1, y0::INT y0, y1::INT y1, (x0 >= x1 OR y0 >= y1) empty FROM b""")
def roi_clip(spark: SparkSession, d: str) -> DataFrame:
    """Boxes cut at the edges of their field, in its own pixels."""
    x0, x1, y0, y1, e = g.clip_roi(C("px") % 80.0, C("py"), F.lit(4.0), F.lit(40.0), F.lit(40.0))
    return fixture(spark, d, "srcs").select("sid", F.floor(C("px") / 80.0).alias("field"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), e.alias("empty"))


_POLY = [(90.0, -30.0), (200.0, -40.0), (240.0, 10.0), (170.0, 45.0), (150.0, 0.0), (100.0, 35.0)]
_CROSS = " + ".join(f"CASE WHEN (({y1}e0 > dec) <> ({y2}e0 > dec)) AND ra < {x2 - x1}e0 * (dec - {y1}e0) / {y2 - y1}e0 + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_POLY, _POLY[1:] + _POLY[:1], strict=True))


@query("point_in_polygon", f"{with_fixtures('cat1')} SELECT id FROM cat1 WHERE ({_CROSS}) % 2 = 1".replace("e0e0", "e0"))
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box first, then crossings."""
    xs, ys = [p[0] for p in _POLY], [p[1] for p in _POLY]
    cat = fixture(spark, d, "cat1").where(C("ra").between(min(xs), max(xs)) & C("dec").between(min(ys), max(ys)))
    return cat.where(g.in_polygon(C("ra"), C("dec"), _POLY)).select("id")


@query("in_image_margin", f"""{with_fixtures('srcs')} SELECT sid, field, (px >= -0.5e0 AND px < 29.5e0 AND py >= -0.5e0 AND py < 29.5e0) inside FROM (SELECT sid, floor(px / 80e0)::BIGINT field, px % 80e0 px, py FROM srcs) WHERE px >= -3e0 AND px < 33e0 AND py >= -3e0 AND py < 33e0""")
def in_image_margin(spark: SparkSession, d: str) -> DataFrame:
    """Inside an image of 30 x 30 pixels, the corner of each field, with a margin of three pixels, and strictly inside."""
    s = fixture(spark, d, "srcs").select("sid", F.floor(C("px") / 80.0).alias("field"), (C("px") % 80.0).alias("px"), "py").where("px >= -3e0 AND px < 33e0 AND py >= -3e0 AND py < 33e0")
    return s.select("sid", "field", ((C("px") >= -0.5) & (C("px") < 29.5) & (C("py") >= -0.5) & (C("py") < 29.5)).alias("inside"))


@query("classify_sources", """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'star' WHEN p_size % 11 = 0 THEN 'exp' WHEN p_size % 11 = 10 THEN 'dev' ELSE 'comp' END AS kind, CAST(p_size % 11 AS DOUBLE) / 10e0 AS fracdev FROM part""")
def classify_sources(spark: SparkSession, d: str) -> DataFrame:
    """Star by probability, else by the de Vaucouleurs fraction: 0 exponential, 1 de Vaucouleurs, between composite."""
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), (C("p_size") % 5 == 0).alias("star"), ((C("p_size") % 11).cast("double") / 10.0).alias("fracdev"))
    kind = F.when(C("star"), "star").when(C("fracdev") == 0, "exp").when(C("fracdev") == 1, "dev").otherwise("comp")
    return p.select("id", kind.alias("kind"), "fracdev")


_CODES = {"STANDARD": "PTSRC", "PROMO": "E", "ECONOMY": "DEV", "MEDIUM": "D", "SMALL": "COMP", "LARGE": "C"}


@query("source_types", """WITH t AS (SELECT p_partkey AS id, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'PTSRC' WHEN 'PROMO' THEN 'E' WHEN 'ECONOMY' THEN 'DEV' WHEN 'MEDIUM' THEN 'D' WHEN 'SMALL' THEN 'COMP' WHEN 'LARGE' THEN 'C' ELSE 'S' END code FROM part)
SELECT id, code, CASE WHEN code IN ('PTSRC', 'STAR', 'S') THEN 'point' WHEN code IN ('EXP', 'E') THEN 'exp' WHEN code IN ('DEV', 'D') THEN 'dev' WHEN code IN ('COMP', 'C') THEN 'comp' END kind FROM t""")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    """Type codes to kinds; an unknown code is an error."""
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])[F.split_part(C("p_type"), F.lit(" "), F.lit(1))], F.lit("S"))
    kind = F.when(C("code").isin("PTSRC", "STAR", "S"), "point").when(C("code").isin("EXP", "E"), "exp").when(C("code").isin("DEV", "D"), "dev").when(C("code").isin("COMP", "C"), "comp")
    return read(spark, d, "part").select(C("p_partkey").alias("id"), code.alias("code")).withColumn("kind", kind.otherwise(F.raise_error(F.concat(F.lit("unknown type "), C("code")))))


@query("se_model_sources", """WITH t AS (SELECT p_partkey id, CAST(p_size % 9 AS DOUBLE) cp, CAST(p_size % 7 AS DOUBLE) cm, 18e0 + p_size % 8 mp, 18e0 + p_size % 10 md, 18e0 + (p_partkey % 10) ms FROM part),
k AS (SELECT *, CASE WHEN cp < cm AND mp <= 25e0 THEN 'psf' WHEN md > 25e0 AND ms > 25e0 THEN NULL WHEN md > 25e0 THEN 'dev' WHEN ms > 25e0 THEN 'exp' ELSE 'comp' END kind FROM t)
SELECT id, kind, round(CASE kind WHEN 'psf' THEN pow(10e0, (mp - 22.5e0) / -2.5e0) WHEN 'dev' THEN pow(10e0, (ms - 22.5e0) / -2.5e0) WHEN 'exp' THEN pow(10e0, (md - 22.5e0) / -2.5e0) ELSE pow(10e0, (ms - 22.5e0) / -2.5e0) + pow(10e0, (md - 22.5e0) / -2.5e0) END, 6) flux FROM k WHERE kind IS NOT NULL""")
def se_model_sources(spark: SparkSession, d: str) -> DataFrame:
    """Model-fit catalogue to sources: point source where its chi-squared is smaller, else disk, spheroid or both by magnitude limit."""
    lim = 25.0
    p = read(spark, d, "part")
    t = p.select(C("p_partkey").alias("id"), (C("p_size") % 9).cast("double").alias("cp"), (C("p_size") % 7).cast("double").alias("cm"), (18.0 + C("p_size") % 8).alias("mp"), (18.0 + C("p_size") % 10).alias("md"), (18.0 + C("p_partkey") % 10).alias("ms"))
    kind = F.when((C("cp") < C("cm")) & (C("mp") <= lim), "psf").when((C("md") > lim) & (C("ms") > lim), None).when(C("md") > lim, "dev").when(C("ms") > lim, "exp").otherwise("comp")
    nm = u.mag_to_nanomaggies
    flux = F.when(C("kind") == "psf", nm(C("mp"))).when(C("kind") == "dev", nm(C("ms"))).when(C("kind") == "exp", nm(C("md"))).otherwise(nm(C("ms")) + nm(C("md")))
    return t.withColumn("kind", kind).where("kind IS NOT NULL").select("id", "kind", F.round(flux, 6).alias("flux"))


@query("color_cut", """WITH t AS (SELECT p_partkey id, 15e0 + p_size / 10e0 g, 14e0 + (p_partkey % 37) / 10e0 r, 13e0 + (p_partkey % 53) / 10e0 z FROM part)
SELECT id, round(g - r, 6) gr, round(r - z, 6) rz, round((g + 0.8e0 * r + 0.5e0 * z) / 2.3e0, 6) wmag FROM t WHERE r < 17.2e0 AND g - r < 1.3e0 AND r - z > -0.3e0 AND r - z < 3e0 AND g - r < r - z + 2e0""")
def color_cut(spark: SparkSession, d: str) -> DataFrame:
    """Colours, a weighted magnitude, and five conjuncts with a colour-colour line."""
    t = read(spark, d, "part").select(C("p_partkey").alias("id"), (15.0 + C("p_size") / 10.0).alias("g"), (14.0 + (C("p_partkey") % 37) / 10.0).alias("r"), (13.0 + (C("p_partkey") % 53) / 10.0).alias("z"))
    cut = "r < 17.2e0 AND g - r < 1.3e0 AND r - z > -0.3e0 AND r - z < 3e0 AND g - r < r - z + 2e0"
    return t.where(cut).select("id", F.round(C("g") - C("r"), 6).alias("gr"), F.round(C("r") - C("z"), 6).alias("rz"), F.round((C("g") + 0.8 * C("r") + 0.5 * C("z")) / 2.3, 6).alias("wmag"))


@query("rename_drop", "SELECT s_suppkey AS id, s_acctbal AS flux FROM supplier")
def rename_drop(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "flux"}).drop("s_name", "s_nationkey")


@query("array_unpack", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0e0 re, round(embedding[2]::DOUBLE, 6) + 0e0 e1, round(embedding[3]::DOUBLE, 6) + 0e0 e2 FROM embeddings")
def array_unpack(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select("vec_id", *[(F.round(C("embedding")[k].cast("double"), 6) + 0.0).alias(n) for k, n in enumerate(("re", "e1", "e2"))])


@query("brick_primary", f"{with_fixtures('cat1')} SELECT id, floor(ra / 10e0)::BIGINT bx, floor((dec + 60e0) / 10e0)::BIGINT by_, (ra >= 10e0 * floor(ra / 10e0 + 0.05e0) AND ra < 10e0 * floor(ra / 10e0 + 0.05e0) + 10e0) is_primary FROM cat1")
def brick_primary(spark: SparkSession, d: str) -> DataFrame:
    """Half-open ownership of a box: the candidate brick comes from a padded position, the owner test from the exact one."""
    cand = F.floor(C("ra") / 10.0 + 0.05)
    return fixture(spark, d, "cat1").select("id", F.floor(C("ra") / 10.0).alias("bx"), F.floor((C("dec") + 60.0) / 10.0).alias("by_"), ((C("ra") >= 10.0 * cand) & (C("ra") < 10.0 * cand + 10.0)).alias("is_primary"))


@query("edge_cut", f"{with_fixtures('srcs')} SELECT sid FROM srcs WHERE px % 80e0 > 5e0 AND px % 80e0 < 35e0 AND py > 5e0 AND py < 35e0")
def edge_cut(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "srcs").where("px % 80e0 > 5e0 AND px % 80e0 < 35e0 AND py > 5e0 AND py < 35e0").select("sid")


@query("drop_empty_images", f"{with_fixtures('pixels')}, g AS (SELECT img, count(*) FILTER (d >= 90e0) n FROM pixels GROUP BY img) SELECT img, x, y, d FROM pixels WHERE img IN (SELECT img FROM g WHERE n >= 40) AND d >= 90e0")
def drop_empty_images(spark: SparkSession, d: str) -> DataFrame:
    """Images with fewer valid pixels than parameters are dropped by a semi join."""
    p = fixture(spark, d, "pixels").where("d >= 90e0")
    return p.join(p.groupBy("img").agg(_n("n")).where("n >= 40"), "img", "left_semi").select("img", "x", "y", "d")


# --- conversions ----------------------------------------------------------------------------


@query("mag_conversion", """SELECT p_partkey id, round(pow(10e0, (p_size / 2e0 - 22.5e0) / -2.5e0), 3) nm, round(-2.5e0 * (log10(p_retailprice) - 9e0), 6) mag FROM part""")
def mag_conversion(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(C("p_partkey").alias("id"), F.round(u.mag_to_nanomaggies(C("p_size") / 2.0), 3).alias("nm"), F.round(u.nanomaggies_to_mag(C("p_retailprice")), 6).alias("mag"))


@query("mag_errors", """SELECT c_custkey id, CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN round(-2.5e0 * (log10(CASE WHEN c_acctbal > 0 THEN c_acctbal END) - 9e0), 6) ELSE 'nan'::DOUBLE END mag,
CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN round(2.5e0 / ln(10e0) / (sqrt(c_nationkey) * c_acctbal), 8) ELSE 'nan'::DOUBLE END err FROM customer""")
def mag_errors(spark: SparkSession, d: str) -> DataFrame:
    m, e = u.mag_and_error(C("c_acctbal"), C("c_nationkey").cast("double"))
    return read(spark, d, "customer").select(C("c_custkey").alias("id"), F.when(F.isnan(m), m).otherwise(F.round(m, 6)).alias("mag"), F.when(F.isnan(e), e).otherwise(F.round(e, 8)).alias("err"))


@query("zeropoint_scale", "SELECT p_partkey id, round(pow(10e0, (p_size - 22.5e0) / 2.5e0), 6) scale, round(22.5e0 + 2.5e0 * log10(p_retailprice), 6) zp FROM part WHERE p_size < 40")
def zeropoint_scale(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where("p_size < 40").select(C("p_partkey").alias("id"), F.round(u.zeropoint_to_scale(C("p_size").cast("double")), 6).alias("scale"), F.round(u.scale_to_zeropoint(C("p_retailprice")), 6).alias("zp"))


@query("mag_sums", "SELECT p_partkey id, round(-2.5e0 * log10(pow(10e0, (p_size / 2e0) / -2.5e0) + pow(10e0, (p_partkey % 20) / -2.5e0)), 6) + 0e0 both_, round(p_size - 2.5e0 * log10(abs(p_partkey - 3e0) + 1e0), 6) + 0e0 scaled FROM part")
def mag_sums(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(C("p_partkey").alias("id"), F.round(u.add_mags(C("p_size") / 2.0, (C("p_partkey") % 20).cast("double")), 6).__add__(0.0).alias("both_"), F.round(u.scale_mag(C("p_size").cast("double"), F.abs(C("p_partkey") - 3.0) + 1.0), 6).__add__(0.0).alias("scaled"))


@query("photocal_counts", """WITH t AS (SELECT p_partkey id, CASE p_partkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'linear' WHEN 2 THEN 'mag' WHEN 3 THEN 'cfht' ELSE 'sdss' END kind, CAST(p_size + 10 AS DOUBLE) v FROM part)
SELECT id, kind, round(CASE WHEN kind = 'null' THEN v WHEN kind = 'linear' THEN v * 2.5e0 WHEN v > 50e0 THEN 0e0 WHEN kind = 'mag' THEN pow(10e0, 0.4e0 * (25e0 - v)) WHEN kind = 'cfht' THEN 30e0 * pow(10e0, (v - 25e0 - 0.1e0 * (1.2e0 - 1e0)) / -2.5e0) ELSE pow(10e0, -0.4e0 * v + log10(30e0) - 0.4e0 * (25e0 + 0.1e0 * 1.2e0)) END, 6) n FROM t""")
def photocal_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a brightness under five kinds of calibration."""
    kinds = F.array(*[F.lit(k) for k in ("null", "linear", "mag", "cfht", "sdss")])
    t = read(spark, d, "part").select(C("p_partkey").alias("id"), F.get(kinds, (C("p_partkey") % 5).cast("int")).alias("kind"), (C("p_size") + 10).cast("double").alias("v"))
    n = u.counts(C("kind"), C("v"), F.lit(2.5), F.lit(25.0), F.lit(30.0), F.lit(0.1), F.lit(1.2))
    return t.select("id", "kind", F.round(n, 6).alias("n"))


_TAI = "(epoch(o_orderdate) / 86400e0 + 40587e0) * 86400e0"


@query("tai_time", f"""WITH t AS (SELECT o_orderkey id, {_TAI} tai FROM orders), m AS (SELECT id, tai / 86400e0 mjd FROM t)
SELECT id, round(mjd, 6) mjd, round(2000e0 + (mjd - 51544e0) / 365.25e0, 6) "year", round(2e0 * pi() * ((mjd - 53084.28e0) / 365.25e0 - floor((mjd - 53084.28e0) / 365.25e0)), 6) sun FROM m""")
def tai_time(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since MJD 0 as day, calendar year and sun angle."""
    tai = (F.unix_micros(C("o_orderdate").cast("timestamp")) / 1e6 / 86400.0 + 40587.0) * 86400.0
    o = read(spark, d, "orders").select(C("o_orderkey").alias("id"), tai.alias("tai"))
    return o.select("id", F.round(u.tai_to_mjd(C("tai")), 6).alias("mjd"), F.round(u.tai_to_year(C("tai")), 6).alias("year"), F.round(u.sun_angle(C("tai")), 6).alias("sun"))


@query("unit_vectors", f"""{with_fixtures('cat1')}, v AS (SELECT id, cos(radians(dec)) * cos(radians(ra)) x, cos(radians(dec)) * sin(radians(ra)) y, sin(radians(dec)) z FROM cat1)
SELECT id, round(x, 8) + 0e0 x, round(y, 8) + 0e0 y, round(z, 8) + 0e0 z, round(degrees(2e0 * asin(least(1e0, sqrt(x * x + (y - 1e0) * (y - 1e0) + z * z) / 2e0))), 6) sep FROM v""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = g.unit_vector(C("ra"), C("dec"))
    r = lambda c: F.round(c, 8) + 0.0
    return fixture(spark, d, "cat1").select("id", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"), F.round(g.degrees_between(C("ra"), C("dec"), F.lit(90.0), F.lit(0.0)), 6).alias("sep"))


@query("proper_motion", f"""{with_fixtures('cat1')}, p AS (SELECT id, radians(ra + 3.5e0 * val / 1e6) r, radians(dec + 3.5e0 * 0.001e0) d, 0.5e0 / (180e0 * 3600e0 / pi()) s FROM cat1),
v AS (SELECT id, cos(d) * cos(r) + s * cos(1.1e0) x, cos(d) * sin(r) + s * sin(1.1e0) * cos(radians(23.44e0)) y, sin(d) + s * sin(1.1e0) * sin(radians(23.44e0)) z FROM p),
a AS (SELECT id, degrees(atan2(y, x)) ra, degrees(asin(z / sqrt(x * x + y * y + z * z))) dec FROM v)
SELECT id, round(CASE WHEN ra < 0 THEN ra + 360e0 ELSE ra END, 7) ra, round(dec, 7) + 0e0 dec FROM a""")
def proper_motion(spark: SparkSession, d: str) -> DataFrame:
    """Positions 3.5 years on, with proper motion and a parallax of half an arcsecond."""
    ra, dec = g.position_at(C("ra"), C("dec"), C("val") / 1e6, F.lit(0.001), F.lit(0.5), F.lit(3.5), F.lit(1.1))
    return fixture(spark, d, "cat1").select("id", F.round(ra, 7).alias("ra"), (F.round(dec, 7) + 0.0).alias("dec"))


_WCS = {"crval1": 150.0, "crval2": 2.0, "crpix1": 512.5, "crpix2": 512.5, "cd11": -0.01, "cd12": 0.001, "cd21": 0.001, "cd22": 0.01}


@query("tan_wcs", f"""{with_fixtures('cat1')}, p AS (SELECT id, ra, dec, sin(radians(2e0)) * sin(radians(dec)) + cos(radians(2e0)) * cos(radians(dec)) * cos(radians(ra - 150e0)) c FROM cat1),
q AS (SELECT id, ra, dec, degrees(cos(radians(dec)) * sin(radians(ra - 150e0)) / c) xi, degrees((cos(radians(2e0)) * sin(radians(dec)) - sin(radians(2e0)) * cos(radians(dec)) * cos(radians(ra - 150e0))) / c) eta FROM p WHERE c > 0.9e0)
SELECT id, round((0.01e0 * xi - 0.001e0 * eta) / (-0.01e0 * 0.01e0 - 0.001e0 * 0.001e0) + 511.5e0, 5) px, round((-0.01e0 * eta - 0.001e0 * xi) / (-0.01e0 * 0.01e0 - 0.001e0 * 0.001e0) + 511.5e0, 5) py, round(ra, 6) ra2, round(dec, 6) + 0e0 dec2, round(3600e0 * sqrt(abs(-0.01e0 * 0.01e0 - 0.001e0 * 0.001e0)), 6) scale FROM q""")
def tan_wcs(spark: SparkSession, d: str) -> DataFrame:
    """Sky to pixel and back through a tangent plane, and the pixel scale."""
    w = {k: F.lit(v) for k, v in _WCS.items()}
    _, _, front = g.tan_project(C("ra"), C("dec"), w["crval1"], w["crval2"])
    near = F.sin(F.radians(w["crval2"])) * F.sin(F.radians("dec")) + F.cos(F.radians(w["crval2"])) * F.cos(F.radians("dec")) * F.cos(F.radians(C("ra") - w["crval1"])) > 0.9
    px, py = g.sky_to_pixel(C("ra"), C("dec"), w)
    s = fixture(spark, d, "cat1").where(front & near).select("id", px.alias("px"), py.alias("py"))
    ra, dec = g.pixel_to_sky(C("px"), C("py"), w)
    return s.select("id", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"), F.round(ra, 6).alias("ra2"), (F.round(dec, 6) + 0.0).alias("dec2"), F.round(g.pixel_scale(w), 6).alias("scale"))


_POLYC = [1e-4, 2e-4, -1e-4, 1e-6, -2e-6, 3e-6, 1e-6]


@query("polynomial_warp", f"""{with_fixtures('srcs')}, t AS (SELECT sid, 0.5e0 * (px - 20e0) x, 0.25e0 * (py - 20e0) y FROM srcs)
SELECT sid, round(x * 0.9e0 + y * 0.1e0 + x * x * 1e-4 + x * y * 2e-4 + y * y * -1e-4 + x * x * x * 1e-6 + x * x * y * -2e-6 + x * y * y * 3e-6 + y * y * y * 1e-6, 7) + 0e0 l FROM t""")
def polynomial_warp(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to plane coordinates with second and third order terms."""
    t = fixture(spark, d, "srcs").select("sid", (0.5 * (C("px") - 20.0)).alias("x"), (0.25 * (C("py") - 20.0)).alias("y"))
    return t.select("sid", (F.round(C("x") * 0.9 + C("y") * 0.1 + g.polynomial_warp(C("x"), C("y"), _POLYC), 7) + 0.0).alias("l"))


_ELL = "SELECT p_partkey id, p_size / 10e0 re, ((p_partkey % 17) - 8) / 20e0 e1, ((p_partkey % 13) - 6) / 20e0 e2 FROM part"


@query("ellipse_convert", f"""WITH t AS ({_ELL}), h AS (SELECT *, sqrt(e1 * e1 + e2 * e2) e FROM t), b AS (SELECT *, (1e0 - e) / (1e0 + e) ba, atan2(e2, e1) / 2e0 th, re / 3600e0 s FROM h)
SELECT id, round(ba, 8) ab, round(degrees(th), 6) + 0e0 phi, round(ln(re), 8) + 0e0 logre, round(CASE WHEN e > 0 THEN e1 * -ln(1e0 - e) / e ELSE 0e0 END, 8) + 0e0 ee1,
round(1e8 * (s * cos(th) * ba * s * cos(th) * ba + s * sin(th) * s * sin(th)), 6) cxx, round(1e8 * (-s * cos(th) * ba * s * sin(th) * ba + s * sin(th) * s * cos(th)), 6) + 0e0 cxy FROM b""")
def ellipse_convert(spark: SparkSession, d: str) -> DataFrame:
    """(re, e1, e2) as axes and angle, in soft form, and as a covariance."""
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), (C("p_size") / 10.0).alias("re"), (((C("p_partkey") % 17) - 8) / 20.0).alias("e1"), (((C("p_partkey") % 13) - 6) / 20.0).alias("e2"))
    _, ab, phi = g.ellipse_to_axes(C("re"), C("e1"), C("e2"))
    lr, s1, _ = g.soften(C("re"), C("e1"), C("e2"))
    cxx, cxy, _ = g.covariance(C("re"), C("e1"), C("e2"))
    z = lambda c, k: F.round(c, k) + 0.0
    return p.select("id", z(ab, 8).alias("ab"), z(phi, 6).alias("phi"), z(lr, 8).alias("logre"), z(s1, 8).alias("ee1"), z(1e8 * cxx, 6).alias("cxx"), z(1e8 * cxy, 6).alias("cxy"))


@query("ellipse_round_trip", f"WITH t AS ({_ELL}) SELECT id, round(re, 6) re, round(e1, 6) + 0e0 e1, round(e2, 6) + 0e0 e2 FROM t")
def ellipse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Soft form and back, then axes and back, gives the shape again."""
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), (C("p_size") / 10.0).alias("re"), (((C("p_partkey") % 17) - 8) / 20.0).alias("e1"), (((C("p_partkey") % 13) - 6) / 20.0).alias("e2"))
    for f in (g.soften, g.harden, g.ellipse_to_axes, g.axes_to_ellipse):
        a, b, c = f(C("re"), C("e1"), C("e2"))
        p = p.select("id", a.alias("re"), b.alias("e1"), c.alias("e2"))
    return p.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "e1", "e2")])


@query("frac_dev_soft", "SELECT p_partkey id, greatest(0e0, least(1e0, (p_size - 10) / 30e0)) clipped, round(1e0 / (1e0 + exp(4e0 * (0.5e0 - p_size / 50e0))), 8) soft, round(4e0 * exp(4e0 * (0.5e0 - p_size / 50e0)) / pow(1e0 + exp(4e0 * (0.5e0 - p_size / 50e0)), 2), 8) slope FROM part")
def frac_dev_soft(spark: SparkSession, d: str) -> DataFrame:
    f = C("p_size") / 50.0
    return read(spark, d, "part").select(C("p_partkey").alias("id"), g.frac_dev((C("p_size") - 10) / 30.0).alias("clipped"), F.round(g.soft_frac_dev(f), 8).alias("soft"), F.round(g.soft_frac_dev_slope(f), 8).alias("slope"))


@query("profile_curves", """WITH t AS (SELECT DISTINCT p_size / 6e0 r FROM part), p AS (SELECT r, 512e0 * exp(-7.66925e0 * (pow(r * r + 0.0004e0, 0.125e0) - 1e0)) d, 2048e0 * exp(-1.67835e0 * (r - 1e0)) e FROM t)
SELECT round(r, 6) r, round(CASE WHEN r > 8 THEN 0e0 WHEN r > 7 THEN d * pow(1e0 - (r - 7e0) * (r - 7e0), 2) ELSE d END, 4) dev, round(CASE WHEN r > 4 THEN 0e0 WHEN r > 3 THEN e * pow(1e0 - (r - 3e0) * (r - 3e0), 2) ELSE e END, 4) "exp" FROM p""")
def profile_curves(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select((C("p_size") / 6.0).alias("r")).distinct()
    return t.select(F.round("r", 6).alias("r"), F.round(g.profile_dev(C("r")), 4).alias("dev"), F.round(g.profile_exp(C("r")), 4).alias("exp"))


@query("extinction_lookup", f"""{with_fixtures('cat1', 'pixels')}, m AS (SELECT x, y, CASE WHEN d > 300e0 THEN 0e0 ELSE d / 1000e0 END e FROM pixels WHERE img = 1),
s AS (SELECT id, ra / 10e0 fx, (dec + 60e0) / 4e0 fy FROM cat1 WHERE ra < 380e0), k AS (SELECT *, floor(fx)::INT x0, floor(fy)::INT y0, fx - floor(fx) ax, fy - floor(fy) ay FROM s),
c AS (SELECT id, ax, ay, coalesce(a.e, 0e0) a, coalesce(b.e, 0e0) b, coalesce(c.e, 0e0) c, coalesce(d.e, 0e0) d FROM k LEFT JOIN m a ON a.x = x0 AND a.y = y0 LEFT JOIN m b ON b.x = x0 + 1 AND b.y = y0 LEFT JOIN m c ON c.x = x0 AND c.y = y0 + 1 LEFT JOIN m d ON d.x = x0 + 1 AND d.y = y0 + 1),
r AS (SELECT id, ay, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE (1e0 - ax) * a + ax * b END p, CASE WHEN c = 0 THEN d WHEN d = 0 THEN c ELSE (1e0 - ax) * c + ax * d END q FROM c)
SELECT id, round(CASE WHEN p = 0 THEN q WHEN q = 0 THEN p ELSE (1e0 - ay) * p + ay * q END, 9) ebv, round(CASE WHEN p = 0 THEN q WHEN q = 0 THEN p ELSE (1e0 - ay) * p + ay * q END * 2.165e0, 12) a_r FROM r""")
def extinction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Reddening by mixing four map cells, where a zero cell counts as missing: each source meets its four cells in one equi-join."""
    m = fixture(spark, d, "pixels").where("img = 1").select("x", "y", F.when(C("d") > 300, 0.0).otherwise(C("d") / 1000.0).alias("e"))
    s = fixture(spark, d, "cat1").select("id", (C("ra") / 10.0).alias("fx"), ((C("dec") + 60.0) / 4.0).alias("fy"))
    k = s.select("id", (C("fx") - F.floor("fx")).alias("ax"), (C("fy") - F.floor("fy")).alias("ay"), F.floor("fx").cast("int").alias("x0"), F.floor("fy").cast("int").alias("y0"))
    cell = F.explode(F.array(*[F.struct((C("x0") + i).alias("x"), (C("y0") + j).alias("y"), F.lit(n).alias("n")) for n, (i, j) in zip("abcd", ((0, 0), (1, 0), (0, 1), (1, 1)), strict=True)]))
    met = k.select("id", "ax", "ay", cell.alias("q")).select("id", "ax", "ay", "q.*").join(m, ["x", "y"], "left")
    four = met.groupBy("id", "ax", "ay").agg(*[F.coalesce(F.max(F.when(C("n") == n, C("e"))), F.lit(0.0)).alias(n) for n in "abcd"])
    ebv = u.mix_nonzero(u.mix_nonzero(C("a"), C("b"), C("ax")), u.mix_nonzero(C("c"), C("d"), C("ax")), C("ay"))
    return four.select("id", F.round(ebv, 9).alias("ebv"), F.round(u.extinction(ebv, F.lit("DES r")), 12).alias("a_r"))


@query("rgb_stretch", f"{with_fixtures('pixels')} SELECT img, x, y, round(greatest(0e0, least(1e0, (asinh(d / 50e0) - asinh(0e0)) / (asinh(300e0 / 50e0) - asinh(0e0)))), 6) v FROM pixels")
def rgb_stretch(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "pixels").select("img", "x", "y", F.round(u.arcsinh_stretch(C("d"), 1 / 50, 0.0, 300.0), 6).alias("v"))


@query("lanczos_weights", """WITH t AS (SELECT DISTINCT (p_size - 25) / 50e0 s FROM part), k AS (SELECT s, o::INT o, s + o x FROM t, (SELECT unnest(range(-3, 4)) o)),
w AS (SELECT s, o, CASE WHEN abs(x) < 1e-12 THEN 1e0 WHEN abs(x) >= 3 THEN 0e0 ELSE 3e0 * sin(pi() * x) * sin(pi() * x / 3e0) / (pi() * x * pi() * x) END w FROM k)
SELECT round(s, 6) + 0e0 s, o, round(w / sum(w) OVER (PARTITION BY s), 8) + 0e0 w FROM w""")
def lanczos_weights(spark: SparkSession, d: str) -> DataFrame:
    """Seven kernel weights for each shift, normalised inside the row."""
    t = read(spark, d, "part").select(((C("p_size") - 25) / 50.0).alias("s")).distinct()
    raw = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda o: F.struct(o.alias("o"), g.lanczos3(C("s") + o).alias("w")))
    k = t.select("s", raw.alias("k")).withColumn("sum", F.aggregate("k", F.lit(0.0), lambda a, x: a + x["w"]))
    e = k.select("s", "sum", F.explode("k").alias("e"))
    return e.select((F.round("s", 6) + 0.0).alias("s"), C("e.o").alias("o"), (F.round(C("e.w") / C("sum"), 8) + 0.0).alias("w"))


@query("path_tags", f"{with_fixtures('cat1')} SELECT id, printf('%.4f-%.4f.fits', ra, dec) tag, printf('w%d_%s', (id % 4)::INT + 1, seg) band, lpad(floor(ra)::BIGINT::VARCHAR, 4, '0')[1:3] dir FROM cat1")
def path_tags(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").select("id", F.format_string("%.4f-%.4f.fits", "ra", "dec").alias("tag"), F.format_string("w%d_%s", (C("id") % 4).cast("int") + 1, C("seg")).alias("band"), F.substring(F.lpad(F.floor("ra").cast("string"), 4, "0"), 1, 3).alias("dir"))


@query("polygon_parse", f"""{with_fixtures('cat1')} SELECT id, round(ra, 1) r0, round(dec, 1) + 0e0 d0, round(ra + 1e0, 1) r1, 3::INT n FROM cat1""")
def polygon_parse(spark: SparkSession, d: str) -> DataFrame:
    """Text like polygon(r,d,r,d,...) to corners."""
    text = F.format_string("polygon(%.1f,%.1f,%.1f,%.1f,%.1f,%.1f)", C("ra"), C("dec"), C("ra") + 1.0, C("dec"), C("ra"), C("dec") + 1.0)
    p = fixture(spark, d, "cat1").select("id", F.split(F.regexp_extract(text, r"polygon\(([^)]*)\)", 1), ",").alias("v"))
    v = p.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    return v.select("id", C("v")[0].alias("r0"), (C("v")[1] + 0.0).alias("d0"), C("v")[2].alias("r1"), (F.size("v") / 2).cast("int").alias("n"))


@query("luminosity_distance", """WITH k AS (SELECT i::DOUBLE / 10e0 z, 4285e0 * (i / 10e0 + 0.5e0 * (i / 10e0) * (i / 10e0)) dl FROM range(0, 60) t(i)), s AS (SELECT p_partkey id, p_size / 10e0 z FROM part)
SELECT id, round(a.dl + (b.dl - a.dl) * (s.z - a.z) / (b.z - a.z), 4) dl FROM s JOIN k a ON round(a.z * 10e0) = floor(s.z * 10e0 + 1e-9) JOIN k b ON round(b.z * 10e0) = floor(s.z * 10e0 + 1e-9) + 1""")
def luminosity_distance(spark: SparkSession, d: str) -> DataFrame:
    """Lookup in a table of distances with linear interpolation between its knots."""
    knot = spark.range(60).select(C("id").alias("k"), (C("id") / 10.0).alias("z0"), (4285.0 * (C("id") / 10.0 + 0.5 * (C("id") / 10.0) * (C("id") / 10.0))).alias("d0"))
    both = knot.join(knot.select((C("k") - 1).alias("k"), C("z0").alias("z1"), C("d0").alias("d1")), "k")
    s = read(spark, d, "part").select(C("p_partkey").alias("id"), (C("p_size") / 10.0).alias("z"), F.floor(C("p_size") / 10.0 * 10.0 + 1e-9).alias("k"))
    return s.join(F.broadcast(both), "k").select("id", F.round(C("d0") + (C("d1") - C("d0")) * (C("z") - C("z0")) / (C("z1") - C("z0")), 4).alias("dl"))  # 60 rows


@query("dust_counts", """SELECT p_partkey id, round(1e20 * exp(p_size / 25e0 - 20e0) * pow(2.5e-4 / 1e-4, -1.6e0) * 2e0 * 6.62606957e-34 * pow(299792458e0 / 2.5e-4, 3) / (299792458e0 * 299792458e0)
/ (exp(6.62606957e-34 * (299792458e0 / 2.5e-4) / (1.3806488e-23 * exp(2.8e0 + (p_partkey % 10) / 20e0))) - 1e0), 6) n FROM part""")
def dust_counts(spark: SparkSession, d: str) -> DataFrame:
    n = u.dust_counts(C("p_size") / 25.0 - 20.0, 2.8 + (C("p_partkey") % 10) / 20.0, F.lit(1.6), 2.5e-4, 1e20)
    return read(spark, d, "part").select(C("p_partkey").alias("id"), F.round(n, 6).alias("n"))


# --- aggregates -----------------------------------------------------------------------------


@query("masked_median", f"{with_fixtures('pixels')} SELECT img, median(d) med, count(*)::BIGINT n FROM pixels WHERE iv >= 2e0 GROUP BY img HAVING count(*) > 20")
def masked_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of the good pixels of each image; images with too few give none."""
    return fixture(spark, d, "pixels").where("iv >= 2e0").groupBy("img").agg(F.median("d").alias("med"), _n("n")).where("n > 20")


@query("mad_noise", f"""{with_fixtures('pixels')} SELECT a.img, round(median(abs(a.d - b.d)) * 1.4826e0 / sqrt(2e0), 6) sig, count(*)::BIGINT n FROM pixels a JOIN pixels b ON a.img = b.img AND b.x = a.x + 5 AND b.y = a.y + 5 WHERE a.x % 5 = 0 AND a.y % 5 = 0 GROUP BY a.img""")
def mad_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise from differences of pixels five apart on a stride: an equi-join on shifted coordinates."""
    p = fixture(spark, d, "pixels").select("img", "x", "y", "d")
    q = p.select("img", (C("x") - 5).alias("x"), (C("y") - 5).alias("y"), C("d").alias("e"))
    return p.where("x % 5 = 0 AND y % 5 = 0").join(q, ["img", "x", "y"]).groupBy("img").agg(F.round(F.median(F.abs(C("d") - C("e"))) * 1.4826 / math.sqrt(2), 6).alias("sig"), _n("n"))


@query("percentiles", f"{with_fixtures('pixels')} SELECT img, round(quantile_cont(d, 0.16e0), 6) p16, round(quantile_cont(d, 0.5e0), 6) p50, round(quantile_cont(d, 0.84e0), 6) p84 FROM pixels GROUP BY img")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = fixture(spark, d, "pixels").groupBy("img").agg(F.percentile("d", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("q"))
    return q.select("img", *[F.round(C("q")[k], 6).alias(n) for k, n in enumerate(("p16", "p50", "p84"))])


@query("hist1d", "SELECT floor(o_totalprice / 10000e0)::BIGINT bin, count(*)::BIGINT n FROM orders GROUP BY 1")
def hist1d(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.floor(C("o_totalprice") / 10000.0).alias("bin")).agg(_n("n"))


@query("hist2d", f"{with_fixtures('cat1')} SELECT floor(ra / 30e0)::BIGINT bx, floor(dec / 20e0)::BIGINT by_, count(*)::BIGINT n, sum(val > 0)::BIGINT npos FROM cat1 GROUP BY 1, 2")
def hist2d(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").groupBy(F.floor(C("ra") / 30.0).alias("bx"), F.floor(C("dec") / 20.0).alias("by_")).agg(_n("n"), F.sum((C("val") > 0).cast("long")).alias("npos"))


@query("distinct_runs", "SELECT o_custkey, o_orderpriority, count(*)::BIGINT n, min(o_orderkey) first_key FROM orders GROUP BY 1, 2")
def distinct_runs(spark: SparkSession, d: str) -> DataFrame:
    """Unique composite keys with the first row of each."""
    return read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(_n("n"), F.min("o_orderkey").alias("first_key"))


@query("group_sizes", "SELECT n group_size, count(*)::BIGINT n_groups FROM (SELECT count(*)::BIGINT n FROM orders GROUP BY o_custkey) GROUP BY n")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(_n("group_size")).groupBy("group_size").agg(_n("n_groups"))


@query("distinct_per_source", "SELECT o_custkey src, count(DISTINCT o_orderpriority)::BIGINT nb, count(DISTINCT date_trunc('month', o_orderdate))::BIGINT nm FROM orders GROUP BY 1")
def distinct_per_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(C("o_custkey").alias("src")).agg(F.count_distinct("o_orderpriority").alias("nb"), F.count_distinct(F.date_trunc("month", "o_orderdate")).alias("nm"))


@query("zeropoint_medians", "WITH m AS (SELECT o_orderpriority band, o_custkey % 50 ccd, median(o_totalprice / 1000e0 - o_custkey % 7) zp, count(*)::BIGINT n FROM orders GROUP BY 1, 2) SELECT band, ccd, n, round(zp, 6) zp, round(zp - avg(zp) OVER (PARTITION BY band), 5) + 0e0 rel FROM m")
def zeropoint_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median offset of each chip, and its difference from the mean over the chips of its band."""
    m = read(spark, d, "orders").groupBy(C("o_orderpriority").alias("band"), (C("o_custkey") % 50).alias("ccd")).agg(F.median(C("o_totalprice") / 1000.0 - C("o_custkey") % 7).alias("zp"), _n("n"))
    return m.select("band", "ccd", "n", F.round("zp", 6).alias("zp"), (F.round(C("zp") - F.avg("zp").over(Window.partitionBy("band")), 5) + 0.0).alias("rel"))


@query("circular_mean", f"{with_fixtures('cat1')} SELECT nat, round(degrees(atan2(avg(sin(radians(ra))), avg(cos(radians(ra))))), 5) + 0e0 mean_ra FROM cat1 GROUP BY nat")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    r = F.radians("ra")
    return fixture(spark, d, "cat1").groupBy("nat").agg((F.round(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), 5) + 0.0).alias("mean_ra"))


@query("plane_fit", f"""{with_fixtures('pixels')}, c AS (SELECT img, floor(x / 8e0) cx, floor(y / 8e0) cy, median(d) m FROM pixels GROUP BY 1, 2, 3),
s AS (SELECT img, count(*)::DOUBLE n, sum(cx) sx, sum(cy) sy, sum(cx * cx) sxx, sum(cx * cy) sxy, sum(cy * cy) syy, sum(m) sm, sum(cx * m) sxm, sum(cy * m) sym FROM c GROUP BY img),
t AS (SELECT *, n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) det FROM s)
SELECT img, round((n * (sxm * syy - sxy * sym) - sm * (sx * syy - sxy * sy) + sy * (sx * sym - sxm * sy)) / det, 6) + 0e0 bx, round((n * (sxx * sym - sxm * sxy) - sx * (sx * sym - sxm * sy) + sm * (sx * sxy - sxx * sy)) / det, 6) + 0e0 by_ FROM t""")
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    """Gradient of the cell medians: nine sums and a closed 3 x 3 solve."""
    c = fixture(spark, d, "pixels").groupBy("img", F.floor(C("x") / 8.0).cast("double").alias("cx"), F.floor(C("y") / 8.0).cast("double").alias("cy")).agg(F.median("d").alias("m"))
    sums = {"n": "count(*)", "sx": "sum(cx)", "sy": "sum(cy)", "sxx": "sum(cx*cx)", "sxy": "sum(cx*cy)", "syy": "sum(cy*cy)", "sm": "sum(m)", "sxm": "sum(cx*m)", "sym": "sum(cy*m)"}
    s = c.groupBy("img").agg(*[F.expr(e).cast("double").alias(k) for k, e in sums.items()])
    det = "(n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy))"
    bx = f"(n * (sxm * syy - sxy * sym) - sm * (sx * syy - sxy * sy) + sy * (sx * sym - sxm * sy)) / {det}"
    by = f"(n * (sxx * sym - sxm * sxy) - sx * (sx * sym - sxm * sy) + sm * (sx * sxy - sxx * sy)) / {det}"
    return s.select("img", (F.round(F.expr(bx), 6) + 0.0).alias("bx"), (F.round(F.expr(by), 6) + 0.0).alias("by_"))


@query("first_of_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) k FROM orders) WHERE k = 1")
def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("arg_extremes", "SELECT o_orderpriority band, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) brightest, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) faintest FROM orders GROUP BY 1")
def arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Row of the greatest and of the least value in each band; ties take the smaller key."""
    o = read(spark, d, "orders").groupBy(C("o_orderpriority").alias("band"))
    return o.agg(F.max_by("o_orderkey", F.struct("o_totalprice", -C("o_orderkey"))).alias("brightest"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("faintest"))


@query("binned_stats", "SELECT floor(p_size / 5e0)::BIGINT bin, round(avg(p_retailprice), 5) mean, round(stddev_pop(p_retailprice), 5) std, round(median(p_retailprice), 5) med, round(quantile_cont(p_retailprice, 0.159e0), 5) lo, round(quantile_cont(p_retailprice, 0.841e0), 5) hi FROM part GROUP BY 1")
def binned_stats(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 5)
    v = C("p_retailprice")
    return read(spark, d, "part").groupBy(F.floor(C("p_size") / 5.0).alias("bin")).agg(r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"), r(F.median(v)).alias("med"), r(F.percentile(v, F.lit(0.159))).alias("lo"), r(F.percentile(v, F.lit(0.841))).alias("hi"))


@query("bad_pixel_mask", "WITH t AS (SELECT l_linenumber img, l_orderkey % 4096 f, l_quantity q, l_extendedprice p FROM lineitem) SELECT img, median(q) noise, median(p) sky, count(*)::BIGINT n, bit_or(f)::BIGINT seen FROM t WHERE (f & 2337) = 0 GROUP BY img")
def bad_pixel_mask(spark: SparkSession, d: str) -> DataFrame:
    """Mask by an or of bits, then noise and sky as medians of the good pixels."""
    bad = 0
    for b in (0, 5, 8, 11):
        bad |= 1 << b
    t = read(spark, d, "lineitem").select(C("l_linenumber").alias("img"), (C("l_orderkey") % 4096).alias("f"), "l_quantity", "l_extendedprice")
    return t.where(C("f").bitwiseAND(bad) == 0).groupBy("img").agg(F.median("l_quantity").alias("noise"), F.median("l_extendedprice").alias("sky"), _n("n"), F.bit_or("f").alias("seen"))


# --- windows and sets -----------------------------------------------------------------------


@query("topk_sn", f"{with_fixtures('pixels')} SELECT img, x, y, round(d * sqrt(iv), 6) sn FROM pixels ORDER BY d * sqrt(iv) DESC, img, x, y LIMIT 25")
def topk_sn(spark: SparkSession, d: str) -> DataFrame:
    p = fixture(spark, d, "pixels").withColumn("s", C("d") * F.sqrt("iv"))
    return p.orderBy(C("s").desc(), "img", "x", "y").limit(25).select("img", "x", "y", F.round("s", 6).alias("sn"))


@query("centre_rank", f"{with_fixtures('srcs')} SELECT sid, row_number() OVER (PARTITION BY psize % 10 ORDER BY (px - 20e0) * (px - 20e0) + (py - 20e0) * (py - 20e0), sid)::INT k FROM srcs")
def centre_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank by distance from the field centre inside each field."""
    r = (C("px") - 20.0) * (C("px") - 20.0) + (C("py") - 20.0) * (C("py") - 20.0)
    return fixture(spark, d, "srcs").select("sid", F.row_number().over(Window.partitionBy(C("psize") % 10).orderBy(r, "sid")).alias("k"))


@query("islands", "WITH o AS (SELECT DISTINCT o_custkey g, o_orderkey k FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT k // 1000 g, k, k - row_number() OVER (PARTITION BY k // 1000 ORDER BY k) i FROM o), s AS (SELECT g, i, min(k) a, max(k) b FROM r GROUP BY g, i) SELECT g, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) runs FROM s GROUP BY g")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous integers as "a-b" text, in each field."""
    o = read(spark, d, "orders").where("o_orderkey % 3 <> 0").select(C("o_orderkey").alias("k")).withColumn("g", F.floor(C("k") / 1000))
    r = o.withColumn("i", C("k") - F.row_number().over(Window.partitionBy("g").orderBy("k")))
    s = r.groupBy("g", "i").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    text = F.when(C("a") == C("b"), C("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    runs = s.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return runs.select("g", F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("runs"))


@query("candidate_filter", f"""{with_fixtures('pixels')}, m AS (SELECT a.img, a.x, a.y, any_value(a.d) d, max(b.d) nb FROM pixels a JOIN pixels b ON a.img = b.img AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 WHERE a.d >= 75e0 GROUP BY 1, 2, 3)
SELECT img, x, y, d FROM m WHERE x % 80 >= 3 AND x % 80 < 37 AND y >= 3 AND y < 37 AND nb <= 100e0 AND d >= 80e0""")
def candidate_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates off the edge whose neighbourhood maximum is not too bright: pixels that are too bright are spread to their neighbours, and those drop out."""
    p = fixture(spark, d, "pixels").select("img", "x", "y", "d")
    o = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    bright = p.where("d > 100e0").select("img", "x", "y", o.alias("i")).select("img", "y", (C("x") + C("i")).alias("x"), o.alias("j")).select("img", "x", (C("y") + C("j")).alias("y"))
    cand = p.where("d >= 80e0 AND d <= 100e0 AND x % 80 >= 3 AND x % 80 < 37 AND y >= 3 AND y < 37")
    return cand.join(bright.hint("merge"), ["img", "x", "y"], "left_anti").select("img", "x", "y", "d")


@query("neighbour_differences", f"{with_fixtures('pixels')} SELECT img, x, y, d - lag(d) OVER (PARTITION BY img, y ORDER BY x) dx, lead(d) OVER (PARTITION BY img, y ORDER BY x) - d fx FROM pixels")
def neighbour_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differences of neighbours along a row, as a smoothness prior needs them."""
    w = Window.partitionBy("img", "y").orderBy("x")
    return fixture(spark, d, "pixels").select("img", "x", "y", (C("d") - F.lag("d").over(w)).alias("dx"), (F.lead("d").over(w) - C("d")).alias("fx"))


@query("light_curve", "SELECT o_custkey src, o_orderkey exp_id, row_number() OVER w k, round(o_totalprice - lag(o_totalprice) OVER w, 4) + 0e0 step, round(epoch(o_orderdate - lag(o_orderdate) OVER w) / 86400e0, 6) dt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("row_number() OVER w k", "(row_number() OVER w)::INT k"))
def light_curve(spark: SparkSession, d: str) -> DataFrame:
    """Exposures of each source in time order, with steps in flux and time."""
    w = Window.partitionBy("src").orderBy("ts", "exp_id")
    e = fixture(spark, d, "expo").withColumn("t", F.unix_micros(C("ts").cast("timestamp")) / 1e6)
    return e.select("src", "exp_id", F.row_number().over(w).alias("k"), (F.round(C("flux") - F.lag("flux").over(w), 4) + 0.0).alias("step"), F.round((C("t") - F.lag("t").over(w)) / 86400.0, 6).alias("dt"))


@query("union_tables", f"{with_fixtures('cat1', 'cat2')} SELECT 1::INT src, id, ra, dec FROM cat1 UNION ALL SELECT 2::INT, id, ra, dec FROM cat2")
def union_tables(spark: SparkSession, d: str) -> DataFrame:
    one, two = (fixture(spark, d, c).select(F.lit(k).alias("src"), "id", "ra", "dec") for k, c in ((1, "cat1"), (2, "cat2")))
    return one.unionByName(two)


@query("union_fillzero", f"{with_fixtures('cat1', 'cat2')} SELECT id, ra, val, 0::INT AS size, nat::INT AS nat FROM cat1 UNION ALL SELECT id, ra, val, size::INT, 0::INT FROM cat2")
def union_fillzero(spark: SparkSession, d: str) -> DataFrame:
    """Union of tables with different columns; what is missing is zero."""
    one, two = fixture(spark, d, "cat1").select("id", "ra", "val", "nat"), fixture(spark, d, "cat2").select("id", "ra", "val", "size")
    return one.unionByName(two, allowMissingColumns=True).select("id", "ra", "val", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("nat", F.lit(0)).alias("nat"))


@query("set_differences", "SELECT c_custkey id, 'both' side FROM customer WHERE c_custkey IN (SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference by semi and anti join."""
    a, b = read(spark, d, "customer").select(C("c_custkey").alias("id")), read(spark, d, "part").where("p_size > 20").select(C("p_partkey").alias("id"))
    return a.join(b, "id", "left_semi").withColumn("side", F.lit("both")).unionByName(a.join(b, "id", "left_anti").withColumn("side", F.lit("left")))
