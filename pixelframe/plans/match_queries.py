"""Join queries: cross-matches, deduplication, merges, ownership, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import spatial as s
from ..sources.fixtures import fixture, read, with_fixtures
from .core import query

C = F.col
R = 1.05


def _vec(name: str, alias: str, extra: str = "") -> str:
    return f"{alias} AS (SELECT id, cos(radians(dec)) * cos(radians(ra)) x, cos(radians(dec)) * sin(radians(ra)) y, sin(radians(dec)) z{extra} FROM {name})"


def _pairs(r: float = R, right: str = "cat2", limit: str | None = None, extra: str = "") -> str:
    """WITH clause up to pairs(lid, rid, dist) between cat1 and the right catalogue."""
    lim = limit or f"{r}e0"
    d2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return f"""{with_fixtures('cat1', 'cat2')}, {_vec('cat1', 'va')}, {_vec(right, 'vb', extra)},
pairs AS (SELECT a.id lid, b.id rid, degrees(2e0 * asin(sqrt({d2}) / 2e0)) dist FROM va a, vb b WHERE {d2} <= 4e0 * sin(radians({lim}) / 2e0) * sin(radians({lim}) / 2e0))"""


def _match(spark: SparkSession, d: str, r: float = R) -> DataFrame:
    return s.sky_pairs(fixture(spark, d, "cat1"), fixture(spark, d, "cat2"), r)


@query("xmatch_all", f"{_pairs()} SELECT lid, rid, round(dist, 7) dist FROM pairs")
def xmatch_all(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d).withColumn("dist", F.round("dist", 7))


@query("xmatch_nearest", f"{_pairs()} SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(dist, 9), rid) k FROM pairs) WHERE k = 1")
def xmatch_nearest(spark: SparkSession, d: str) -> DataFrame:
    return s.nearest(_match(spark, d).withColumn("dist", F.round("dist", 9))).select("lid", "rid")


@query("xmatch_self", f"{_pairs(6.0, right='cat1')} SELECT lid, rid, round(dist, 7) dist FROM pairs WHERE lid < rid")
def xmatch_self(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric self-match: each pair once, no identities."""
    a = fixture(spark, d, "cat1")
    return s.sky_pairs(a, a, 6.0).where("lid < rid").withColumn("dist", F.round("dist", 7))


@query("xmatch_left_zero", f"{_pairs()}, n AS (SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(dist, 9), rid) k FROM pairs) WHERE k = 1) SELECT cat1.id, cat1.ra, coalesce(b.val, 0e0) val, coalesce(b.size, 0)::INT size, rid IS NOT NULL matched FROM cat1 LEFT JOIN n ON n.lid = cat1.id LEFT JOIN cat2 b ON b.id = n.rid")
def xmatch_left_zero(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched rows get zeros and a flag."""
    near = s.nearest(_match(spark, d).withColumn("dist", F.round("dist", 9)))
    right = near.join(fixture(spark, d, "cat2").select(C("id").alias("rid"), "val", "size"), "rid").select(C("lid").alias("id"), "val", "size")
    return c.left_zero(fixture(spark, d, "cat1").select("id", "ra"), right, "id", ["val", "size"])


@query("xmatch_anti", f"{_pairs()} SELECT id FROM cat1 WHERE id NOT IN (SELECT lid FROM pairs)")
def xmatch_anti(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").select("id").join(_match(spark, d).select(C("lid").alias("id")), "id", "left_anti")


@query("xmatch_semi", f"{_pairs()} SELECT id, seg FROM cat1 WHERE id IN (SELECT lid FROM pairs)")
def xmatch_semi(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").select("id", "seg").join(_match(spark, d).select(C("lid").alias("id")), "id", "left_semi")


@query("best_unless_primary", f"{_pairs(2.05, 'cat1')} SELECT id, nat FROM cat1 WHERE nat % 2 = 0 OR id NOT IN (SELECT p.lid FROM pairs p JOIN cat1 b ON b.id = p.rid WHERE b.nat % 2 = 0)")
def best_unless_primary(spark: SparkSession, d: str) -> DataFrame:
    """Primary rows stay; the others stay unless a primary lies near."""
    a = fixture(spark, d, "cat1")
    prim, rest = a.where("nat % 2 = 0"), a.where("nat % 2 <> 0")
    near = s.sky_pairs(rest, prim, 2.05).select(C("lid").alias("id"))
    return prim.unionByName(rest.join(near, "id", "left_anti")).select("id", "nat")


_V3 = ", ".join(_vec(n, v) for n, v in (("k1", "w1"), ("k2", "w2")))
_NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4e0 * sin(radians(1.05e0) / 2e0) * sin(radians(1.05e0) / 2e0)"


@query("greedy_merge", f"""{with_fixtures('cat1', 'cat2')}, a1 AS (SELECT 1 src, id, ra, dec FROM cat1 WHERE id % 2 = 0), a2 AS (SELECT 2 src, id, ra, dec FROM cat2), a3 AS (SELECT 3 src, id, ra, dec FROM cat1 WHERE id % 2 = 1),
v AS (SELECT *, cos(radians(dec)) * cos(radians(ra)) x, cos(radians(dec)) * sin(radians(ra)) y, sin(radians(dec)) z FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)),
k2 AS (SELECT * FROM v a WHERE src = 1 OR (src = 2 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.src = 1 AND {_NEAR}))),
k3 AS (SELECT * FROM v a WHERE src = 3 AND NOT EXISTS (SELECT 1 FROM k2 b WHERE {_NEAR}))
SELECT src::INT src, id FROM k2 UNION ALL SELECT src::INT, id FROM k3""")
def greedy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three catalogues in order; a row joins if nothing kept lies near."""
    one, two = fixture(spark, d, "cat1").select("id", "ra", "dec"), fixture(spark, d, "cat2").select("id", "ra", "dec")
    cats = [one.where("id % 2 = 0"), two, one.where("id % 2 = 1")]
    return s.greedy_merge([x.select(F.lit(k).alias("src"), "id", "ra", "dec") for k, x in enumerate(cats, 1)], R).select("src", "id")


@query("dedup", f"{_pairs(2.05, 'cat1')} SELECT id FROM cat1 WHERE id NOT IN (SELECT lid FROM pairs WHERE rid < lid)")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    """The larger id of each close pair goes."""
    return s.without_close_pairs(fixture(spark, d, "cat1").select("id", "ra", "dec"), 2.05).select("id")


@query("pixel_match", f"{with_fixtures('srcs')} SELECT a.sid lid, b.sid rid, round(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)), 7) dist FROM srcs a, srcs b WHERE a.sid < b.sid AND (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 2.55e0 * 2.55e0")
def pixel_match(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "srcs").select(C("sid").alias("id"), C("px").alias("x"), C("py").alias("y"))
    return s.plane_pairs(t, t, 2.55).where("lid < rid").withColumn("dist", F.round("dist", 7))


@query("nearest_scaled", f"""{with_fixtures('srcs')}, t AS (SELECT sid id, px / 4e0 x, py / 2e0 y, psize FROM srcs) SELECT lid, rid FROM (SELECT a.id lid, b.id rid, row_number() OVER (PARTITION BY a.id ORDER BY round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9), b.id) k FROM t a, t b WHERE a.psize % 2 = 0 AND b.psize % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9e0) WHERE k = 1""")
def nearest_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbour in scaled flat coordinates within a reach."""
    t = fixture(spark, d, "srcs").select(C("sid").alias("id"), (C("px") / 4.0).alias("x"), (C("py") / 2.0).alias("y"), "psize")
    p = s.plane_pairs(t.where("psize % 2 = 0"), t.where("psize % 2 = 1"), 3.0)
    return s.nearest(p.withColumn("dist", F.round(C("dist") * C("dist"), 9))).select("lid", "rid")


_TILES = "(SELECT i * 4 + j tile, 5e0 + 10e0 * i cx, 5e0 + 10e0 * j cy FROM range(4) a(i), range(4) b(j))"


@query("tile_assign", f"""{with_fixtures('srcs')}, s AS (SELECT sid, floor(px / 80e0)::BIGINT field, px % 80e0 px, py FROM srcs), k AS (SELECT sid, 16 * field + tile tile, px - cx dx, py - cy dy, greatest(abs(px - cx), abs(py - cy)) d FROM s, {_TILES} WHERE abs(px - cx) <= 7e0 AND abs(py - cy) <= 7e0)
SELECT sid, tile, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN d <= 6e0 THEN 0 ELSE 1 END, d, tile) = 1 AND d <= 6e0 THEN 'keep' ELSE 'margin' END "role" FROM k""")
def tile_assign(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen overlapping tiles in every field; sources meet the tiles of their grid cell and the cells around it."""
    cell = F.explode(F.array(*[F.struct((F.floor(C("px") / 10) + i).alias("i"), (F.floor(C("py") / 10) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    s = fixture(spark, d, "srcs").select("sid", F.floor(C("px") / 80.0).alias("field"), (C("px") % 80.0).alias("px"), "py")
    k = s.select("sid", "field", "px", "py", cell.alias("c")).where("c.i BETWEEN 0 AND 3 AND c.j BETWEEN 0 AND 3")
    k = k.select("sid", (C("field") * 16 + C("c.i") * 4 + C("c.j")).alias("tile"), (C("px") - (5.0 + 10.0 * C("c.i"))).alias("dx"), (C("py") - (5.0 + 10.0 * C("c.j"))).alias("dy"))
    k = k.where((F.abs("dx") <= 7) & (F.abs("dy") <= 7))
    return c.owned_by_tile(k, C("dx"), C("dy"), F.greatest(F.abs("dx"), F.abs("dy")) <= 6).select("sid", "tile", "role")


def _corners(cx, cy, h, a):
    """Corners of a square of half-size h turned by the angle whose cosine and sine are 0.8 and 0.6 where a is 1."""
    cos, sin = (0.8, 0.6) if a else (1.0, 0.0)
    pts = ((-h, -h), (h, -h), (h, h), (-h, h))
    return [cx + cos * x - sin * y for x, y in pts], [cy + sin * x + cos * y for x, y in pts]


@query("images_touching", f"""{with_fixtures('srcs')}, a AS (SELECT sid, px, py FROM srcs WHERE psize % 4 = 0), b AS (SELECT sid, px, py FROM srcs WHERE psize % 4 = 1),
p AS (SELECT a.sid aid, b.sid bid, b.px - a.px u, b.py - a.py v FROM a, b WHERE (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 36e0)
SELECT aid, bid FROM p WHERE abs(u) <= 2e0 + 1.5e0 * 1.4e0 AND abs(v) <= 2e0 + 1.5e0 * 1.4e0 AND abs(0.8e0 * u + 0.6e0 * v) <= 1.5e0 + 2e0 * 1.4e0 AND abs(-0.6e0 * u + 0.8e0 * v) <= 1.5e0 + 2e0 * 1.4e0""")
def images_touching(spark: SparkSession, d: str) -> DataFrame:
    """Radius prefilter through the grid, then a separating-axis test of a square and a turned square."""
    t = fixture(spark, d, "srcs").select(C("sid").alias("id"), C("px").alias("x"), C("py").alias("y"), "psize")
    p = s.plane_pairs(t.where("psize % 4 = 0"), t.where("psize % 4 = 1"), 6.0)
    a, b = (t.select(C("id").alias(f"{k}id"), C("x").alias(f"{k}x"), C("y").alias(f"{k}y")) for k in "lr")
    q = p.join(a, "lid").join(b, "rid")
    ax, ay = _corners(C("lx"), C("ly"), 2.0, 0)
    bx, by = _corners(C("rx"), C("ry"), 1.5, 1)
    q = q.select("lid", "rid", *[v.alias(f"{n}{k}") for n, vs in (("ax", ax), ("ay", ay), ("bx", bx), ("by", by)) for k, v in enumerate(vs)])
    corners = [[C(f"{n}{k}") for k in range(4)] for n in ("ax", "ay", "bx", "by")]
    return q.where(c.convex_overlap(*corners)).select(C("lid").alias("aid"), C("rid").alias("bid"))


_BOX = "SELECT sid id, floor(px)::INT x0, (floor(px) + 1 + psize % 4)::INT x1, floor(py)::INT y0, (floor(py) + 1 + psize % 3)::INT y1 FROM srcs"


@query("box_overlap", f"{with_fixtures('srcs')}, b AS ({_BOX}) SELECT a.id aid, b.id bid FROM b a, b b WHERE a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "srcs").select(C("sid").alias("id"), F.floor("px").cast("int").alias("x0"), (F.floor("px") + 1 + C("psize") % 4).cast("int").alias("x1"), F.floor("py").cast("int").alias("y0"), (F.floor("py") + 1 + C("psize") % 3).cast("int").alias("y1"))
    return s.box_overlaps(t, t, 6).where("aid < bid")


@query("row_correspondence", f"{_pairs()} SELECT p.lid, p.rid, a.val - b.val dval, a.seg, b.brand FROM pairs p JOIN cat1 a ON a.id = p.lid JOIN cat2 b ON b.id = p.rid".replace("a.val - b.val dval", "round(a.val - b.val, 4) + 0e0 dval"))
def row_correspondence(spark: SparkSession, d: str) -> DataFrame:
    """Columns of two tables side by side along a table of pairs."""
    p = _match(spark, d)
    a = fixture(spark, d, "cat1").select(C("id").alias("lid"), C("val").alias("va"), "seg")
    b = fixture(spark, d, "cat2").select(C("id").alias("rid"), C("val").alias("vb"), "brand")
    return p.join(a, "lid").join(b, "rid").select("lid", "rid", (F.round(C("va") - C("vb"), 4) + 0.0).alias("dval"), "seg", "brand")


@query("exact_lookup", "SELECT o_orderkey, o_custkey AS custkey, c_acctbal AS zp FROM orders JOIN customer ON c_custkey = o_custkey")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Key lookup that must find exactly one row."""
    cust = read(spark, d, "customer").select(C("c_custkey").alias("custkey"), C("c_acctbal").alias("zp"))
    return c.exactly_one(read(spark, d, "orders").select("o_orderkey", C("o_custkey").alias("custkey")), cust, "custkey").select("o_orderkey", "custkey", "zp")


@query("xmatch_list", f"{_pairs()}, l AS (SELECT lid, array_to_string(list_sort(list(rid)), ',') ids FROM pairs GROUP BY lid) SELECT id, ids FROM cat1 LEFT JOIN l ON lid = id")
def xmatch_list(spark: SparkSession, d: str) -> DataFrame:
    """All partners of each row as a list; null where there are none."""
    lists = _match(spark, d).groupBy(C("lid").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("rid")).cast("array<string>"), ",").alias("ids"))
    return fixture(spark, d, "cat1").select("id").join(lists, "id", "left")


@query("xmatch_flagged", f"{_pairs()} SELECT cat2.id, cat2.id IN (SELECT rid FROM pairs) flagged FROM cat2")
def xmatch_flagged(spark: SparkSession, d: str) -> DataFrame:
    hit = _match(spark, d).select(C("rid").alias("id")).distinct().withColumn("flagged", F.lit(True))
    return fixture(spark, d, "cat2").select("id").join(hit, "id", "left").select("id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("xmatch_rowradius", f"{_pairs(limit='(b.size / 20e0 + 0.013e0)', extra=', size')} SELECT id FROM cat1 WHERE id NOT IN (SELECT lid FROM pairs)")
def xmatch_rowradius(spark: SparkSession, d: str) -> DataFrame:
    """A radius of its own for each right row; everything matched is dropped."""
    right = fixture(spark, d, "cat2")
    p = s.sky_pairs(fixture(spark, d, "cat1"), right, 50 / 20 + 0.013, max_radius=C("size") / 20.0 + 0.013)
    return fixture(spark, d, "cat1").select("id").join(p.select(C("lid").alias("id")), "id", "left_anti")


@query("footprint", f"""{_pairs(4.05)}, q AS (SELECT lid, rid, sin(radians(b.dec)) * sin(radians(a.dec)) + cos(radians(b.dec)) * cos(radians(a.dec)) * cos(radians(a.ra - b.ra)) cc, a.ra, a.dec, b.ra ra0, b.dec dec0 FROM pairs JOIN cat1 a ON a.id = lid JOIN cat2 b ON b.id = rid WHERE b.size < 10)
SELECT DISTINCT lid id FROM q WHERE abs(degrees(cos(radians(dec)) * sin(radians(ra - ra0)) / cc)) <= 2.503e0 AND abs(degrees((cos(radians(dec0)) * sin(radians(dec)) - sin(radians(dec0)) * cos(radians(dec)) * cos(radians(ra - ra0))) / cc)) <= 1.507e0""")
def footprint(spark: SparkSession, d: str) -> DataFrame:
    """Candidate fields by radius, then a rectangle in each field's tangent plane."""
    from ..functions.geometry import tan_project

    a, b = fixture(spark, d, "cat1"), fixture(spark, d, "cat2").where("size < 10")
    at, fields = a.select("ra", "dec").distinct(), b.select("ra", "dec").distinct()  # rows at one position lie in the same fields
    p = s.sky_pairs(at.withColumn("id", F.struct("ra", "dec")), fields.withColumn("id", F.struct("ra", "dec")), 4.05)
    xi, eta, front = tan_project(C("lid.ra"), C("lid.dec"), C("rid.ra"), C("rid.dec"))
    seen = p.where(front & (F.abs(xi) <= 2.503) & (F.abs(eta) <= 1.507)).select("lid.ra", "lid.dec").distinct()
    return a.join(seen.hint("merge"), ["ra", "dec"], "left_semi").select("id").distinct()


@query("three_way_match", f"""{_pairs(2.05)}, n AS (SELECT lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(dist, 9), rid) k FROM pairs) WHERE k = 1)
SELECT a.lid id, a.rid r1, b.rid r2, a.rid = b.rid same FROM n a JOIN (SELECT lid, min(rid) rid FROM pairs GROUP BY lid) b USING (lid) JOIN cat1 ON cat1.id = a.lid WHERE nat < 20""")
def three_way_match(spark: SparkSession, d: str) -> DataFrame:
    """Two matches of one reference catalogue compared on its id."""
    p = _match(spark, d, 2.05).withColumn("dist", F.round("dist", 9))
    one = s.nearest(p).select(C("lid").alias("id"), C("rid").alias("r1"))
    two = p.groupBy(C("lid").alias("id")).agg(F.min("rid").alias("r2"))
    ref = fixture(spark, d, "cat1").where("nat < 20").select("id")
    return one.join(two, "id").join(ref, "id").select("id", "r1", "r2", (C("r1") == C("r2")).alias("same"))


@query("match_groups", f"""{with_fixtures('srcs')}, e AS (SELECT a.sid a, b.sid b FROM srcs a, srcs b WHERE (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 2.05e0 * 2.05e0),
r AS (SELECT * FROM (WITH RECURSIVE c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, min(b) grp FROM c GROUP BY a)) SELECT a id, grp FROM r""")
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sources chained by distance into groups; singles are groups of one."""
    t = fixture(spark, d, "srcs").select(C("sid").alias("id"), C("px").alias("x"), C("py").alias("y"))
    p = s.plane_pairs(t, t, 2.05).where("lid < rid").select(C("lid").alias("a"), C("rid").alias("b"))
    return c.groups_of(p, t.select("id"))


@query("group_members", f"""{with_fixtures('cat1')} SELECT nat, seg, count(*)::BIGINT n, round(avg(val), 4) + 0e0 mean FROM cat1 GROUP BY nat, seg""")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat1").groupBy("nat", "seg").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("val"), 4) + 0.0).alias("mean"))


@query("dense_rank_fields", f"{with_fixtures('cat2')} SELECT id, brand, dense_rank() OVER (PARTITION BY brand ORDER BY size)::INT k FROM cat2")
def dense_rank_fields(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "cat2").select("id", "brand", F.dense_rank().over(Window.partitionBy("brand").orderBy("size")).alias("k"))
