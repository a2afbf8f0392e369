"""Streaming queries, drained over the events table, and staged and zoned storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import fits_source as fits
from ..sources import io
from ..sources.fixtures import fixture, read, with_fixtures
from ..streaming import lightcurves as lc
from .core import query

C = F.col


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_W = "WITH e AS (SELECT event_type, value, ts, max(ts) OVER () - INTERVAL 1 HOUR mark FROM events)"


@query("stream_tumbling", f"{_W} SELECT date_trunc('day', ts)::VARCHAR[1:10] AS \"day\", event_type, count(*)::BIGINT n, round(sum(value), 3) total FROM e GROUP BY 1, 2 HAVING max(date_trunc('day', ts) + INTERVAL 1 DAY) <= max(mark)".replace("date_trunc('day', ts)::VARCHAR[1:10]", "strftime(date_trunc('day', ts), '%Y-%m-%d')"))
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has closed."""
    out = lc.drained(lc.tumbling(lc.measurements(spark, d), "1 day", "1 hour"), "tumbling", _folder(spark, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@query("stream_sliding", f"{_W}, s AS (SELECT *, date_trunc('day', ts) - o * INTERVAL 1 DAY st FROM e, (SELECT unnest([0, 1]) o)) SELECT strftime(st, '%Y-%m-%d') AS \"day\", event_type, count(*)::BIGINT n FROM s GROUP BY st, event_type HAVING st + INTERVAL 2 DAY <= max(mark)")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days every day; odd days since the epoch and even ones overlap."""
    out = lc.drained(lc.tumbling(lc.measurements(spark, d), "2 days", "1 hour", "1 day"), "sliding", _folder(spark, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_sessions", """WITH e AS (SELECT user_id src, ts, max(ts) OVER () - INTERVAL 1 HOUR mark FROM events), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END b FROM e WINDOW w AS (PARTITION BY src ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM s) SELECT src, count(*)::BIGINT n, strftime(min(ts), '%Y-%m-%d %H:%M') "start" FROM g GROUP BY src, k HAVING max(ts) + INTERVAL 10 MINUTE <= max(mark)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = lc.drained(lc.sessions(lc.measurements(spark, d), "10 minutes", "1 hour"), "sessions", _folder(spark, "stream"))
    return out.select("src", "n", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"))


@query("stream_running_flux", "SELECT user_id src, round(avg(value), 4) flux, count(*)::BIGINT n FROM events GROUP BY 1")
def stream_running_flux(spark: SparkSession, d: str) -> DataFrame:
    """State after the last batch."""
    out = lc.drained(lc.running_flux(lc.measurements(spark, d)), "flux", _folder(spark, "stream"), "update")
    last = out.groupBy("src").agg(F.max_by(F.struct("flux", "n"), "batch").alias("s"))
    return last.select("src", F.round("s.flux", 4).alias("flux"), "s.n")


@query("stream_visits", """WITH e AS (SELECT user_id src, ts, value, max(ts) OVER () - INTERVAL 1 HOUR mark FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END b FROM e WINDOW w AS (PARTITION BY src ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) k, max(ts) OVER (PARTITION BY src) final FROM s)
SELECT src, strftime(min(ts), '%Y-%m-%d %H:%M:%S') "start", count(*)::BIGINT n, round(avg(value), 7) + 0e0 flux, round(CASE WHEN max(ts) > min(ts) THEN regr_slope(value, epoch_us(ts) / 3.6e9 - 470000) END, 4) + 0e0 slope FROM g GROUP BY src, k HAVING max(ts) < any_value(final) OR max(ts) + INTERVAL 12 HOUR < any_value(mark)""")
def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    """Lines through the visits of each source. Events arrive in four ranges of time; the stream is stopped after each and goes on from its checkpoint with the next."""
    folder = _folder(spark, "visits")
    e = read(spark, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    bounds = [None, *([lo + (hi - lo) * k / 4 for k in (1, 2, 3)] if lo else []), None]
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = e if a is None else e.where(C("ts") >= a)
        (part if b is None else part.where(C("ts") < b)).write.mode("append").parquet(f"{folder}/in")
        out = lc.drained(lc.visit_fits(lc.measurements(spark, f"{folder}/in", "*.parquet"), 12 * 3600, "1 hour"), "visits", folder)
    return out.select("src", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", (F.round("flux", 7) + 0.0).alias("flux"), (F.round("slope", 4) + 0.0).alias("slope"))


@query("zone_storage", f"{with_fixtures('cat1')} SELECT id, ra, dec FROM cat1 WHERE dec >= -12.3e0 AND dec < 7.7e0")
def zone_storage(spark: SparkSession, d: str) -> DataFrame:
    """Written by declination zone, read back with pruned folders."""
    path = _folder(spark, "zones")
    io.write_zones(fixture(spark, d, "cat1").select("id", "ra", "dec"), path)
    return io.read_zones(spark, path, -12.3, 7.7).select("id", "ra", "dec")


@query("staged_run", f"{with_fixtures('cat1')} SELECT nat, count(*)::BIGINT n FROM cat1 WHERE val > 0 GROUP BY nat")
def staged_run(spark: SparkSession, d: str) -> DataFrame:
    """Three stages kept as Parquet."""
    stages = [("read", lambda s, _: fixture(s, d, "cat1")), ("cut", lambda s, df: df.where("val > 0")), ("count", lambda s, df: df.groupBy("nat").agg(F.count(F.lit(1)).alias("n")))]
    return io.run_stages(spark, stages, _folder(spark, "stages"), "count")


@query("text_table", f"{with_fixtures('cat2')} SELECT id, ra, size FROM cat2")
def text_table(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text with a header, read with given types."""
    path = _folder(spark, "text")
    fixture(spark, d, "cat2").select("id", "ra", "size").write.option("header", True).option("sep", "|").csv(path)
    return io.read_text_table(spark, path, "id long, ra double, size int", "|")


@query("fits_source", f"{with_fixtures('cat2')} SELECT id, ra, dec, size, brand FROM cat2 WHERE dec > -55e0")
def fits_source(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as FITS tables, a file a task, and read back by splits of 64 KiB with five of its columns."""
    fits.register(spark)
    path = _folder(spark, "fits")
    fixture(spark, d, "cat2").write.format("fits").mode("append").save(path)
    got = spark.read.format("fits").schema("id long, ra double, dec double, size int, brand string").option("split", 1 << 16).load(path)
    return got.where("dec > -55")


@query("ccd_metadata", "SELECT o_orderkey exp_id, 'ccd' || (o_custkey % 62 + 1) extname, o_orderpriority AS filter, round(30e0 + o_custkey % 90, 1) exptime, round(0.8e0 + (o_orderkey % 50) / 100e0, 4) seeing FROM orders")
def ccd_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Table of image metadata from headers kept as text: typed columns by JSON schema."""
    e = fixture(spark, d, "expo")
    head = F.to_json(F.struct(F.concat(F.lit("ccd"), (C("src") % 62 + 1).cast("string")).alias("EXTNAME"), C("band").alias("FILTER"), (30.0 + C("src") % 90).alias("EXPTIME"), (0.8 + (C("exp_id") % 50) / 100.0).alias("SEEING")))
    h = e.select("exp_id", F.from_json(head, "EXTNAME string, FILTER string, EXPTIME double, SEEING double").alias("h"))
    return h.select("exp_id", C("h.EXTNAME").alias("extname"), C("h.FILTER").alias("filter"), F.round("h.EXPTIME", 1).alias("exptime"), F.round("h.SEEING", 4).alias("seeing"))
