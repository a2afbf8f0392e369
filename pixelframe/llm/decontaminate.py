"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of every run of W consecutive K-grams, so any shared span of
W + K - 1 = 10 words keeps one fingerprint in common. Kept fingerprints of the benchmark are
joined with those of the documents; each hit is then extended to the windows of 10 words
around it, and a window counts only if its words occur in an item. Items of fewer words have
one window, the item itself; their lengths (at most nine) get K-grams of that length.

Only hits leave a document's row before they are joined, never its words. Tables of the
benchmark are broadcast up to a fixed number of rows and joined by shuffles beyond it.

Defined results: null, empty and wordless texts have no words, no hits and are clean; items
without words match nothing; repeated documents get equal rows; repeated items count by their
distinct ids, a null id does not count; an empty benchmark leaves every document clean; an
empty corpus gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_NUMBERS, FEW_TEXTS, ascii_lower, discard, maybe_in, sized, spread, table, written

WINDOW, K = 10, 5
W = WINDOW - K + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A packed key: the hash above, the position in the lowest bits.
POSITION_BITS = 30
_LOW = (1 << POSITION_BITS) - 1


def item_words(text: Column) -> Column:
    """Words of letters a-z, digits and everything beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _hash(w: str, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def with_fingerprints(df: DataFrame, w: str = "w") -> DataFrame:
    """df with `prints`: the winnowed keys of its word array. Columns are kept in steps of two references each, so that Spark evaluates each array once."""
    n = F.size(w)
    keys = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - K), lambda i: _hash(w, i, K).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<bigint>"))
    step = df.withColumn("_keys", keys)
    low = F.when(F.size("_keys") >= W, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_keys") - (W - 1)), lambda i: F.array_min(F.slice("_keys", i, W))))).otherwise(F.array().cast("array<bigint>"))
    return step.withColumn("prints", low).drop("_keys")


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """size, window (its words, joined by spaces) and item, for each window of each item once."""
    w = items.select(F.col(key).cast("string").alias("item"), item_words(F.col(text)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    size = F.least(F.size("w"), F.lit(WINDOW))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return spread(w.select("item", size.alias("size"), "w"), each, "window").select("size", "window", "item").distinct()


def _doc_key(text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("_h"), F.length(body).alias("_n")]


def hits(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _h, _n and the positions at which a kept fingerprint of the benchmark stands: (size of the window, position). One pass over the texts for all sizes."""
    long_items = windows.where(F.col("size") == WINDOW).select("window").distinct().select(F.split("window", " ").alias("w"))
    kept = spread(with_fingerprints(long_items).select("prints"), F.col("prints"), "p").select(F.lit(WINDOW).alias("size"), F.shiftright("p", POSITION_BITS).alias("fp"))
    short = sorted(r["size"] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect())  # nine sizes at most
    for size in short:
        words = F.split("window", " ")
        kept = kept.union(windows.where(F.col("size") == size).select("size", F.xxhash64(*[F.get(words, F.lit(j)) for j in range(size)]).alias("fp")))
    prints = written(kept.distinct(), "benchmark-prints")
    base = docs.select("doc_id", *_doc_key(text), item_words(F.col(text)).alias("w"))
    marks = [F.transform("prints", lambda p: F.struct(F.lit(WINDOW).alias("size"), p.bitwiseAND(F.lit(_LOW)).cast("int").alias("pos"), F.shiftright(p, POSITION_BITS).alias("fp")))]
    marks += [_marks(size) for size in short]
    step = with_fingerprints(base).select("doc_id", "_h", "_n", "prints", *[_grams(size).alias(f"g{size}") for size in short])
    found = spread(step.select("doc_id", "_h", "_n", F.concat(*marks).alias("marks")), F.col("marks"), "m").select("doc_id", "_h", "_n", "m.size", "m.pos", "m.fp")
    return found.join(sized(prints, FEW_NUMBERS), ["size", "fp"], "left_semi").groupBy("doc_id", "_h", "_n").agg(F.collect_set(F.struct("size", "pos")).alias("at"))


def _marks(size: int) -> Column:
    return F.transform(f"g{size}", lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("pos"), h.alias("fp")))


def _grams(size: int) -> Column:
    """Hashes of all grams of that many words; n is read beside the words, which keeps them one evaluation."""
    n = F.size("w")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: _hash("w", i, size))).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """Number of words inside the windows (start, size): sorted, each adds what lies beyond the furthest end so far."""

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], end).alias("to"))

    return F.aggregate(F.array_sort(starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"].cast("long"))


def extended(docs: DataFrame, found: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _h, _n, start, size, window: the windows around the hits that truly occur."""
    likely, _ = maybe_in(docs.select("doc_id", text), found, "doc_id")
    near = likely.select(F.col("doc_id").alias("_id"), *_doc_key(text), F.col(text).alias("_t")).withColumnsRenamed({"_h": "_th", "_n": "_tn"})
    w = near.join(found, F.expr("doc_id <=> _id AND _h = _th AND _n = _tn")).select("doc_id", "_h", "_n", "at", item_words(F.col("_t")).alias("w"))
    n = F.size("w")

    def around(x: Column) -> Column:
        first = F.when(x["size"] == WINDOW, F.greatest(F.lit(0), x["pos"] + K - WINDOW)).otherwise(x["pos"])
        last = F.least(x["pos"], n - x["size"])
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), x["size"].alias("size")))).otherwise(F.array().cast("array<struct<start:int,size:int>>"))

    starts = F.array_distinct(F.flatten(F.transform("at", around)))
    each = F.transform(starts, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice("w", x["start"] + 1, x["size"]), " ").alias("window")))
    flat = spread(w, each, "x").select("doc_id", "_h", "_n", "x.start", "x.size", "x.window")
    kinds = written(windows.select("size", "window").distinct(), "benchmark-kinds")
    return flat.join(sized(kinds, FEW_TEXTS), ["size", "window"], "left_semi")


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The windows that occur, by document and place, and the items that hold each window; both written."""
    windows = written(benchmark_windows(items), "benchmark-windows")
    found = written(hits(docs, windows, text), "benchmark-hits")
    real = written(extended(docs, found, windows, text), "occurrences")
    discard(found)
    return real, windows


def contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _h, _n, n_hit, items (sorted ids) of the contaminated documents alone, written to the shared folder. Items meet documents as pairs, once each, before they are gathered."""
    real, windows = occurrences(docs, items, text)
    doc = ["doc_id", "_h", "_n"]
    covered = real.groupBy(*doc).agg(_covered(F.collect_set(F.struct("start", "size"))).alias("n_hit"))
    pairs = real.select(*doc, "size", "window").distinct().join(sized(windows, FEW_TEXTS), ["size", "window"]).select(*doc, "item").distinct()
    held = pairs.groupBy(*doc).agg(F.array_sort(F.collect_list("item")).alias("items")).withColumnsRenamed({"doc_id": "_d", "_h": "_dh", "_n": "_dn"})
    return written(covered.join(held, F.expr("doc_id <=> _d AND _h = _dh AND _n = _dn")).select(*doc, "n_hit", "items"), "contaminated")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).withColumnsRenamed({"doc_id": "_id", "_h": "_bh", "_n": "_bn"})
    rows = docs.select("doc_id", *_doc_key("text"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    on = rows["doc_id"].eqNullSafe(bad["_id"]) & (rows["_h"] == bad["_bh"]) & (rows["_n"] == bad["_bn"])
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(bad, on, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a single occurring window; the columns of documents stay. Null, empty and wordless texts stay, also without an id; repeated rows stay or go alike; an empty table or benchmark is no error."""
    real, _ = occurrences(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = written(real.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_bh"), F.col("_n").alias("_bn")).distinct(), "contaminated")
    likely, clean = maybe_in(docs.select("doc_id", "text", "lang", "source", "n_chars"), bad.select(F.col("_id").alias("doc_id")), "doc_id")
    rows = likely.select("*", *_doc_key("text"))
    return clean.unionByName(rows.join(bad, F.expr("doc_id <=> _id AND _h = _bh AND _n = _bn"), "left_anti").select("doc_id", "text", "lang", "source", "n_chars"))


_DUCK_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {_DUCK_WORDS.format("text")} w FROM documents),
b AS (SELECT item_id::VARCHAR item, {_DUCK_WORDS.format("text")} w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) size, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, win)),
h AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + size)) p FROM (SELECT DISTINCT rid, i, size FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
