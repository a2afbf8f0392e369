"""Substring deduplication by hashing lines.

Units are lines of MIN_WORDS words or more. A passage may stand inside a longer line, or cover
lines of a few words each, so two more kinds of unit go beside them: the sentences of a line, and
where sentences or lines are short, the shortest run of consecutive ones that ends there and has
MIN_WORDS words. With unit="paragraph" the units are paragraphs (lines up to a blank one) alone.
Units are normalised (A-Z lower-cased, white space collapsed) and digested with 128 bits. Digests
are grouped over all documents; the occurrence in the least doc_id, first in its text, stays and
every other one is removed, with its offsets in the original text.

Digests meet in a partial aggregate, then the repeated ones are joined back to the units in a
join that Spark can split, so a line that a third of the corpus holds is no hot spot.

Defined results: null and empty texts have no units; rows with the same id are one document,
whose rows keep or lose a unit alike; a null id ranks last; ties within a text fall to the
earlier unit; spans of lines and of their sentences may overlap; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table, written

MIN_WORDS = 12
#: A sentence with its end, or a run of line ends and sentence ends.
UNIT = r"[^\n.!?]+[.!?]*|[\n.!?]+"
PARAGRAPH = r"(?![\x20\x09-\x0D]*(?:\n|$))[^\n]+(?:\n(?![\x20\x09-\x0D]*(?:\n|$))[^\n]+)*"
_UNIT, _LINE, _PARAGRAPH = re.compile(UNIT), re.compile(r"[^\n]+"), re.compile(PARAGRAPH)
SCHEMA = "doc_id {}, start int, end int, h1 long, h2 long, again boolean"


def _words(raw: str) -> list[bytes]:
    return raw.encode("utf-8", "surrogatepass").lower().split()


def units_of(text: str, min_words: int = MIN_WORDS, unit: str = "line") -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised form) of each unit that may be removed."""
    if unit == "paragraph":
        for m in _PARAGRAPH.finditer(text):
            if len(w := _words(m.group())) >= min_words:
                yield m.start(), m.end(), b" ".join(w)
        return
    short: list[tuple[int, int, bytes]] = []  # the latest short pieces: start, words, normalised form
    for line in _LINE.finditer(text):
        pieces = 0
        for m in _UNIT.finditer(text, *line.span()):
            raw = m.group()
            if raw[0] in ".!?" or not (w := _words(raw)):
                continue
            pieces += 1
            if len(w) >= min_words:
                short.clear()
                yield m.start(), m.end(), b" ".join(w)
                continue
            short.append((m.start(), len(w), b" ".join(w)))
            n = 0
            for k in range(len(short) - 1, -1, -1):
                n += short[k][1]
                if n >= min_words:
                    del short[:k]
                    yield short[0][0], m.end(), b"\n".join(x[2] for x in short)
                    break
        if pieces > 1 and len(w := _words(line.group())) >= min_words:
            yield line.start(), line.end(), b" ".join(w)


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """doc_id, start, end (code points), h1, h2 and again (an earlier unit of the same text has this digest)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for i, body in enumerate(batch.column(1)):
                seen: set[int] = set()
                for start, end, norm in units_of(body.as_py() or "", min_words, unit):
                    h = xxhash.xxh3_128_intdigest(norm)
                    rows.append((i, start, end, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), h in seen))
                    seen.add(h)
                    if len(rows) > 50_000:
                        yield _batch(ids, rows)
                        rows = []
            if rows:
                yield _batch(ids, rows)

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(narrow, task, SCHEMA.format(narrow.schema["doc_id"].dataType.simpleString()))


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, *rest = zip(*rows, strict=True)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(rest, kinds, strict=True)]], names=["doc_id", "start", "end", "h1", "h2", "again"])


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """doc_id, start, end, kept_in: every unit to remove and the document that keeps its first occurrence."""
    every = written(units(docs, key, text, min_words, unit), "units")
    ranks = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("kept_in"), F.count(F.lit(1)).alias("n"))
    many = written(ranks.where("n > 1").select("h1", "h2", "kept_in"), "repeated_units")  # a table, so that Spark can split the join of a frequent unit
    met = every.join(many, ["h1", "h2"])
    return met.where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("kept_in"))).select("doc_id", "start", "end", "kept_in")


def without(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """docs with the given spans cut out of their texts. A document's own spans meet in one row; overlapping ones are cut once. What stays is cut from the text by the ends of the furthest span so far, as a running window over the spans."""
    w = Window.partitionBy("__unit_id").orderBy("start", "end")
    reach = gone.select(F.col("doc_id").alias("__unit_id"), "start", "end").distinct().withColumn("before", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = reach.where("end > before").groupBy("__unit_id").agg(F.array_sort(F.collect_list(F.struct("before", "start", "end"))).alias("__unit_gone"))
    body, gaps = F.col(text), F.col("__unit_gone")
    kept = F.transform(gaps, lambda s: F.substring(body, s["before"] + 1, F.greatest(F.lit(0), s["start"] - s["before"])))
    cut = F.concat(F.array_join(kept, ""), F.substring(body, F.get(gaps, F.size(gaps) - 1)["end"] + 1, F.length(body)))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["__unit_id"]), "left")
    return joined.withColumn(text, F.when(gaps.isNull(), body).otherwise(cut)).drop("__unit_id", "__unit_gone")


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated unit of all documents beyond its first occurrence."""
    return removals(table(spark, sf_dir, "documents"))


_DUCK_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT rid, doc_id, unnest(parts) part, generate_subscripts(parts, 1) k FROM (SELECT rid, doc_id, regexp_extract_all(text, '{UNIT}') parts FROM d)),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT s FROM p),
n AS (SELECT *, s + length(part) e, {_DUCK_WORDS.format("part")} w FROM o WHERE NOT regexp_matches(part, '^[\n.!?]')),
q AS (SELECT *, len(w) c, array_to_string(w, ' ') norm, row_number() OVER x i, sum((len(w) >= {MIN_WORDS})::INT) OVER x run, sum(len(w)) OVER x total FROM n WHERE len(w) > 0 WINDOW x AS (PARTITION BY rid ORDER BY k)),
a AS (SELECT q.rid, q.i, max(j.i) f FROM q, (SELECT unnest(range({MIN_WORDS})) g), q j
  WHERE q.c < {MIN_WORDS} AND j.rid = q.rid AND j.i = q.i - g AND j.run = q.run AND j.c < {MIN_WORDS} AND q.total - j.total + j.c >= {MIN_WORDS} GROUP BY ALL),
r AS (SELECT a.rid, any_value(j.doc_id) doc_id, min(j.s) s, max(j.e) e, string_agg(j.norm, chr(10) ORDER BY j.i) f FROM a JOIN q j ON j.rid = a.rid AND j.i BETWEEN a.f AND a.i GROUP BY a.rid, a.i),
b AS (SELECT rid, doc_id, unnest(lines) line, generate_subscripts(lines, 1) k FROM (SELECT rid, doc_id, string_split(text, chr(10)) lines FROM d)),
z AS (SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT s, {_DUCK_WORDS.format("line")} w,
  len(list_filter(regexp_extract_all(line, '{UNIT}'), lambda x: NOT regexp_matches(x, '^[.!?]') AND regexp_matches(x, '[^\x20\x09-\x0D]'))) pieces FROM b),
u AS (SELECT rid, doc_id, s, e, norm f, 0 o FROM q WHERE c >= {MIN_WORDS} UNION ALL SELECT *, 0 FROM r
  UNION ALL SELECT rid, doc_id, s, s + length(line), array_to_string(w, ' '), 1 FROM z WHERE pieces > 1 AND len(w) >= {MIN_WORDS}),
v AS (SELECT *, min(doc_id) OVER (PARTITION BY f) kept_in, row_number() OVER (PARTITION BY rid, f ORDER BY e, o) nth FROM u)
SELECT doc_id, s "start", e "end", kept_in FROM v WHERE nth > 1 OR doc_id IS DISTINCT FROM kept_in
"""
