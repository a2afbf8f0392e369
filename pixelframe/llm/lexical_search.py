"""Ranked lexical search over an inverted index with block maxima.

The index lies in the shared folder as a table of posting lists. Documents are dealt into
shards of a bounded number of words; a shard's list of a term is cut into blocks of 128
postings, each compressed by itself (gaps between documents and frequencies in one, two or four
bytes, whichever hold the block's largest) and described by its first and last document and its
maximum impact, the largest part that this term can add to a score there, before its weight.

A search meets the shards one after the other and keeps each query's best k. Shallow moves look
at block descriptions alone: for each window of 2,048 documents they add up the weighted maxima
of all lists; a window whose sum is below the k-th best score is skipped whole. In the others,
lists are taken from the highest bound down until those left can't lift a document to the k-th
best score by themselves: documents in none of the lists taken need no look (the pivot test of
WAND, for a window at once). For the documents met so far the lists left follow, highest bound
first; a block of theirs is decompressed only if one of the documents inside still reaches the
threshold with the block's maximum and the bounds of what follows. Scores are exact integers;
a bound equal to the threshold is looked at, as ties go by id. Windows with the highest
bounds come first.

Queries are handled in blocks of 512, each with a pass over the lists of its terms; the lists
of a shard reach one task, its best k of each query leave it.

Defined results: null, empty and wordless documents have no terms and are never found; rows of
documents that share an id are documents of their own; a null doc_id stands last among equal
scores; rows of queries that share an id are one query with the terms of all; queries without
terms, or with terms that no document holds, have no rows; terms that every document holds
weigh 0 and find nothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sized, table, written
from .decontaminate import item_words
from .wordbytes import Numbers, lots, words_of

TOP, BLOCK, WINDOW = 10, 128, 2048
#: A shard ends at so many words or documents; queries of one pass.
SHARD_WORDS, SHARD_DOCS, QUERY_ROWS = 1 << 22, 1 << 15, 512
SCALE = 1_000_000_000

#: A block of postings: documents at its ends, maximum impact, place in the payload, bytes of a gap and of a frequency.
META = np.dtype([("first", "<i4"), ("last", "<i4"), ("peak", "<i4"), ("at", "<i4"), ("gap", "u1"), ("tf", "u1")])
ENTRY = "shard long, term string, df long, meta binary, payload binary"


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            column = b.column(text).cast(pa.large_binary())
            sizes = [len(words_of(x.as_py())) for x in column]
            n += sum(map(bool, sizes))
            total += sum(sizes)
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = map_batches(docs.select(text), task, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of a document's length in the score, m."""
    if 90 * int(sizes.max(initial=0)) * n < 1 << 63:
        return 10 + 90 * sizes * n // max(1, total)
    return np.array([10 + 90 * int(s) * n // max(1, total) for s in sizes], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


def _widths(top: np.ndarray) -> np.ndarray:
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)).astype(np.uint8)


def _store(buffer: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian values of their widths at their places."""
    for byte in range(4):
        has = width > byte
        buffer[at[has] + byte] = (values[has] >> (8 * byte)) & 255


def postings(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of postings sorted by term and document: META rows, payload, and for each term its first block and first byte (with an end)."""
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(starts, len(term)))
    per = -(-df // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(per)])
    begin = np.repeat(starts, per) + BLOCK * (np.arange(first_block[-1]) - np.repeat(first_block[:-1], per))
    size = np.diff(np.append(begin, len(term)))
    block = np.repeat(np.arange(len(begin)), size)
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    meta = np.zeros(len(begin), META)
    meta["first"], meta["last"] = doc[begin], doc[begin + size - 1]
    meta["peak"] = np.maximum.reduceat(impact(tf, m[doc]), begin)
    meta["gap"], meta["tf"] = _widths(np.maximum.reduceat(gap, begin)), _widths(np.maximum.reduceat(tf, begin))
    bytes_ = size * (meta["gap"].astype(np.int64) + meta["tf"])
    at = np.concatenate([[0], np.cumsum(bytes_)])
    payload = np.zeros(at[-1], np.uint8)
    within = np.arange(len(term)) - begin[block]
    gw, tw = meta["gap"][block].astype(np.int64), meta["tf"][block].astype(np.int64)
    _store(payload, at[:-1][block] + within * gw, gap, gw)
    _store(payload, at[:-1][block] + size[block] * gw + within * tw, tf, tw)
    first_byte = at[first_block]
    meta["at"] = at[:-1] - np.repeat(first_byte[:-1], per)
    return meta, payload, first_block, first_byte


def decoded(entry: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of a list's block k."""
    df, meta, payload = entry
    b = meta[k]
    n, gw, tw, at = min(BLOCK, df - k * BLOCK), int(b["gap"]), int(b["tf"]), int(b["at"])
    docs = b["first"] + np.cumsum(np.frombuffer(payload, f"<u{gw}", n, at), dtype=np.int64)
    return docs, np.frombuffer(payload, f"<u{tw}", n, at + n * gw).astype(np.int64)


def _binary(buffer: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buffer))]).cast(pa.binary())


def _shard(number: int, vocabulary: list[bytes], ids: np.ndarray, sizes: np.ndarray, keys: list[int | None], n: int, total: int) -> Iterator[pa.RecordBatch]:
    names = ["shard", "term", "df", "meta", "payload"]
    docs = len(sizes)
    null = np.array([k is None for k in keys], np.uint8)
    head = np.array([0 if k is None else k for k in keys], np.int64).tobytes() + null.tobytes()
    m = lengths(sizes, n, total)
    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([""]), pa.array([docs]), pa.array([m.tobytes()]), pa.array([head])], names)
    if not len(ids):
        return
    pairs = np.sort(ids.astype(np.int64) * docs + np.repeat(np.arange(docs), sizes))
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    term, doc = pairs[starts] // docs, pairs[starts] % docs
    tf = np.diff(np.append(starts, len(pairs)))
    meta, payload, first_block, first_byte = postings(term, doc, tf, m)
    df = np.bincount(term)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(df), number)), pa.array(vocabulary, pa.binary()).cast(pa.string()), pa.array(df), _binary(meta.view(np.uint8), first_block * META.itemsize), _binary(payload, first_byte)], names
    )


def build_index(docs: DataFrame, n: int, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every term of every document, written: a row for each term of a shard, and one with an empty term for its documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        numbers, held, sizes, keys, count = Numbers(), [], [], [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            if keys:
                yield from _shard(number, list(numbers), np.concatenate(held), np.concatenate(sizes), keys, n, total)

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, words, size in lots(b, text):
                if keys and (count + len(words) > SHARD_WORDS or len(keys) + len(size) > SHARD_DOCS):
                    yield from shard()
                    number, numbers, held, sizes, keys, count = number + 1, Numbers(), [], [], [], 0
                held.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                sizes.append(size)
                keys += ids[first : first + len(size)]
                count += len(words)
        yield from shard()

    return written(map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text), task, ENTRY), "lexical-index")


class Best:
    """The best k so far: scores downwards, then ids upwards, nulls last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.key = k, np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score can't enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, key: np.ndarray) -> None:
        score, null, key = np.append(self.score, score), np.append(self.null, null), np.append(self.key, key)
        order = np.lexsort((key, null, -score))[: self.k]
        self.score, self.null, self.key = score[order], null[order], key[order]


class Shard:
    """The documents and the posting lists of one shard; `opened` counts decompressed blocks."""

    def __init__(self, docs: int, m: bytes, head: bytes):
        self.docs, self.m = docs, np.frombuffer(m, np.int64)
        self.keys, self.null = np.frombuffer(head, np.int64, docs), np.frombuffer(head, np.uint8, docs, 8 * docs)
        self.windows = -(-docs // WINDOW)
        self.lists: dict[int, tuple] = {}
        self.peaks: dict[int, np.ndarray] = {}
        self.blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def add(self, term: int, df: int, meta: bytes, payload: bytes) -> None:
        self.lists[term] = df, (rows := np.frombuffer(meta, META)), payload
        peaks = np.zeros(self.windows, np.int64)
        lo, hi = rows["first"] // WINDOW, rows["last"] // WINDOW
        np.maximum.at(peaks, lo, rows["peak"])
        for k in np.flatnonzero(hi > lo):
            peaks[lo[k] : hi[k] + 1] = np.maximum(peaks[lo[k] : hi[k] + 1], rows["peak"][k])
        self.peaks[term] = peaks

    def block(self, term: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed at its first use."""
        if (got := self.blocks.get((term, k))) is None:
            docs, tf = decoded(self.lists[term], k)
            got = self.blocks[term, k] = docs, impact(tf, self.m[docs])
            self.opened += 1
        return got

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        here = [i for i, t in enumerate(terms.tolist()) if t in self.lists]
        if not here:
            return
        terms, weights = terms[here], weights[here]
        bounds = weights[:, None] * np.array([self.peaks[t] for t in terms.tolist()])
        total = bounds.sum(axis=0)
        for j in np.argsort(-total, kind="stable").tolist():
            if total[j] < best.least:
                break
            self._window(j, terms, weights, bounds[:, j], best)

    def _window(self, j: int, terms: np.ndarray, weights: np.ndarray, bound: np.ndarray, best: Best) -> None:
        start = j * WINDOW
        end, least = min(self.docs, start + WINDOW), best.least
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        below = np.cumsum(bound[order])
        pivot = int(np.searchsorted(below, least))  # the lists before it can't reach the threshold together
        score = np.zeros(end - start, np.int64)
        for i in order[pivot:].tolist():
            term = int(terms[i])
            rows = self.lists[term][1]
            lo, hi = np.searchsorted(rows["last"], start), np.searchsorted(rows["first"], end)
            for k in range(lo, hi):
                docs, part = self.block(term, k)
                if docs[0] < start or docs[-1] >= end:
                    inside = slice(*np.searchsorted(docs, (start, end)))
                    docs, part = docs[inside], part[inside]
                score[docs - start] += weights[i] * part
        met = np.flatnonzero(score)
        for place in range(pivot - 1, -1, -1):
            met = met[score[met] + below[place] >= least]
            if not len(met):
                return
            i, rest = order[place], below[place - 1] if place else 0
            term = int(terms[i])
            rows = self.lists[term][1]
            where = np.searchsorted(rows["last"], met + start)
            can = where < len(rows)
            can[can] &= (rows["first"][where[can]] <= met[can] + start) & (score[met[can]] + weights[i] * rows["peak"][where[can]].astype(np.int64) + rest >= least)
            for k in np.unique(where[can]).tolist():
                docs, part = self.block(term, k)
                mine = met[can & (where == k)] + start
                at = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                hit = docs[at] == mine
                score[mine[hit] - start] += weights[i] * part[at[hit]]
        met = met[score[met] >= least] + start
        if len(met):
            best.add(score[met - start], self.null[met], self.keys[met])


def _weights(index: DataFrame, wanted: DataFrame, n: int) -> dict[str, int]:
    """Weight of each wanted term that a document holds."""
    df = index.join(sized(wanted, 1_000_000), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in df.collect()}


def search_block(index: DataFrame, queries: list[tuple[int, list[str]]], n: int, top: int = TOP) -> DataFrame:
    """query, rank, doc_id, score for one block of queries (number, terms), written."""
    spark = index.sparkSession
    distinct = sorted({t for _, terms in queries for t in terms})
    wanted = written(spark.createDataFrame([(t,) for t in distinct], "term string"), "query-terms")
    weight = _weights(index, wanted, n)
    number = {t: i for i, t in enumerate(distinct)}
    asked = []
    for q, terms in queries:
        of = sorted(number[t] for t in set(terms) if weight.get(t, 0) > 0)
        asked.append((q, np.array(of, np.int64), np.array([weight[distinct[i]] for i in of], np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked]
        shard, at = None, None

        def done() -> None:
            for (_, terms, weights), b in zip(asked, best, strict=True):
                shard.search(terms, weights, b)

        for b in batches:
            names, shards, df, meta, payload = (b.column(c) for c in ("term", "shard", "df", "meta", "payload"))
            for k in range(b.num_rows):
                if (s := shards[k].as_py()) != at:
                    if shard:
                        done()
                    shard, at = Shard(df[k].as_py(), meta[k].as_py(), payload[k].as_py()), s
                else:
                    shard.add(number[names[k].as_py()], df[k].as_py(), meta[k].as_py(), payload[k].as_py())
        if shard:
            done()
        out = [(q, None if null else key, score) for (q, _, _), b in zip(asked, best, strict=True) for score, null, key in zip(b.score.tolist(), b.null.tolist(), b.key.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "doc_id", "score"])

    terms = wanted.union(spark.createDataFrame([("",)], "term string"))
    shuffled = index.join(sized(written(terms, "query-terms"), 1_000_000), "term", "left_semi").repartition("shard").sortWithinPartitions("shard", "term")
    found = map_batches(shuffled.select("shard", "term", "df", "meta", "payload"), task, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "lexical-best")


def search(index: DataFrame, queries: DataFrame, n: int, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """key, rank, doc_id, score: the best documents of each query."""
    spark = index.sparkSession
    terms = queries.select(key, F.explode(item_words(F.col(text))).alias("term")).groupBy(key).agg(F.collect_set("term").alias("terms"))
    kind, rows, found = queries.schema[key].dataType.simpleString(), written(terms, "queries").toLocalIterator(), []
    while block := list(islice(rows, QUERY_ROWS)):
        best = search_block(index, [(i, r["terms"]) for i, r in enumerate(block)], n, top)
        names = spark.createDataFrame([(i, r[key]) for i, r in enumerate(block)], f"query long, `{key}` {kind}")
        found.append(best.join(F.broadcast(names), "query").select(key, "rank", "doc_id", "score"))  # 512 rows
    if not found:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, total = corpus_size(docs)
    return search(build_index(docs, n, total), table(spark, sf_dir, "benchmark").select("item_id", "text"), n)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {_TERMS} w FROM documents),
s AS (SELECT count(*)::BIGINT n, sum(len(w))::BIGINT total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) term FROM benchmark),
p AS (SELECT rid, term, count(*)::BIGINT tf FROM (SELECT rid, unnest(w) term FROM d) GROUP BY rid, term),
f AS (SELECT term, count(*)::BIGINT df FROM p GROUP BY term),
g AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT w FROM f, s),
m AS (SELECT rid, doc_id, 10 + (90 * len(w) * n) // total m FROM d, s),
x AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM q JOIN p USING (term) JOIN g USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank::INTEGER rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) rank FROM x WHERE score > 0) WHERE rank <= {TOP}
"""
