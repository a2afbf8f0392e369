"""Importance resampling towards a target distribution.

Every text is a bag of hashed features, its runs of one or two words; the counts of all
documents and of the target's texts give each of 10,000 buckets a gain, the logarithm of the
ratio of its smoothed frequencies. A document's weight is the mean gain of its features,
looked up in an array; a Gumbel variate drawn from its id makes the highest scores a sample
without replacement, in proportion to the exponents of the weights.

The draw is a sort that stops early:

1. each task sorts its eligible documents into runs, stored in the shared folder as blocks of
   1,024 rows;
2. rows taken from all runs at regular steps cut the order into ranges of about equal size;
   ranges are counted over all blocks, so every range knows the rank of its first row and
   those beyond the draw are never merged;
3. a range's pieces of blocks reach one task in the order of their heads. A block is opened
   when the merge reaches its head, so at most one block of each run is open, and a tournament
   tree over the open blocks gives the next row. The merge ends with the draw's last row; the
   rest of that range leaves unsorted and without rank.

Features are counted as CRC-32 of their bytes. That of a pair follows from those of its words,
as CRC is linear, so each distinct word is hashed once and pairs by table look-ups.

Defined results: null, empty and wordless texts have no features, weight 0 and are not
eligible, but get a score; a null doc_id hashes as the empty string and stands last among
equal scores; repeated rows are documents of their own, those with the same id and text get
neighbouring ranks in any order; an empty corpus gives no rows, an empty target uses its
smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .wordbytes import Numbers, lots

BUCKETS = 10_000
MIN_WORDS, DRAW_PERCENT, SEED = 20, 25, 7
#: Rows of a run, of a block, and of a range at most (about). One row in each SAMPLE_STEP helps to cut ranges; with more than SAMPLED blocks, those of some blocks at regular steps.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, SAMPLE_STEP, SAMPLED = 1 << 17, 1 << 10, 1 << 20, 64, 1 << 13
#: Distinct words whose hashes a task remembers, and bytes of a word up to which pairs go through tables.
VOCABULARY, TABLE_BYTES = 1 << 20, 255

ROWS = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])
LISTS = ("doc_id", "n_features", "weight", "score")


@cache
def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) that carry a CRC-32 past so many more bytes: one for each of its bytes."""
    zeros = bytes(length)
    base = zlib.crc32(zeros, 0)
    bits = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(bits[8 * byte + bit])
    return out


class Features:
    """Buckets of the features of texts. Words are numbered on first sight and hashed once."""

    def __init__(self):
        self._forget()
        self.tables = np.stack([_shift(1 + n) for n in range(TABLE_BYTES + 1)]).reshape(-1)

    def _forget(self) -> None:
        self.numbers, self.known = Numbers(), 0
        self.words: list[bytes] = []
        self.crc, self.after, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = list(self.numbers)[self.known :]
        if new:
            self.words += new
            self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in new], np.uint32))
            self.after = np.append(self.after, np.array([zlib.crc32(b" " + w) for w in new], np.uint32))
            self.size = np.append(self.size, np.array([len(w) for w in new], np.int64))
            self.known = len(self.numbers)

    def buckets(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words; those of all pairs inside a text; pairs of each text."""
        if len(self.numbers) > VOCABULARY:
            self._forget()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        pairs = np.maximum(sizes - 1, 0)
        inside = np.ones(max(0, len(words) - 1), bool)
        ends = np.cumsum(sizes)[:-1]
        inside[ends[(ends > 0) & (ends < len(words))] - 1] = False
        one, two = at[:-1][inside], at[1:][inside]
        c, base = self.crc[one], np.minimum(self.size[two], TABLE_BYTES) << 10
        t = self.tables
        crc = t[base + (c & 255)] ^ t[base + (256 + ((c >> 8) & 255))] ^ t[base + (512 + ((c >> 16) & 255))] ^ t[base + (768 + (c >> 24))] ^ self.after[two]
        for k in np.flatnonzero(self.size[two] > TABLE_BYTES):
            crc[k] = zlib.crc32(b" " + self.words[two[k]], int(c[k]))
        return self.crc[at] % BUCKETS, crc % BUCKETS, pairs


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all texts; at most 10,000 sums reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = Features(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, words, sizes in lots(b, text):
                one, two, _ = f.buckets(words, sizes)
                total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in map_batches(docs.select(text), task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithm of the ratio of smoothed frequencies, for each bucket."""
    s, t = float(documents.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


BLOCK = "run long, seq long, eligible boolean, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>"


def _nulls_last(ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    null = np.array([i is None for i in ids], bool)
    return np.array([0 if i is None else i for i in ids], np.int64), null


def scored_runs(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with their scores in blocks; those that are eligible in sorted runs (highest score first, then smaller id), written."""

    def cut(run: int, columns: list, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, null = _nulls_last(columns[0])
        features, weight, score = (np.array(c, np.int64) for c in columns[1:])
        order = np.lexsort((features, ids, null, -score))
        for eligible in (True, False):
            chosen = order[(sizes[order] >= MIN_WORDS) == eligible]
            starts = np.arange(0, len(chosen), BLOCK_ROWS)
            if not len(starts):
                continue
            offsets = pa.array(np.append(starts, len(chosen)), pa.int32())
            values = [pa.array(ids[chosen], mask=null[chosen]), pa.array(features[chosen]), pa.array(weight[chosen]), pa.array(score[chosen])]
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array([eligible] * n), *[pa.ListArray.from_arrays(offsets, v) for v in values]], ["run", "seq", "eligible", *LISTS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, run = Features(), TaskContext.get().partitionId() << 24
        held, sizes = [[], [], [], []], []
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, words, n in lots(b, text):
                one, two, pairs = f.buckets(words, n)
                total = np.zeros(len(n), np.int64)
                for buckets, count in ((one, n), (two, pairs)):
                    sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                    ends = np.cumsum(count)
                    total += sums[ends] - sums[ends - count]
                weight = total // np.maximum(n + pairs, 1)
                held[0] += ids[first : first + len(n)]
                held[1] += (n + pairs).tolist()
                held[2] += weight.tolist()
                held[3] += [w + gumbel(i) for w, i in zip(weight.tolist(), ids[first : first + len(n)], strict=True)]
                sizes += n.tolist()
            if len(sizes) >= RUN_ROWS:
                yield from cut(run, held, np.array(sizes))
                held, sizes, run = [[], [], [], []], [], run + 1
        yield from cut(run, held, np.array(sizes, np.int64))

    return written(map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text), task, BLOCK), "resampling-runs")


Key = tuple[int, bool, int, int, int, int]


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one by one, as their lists are long."""
    for k in range(batch.num_rows):
        yield from batch.slice(k, 1).to_pylist()


def keys_of(block: dict, step: int = 1) -> list[Key]:
    """A block's places in the order: score downwards, null ids last, id, features, and run and place for rows that agree in all."""
    return [(-s, i is None, i or 0, n, block["run"], block["seq"] + step * k) for k, (s, i, n) in enumerate(zip(block["score"], block["doc_id"], block["n_features"], strict=True))]


class Tournament:
    """Winners' tree over numbered leaves; an empty leaf loses against all."""

    EMPTY = (math.inf,)

    def __init__(self):
        self.keys, self.tree, self.half = [self.EMPTY], [0, 0], 1

    def put(self, leaf: int, key: tuple) -> None:
        if leaf >= self.half:
            while leaf >= self.half:
                self.half *= 2
            self.keys += [self.EMPTY] * (self.half - len(self.keys))
            self.tree = [0] * self.half + list(range(self.half))
            for node in range(self.half - 1, 0, -1):
                self._play(node)
        self.keys[leaf] = key
        node = (leaf + self.half) >> 1
        while node:
            self._play(node)
            node >>= 1

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = a if self.keys[a] <= self.keys[b] else b

    def winner(self) -> tuple[int, tuple, tuple]:
        """Leaf and key of the winner, and the best key that it beat."""
        leaf = self.tree[1]
        second, node = self.EMPTY, leaf + self.half
        while node > 1:
            second = min(second, self.keys[self.tree[node ^ 1]])
            node >>= 1
        return leaf, self.keys[leaf], second


def merged(blocks: Iterator[dict], wanted: int) -> Iterator[tuple[dict, int, int, bool]]:
    """(block, from, to, drawn): pieces of blocks, which come in the order of their heads, so that the drawn pieces make the first `wanted` rows in order."""
    tree, leaves, free, open_ = Tournament(), {}, [], {}
    given = 0

    def upto(bound: tuple) -> Iterator[tuple[dict, int, int, bool]]:
        nonlocal given
        while given < wanted:
            leaf, key, second = tree.winner()
            if key >= bound:
                return
            block, keys, at = open_[leaf]
            end = min(bisect_left(keys, min(second, bound), at), at + wanted - given)
            given += end - at
            yield block, at, end, True
            if end < len(keys):
                open_[leaf] = block, keys, end
                tree.put(leaf, keys[end])
            else:
                del open_[leaf], leaves[block["run"]]
                free.append(leaf)
                tree.put(leaf, tree.EMPTY)

    for block in blocks:
        if given < wanted:
            keys = keys_of(block)
            yield from upto(keys[0])
        if given >= wanted:
            yield block, 0, len(block["score"]), False
            continue
        leaf = leaves[block["run"]] = free.pop() if free else len(open_)
        open_[leaf] = block, keys, 0
        tree.put(leaf, keys[0])
    yield from upto(tree.EMPTY)
    for block, keys, at in open_.values():
        yield block, at, len(keys), False


def _pieces(block: dict, splitters: list[Key]) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of a block that splitters cut."""
    keys, at = keys_of(block), 0
    part = bisect_left(splitters, (*keys[0][:5], keys[0][5] + 1))
    while at < len(keys):
        end = bisect_left(keys, splitters[part], at) if part < len(splitters) else len(keys)
        if end > at:
            yield part, at, end
        part, at = part + 1, end


def _output(pieces: list[tuple[dict, int, int, int | None]]) -> pa.RecordBatch:
    columns = [[x for b, i, j, _ in pieces for x in b[c][i:j]] for c in LISTS]
    ranks = [None if r is None else r + k for _, i, j, r in pieces for k in range(j - i)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, ranks)], schema=ROWS)


def _in_lots(pieces: Iterator[tuple[dict, int, int, int | None]]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for p in pieces:
        held.append(p)
        rows += p[2] - p[1]
        if rows >= 8 * BLOCK_ROWS:
            yield _output(held)
            held, rows = [], 0
    if held:
        yield _output(held)


def drawn(runs: DataFrame, percent: int = DRAW_PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents in the blocks of scored_runs()."""
    spark = runs.sparkSession
    eligible = runs.where("eligible")
    total, blocks = eligible.agg(F.coalesce(F.sum(F.size("score")), F.lit(0)), F.count(F.lit(1))).first()
    wanted = percent * total // 100
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    step = max(1, blocks // SAMPLED)
    number = (F.col("seq") / BLOCK_ROWS).cast("long")
    middle = F.least(F.lit(SAMPLE_STEP // 2), (F.size("score") / 2).cast("int"))
    seen = [F.filter(c, lambda x, i: i % SAMPLE_STEP == middle).alias(c) for c in LISTS]
    some = eligible.where((number + F.shiftright("run", 24)) % step == 0).select("run", (F.col("seq") + middle).alias("seq"), *seen).collect()
    some = sorted(k for r in some for k in keys_of(r.asDict(), SAMPLE_STEP))
    splitters = sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(splitters) + 1, np.int64)
        for b in batches:
            for block in _blocks(b):
                for part, i, j in _pieces(block, splitters):
                    n[part] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["part", "n"])

    sizes = {r["part"]: r["n"] for r in map_batches(eligible, counted, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, first = 0, {}
    for part in range(len(splitters) + 1):
        first[part] = before
        before += sizes.get(part, 0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for block in _blocks(b):
                for part, i, j in _pieces(block, splitters):
                    rows.append({"part": part, "run": block["run"], "seq": block["seq"] + i, **{c: block[c][i:j] for c in LISTS}})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PIECES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def streamed() -> Iterator[dict]:
            for b in batches:
                yield from _blocks(b)

        def ranked() -> Iterator[tuple[dict, int, int, int | None]]:
            stream = streamed()
            block = next(stream, None)
            while block is not None:
                part, rank = block["part"], first[block["part"]] + 1

                def same(part: int = part) -> Iterator[dict]:
                    nonlocal block
                    while block is not None and block["part"] == part:
                        yield block
                        block = next(stream, None)

                for b, i, j, hit in merged(same(), wanted - first[part]):
                    yield b, i, j, rank if hit else None
                    rank += j - i

        return _in_lots(ranked())

    pieces = map_batches(eligible.select("run", "seq", *LISTS), dealt, "part long, run long, seq long, " + ", ".join(f"{c} array<long>" for c in LISTS))
    last = max((p for p in first if first[p] < wanted), default=-1)
    head = [F.col("part"), F.get("score", F.lit(0)).desc(), F.get("doc_id", F.lit(0)).asc_nulls_last(), F.get("n_features", F.lit(0)), F.col("run"), F.col("seq")]
    in_order = pieces.where(F.col("part") <= last).repartition(ranges, "part").sortWithinPartitions(*head)
    kind = "doc_id long, n_features long, weight long, score long, rank long"
    rest = pieces.where(F.col("part") > last).select(*LISTS).unionByName(runs.where("NOT eligible").select(*LISTS))
    undrawn = rest.select(F.explode(F.arrays_zip(*LISTS)).alias("x")).select("x.*", F.lit(None).cast("long").alias("rank"))
    return map_batches(in_order, merge, kind).unionByName(undrawn)


PIECES = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("seq", pa.int64()), *[(c, pa.list_(pa.int64())) for c in LISTS]])


def op11_tournament_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark").select("text")))
    return drawn(scored_runs(docs, gain))
