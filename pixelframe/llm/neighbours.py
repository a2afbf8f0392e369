"""Approximate nearest neighbours by counting collisions.

Every vector is projected onto 64 random lines. A block of 4,096 vectors is stored with its
projections, sorted for each line, beside the vectors themselves: that is the index, a table in
the shared folder. A query opens a window around its own projection on every line; a vector
inside the windows of enough lines is a candidate, and its distance is computed. Windows grow
with a radius (virtual rehashing: the arrays stay, only the ends of the windows move, and only
what they take in is counted) until the radius reaches the distance of the k-th best vector.

A vector at distance r lies in one line's window of half-width 0.8 R, R >= r, with probability
0.576 at least, whatever the data, so the threshold of 27 lines in 64 misses it about once in a
hundred times. No number of candidates ends a search. Where distances hardly differ, as among
random directions, most vectors pass the threshold, and the search becomes a scan.

Equal vectors of a block are one candidate with all its ids, and equal queries are one search.
A task carries its k-th best distances from block to block, so all but its first block take one
round. Queries are handled in blocks of 4,096, each with a pass over the index; the best of all
tasks are merged by a window over a few rows a query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id; queries meet vectors of their own length alone; every row
is a vector of its own, so rows that repeat an id or a vector are neighbours of each other, and
a repeated query row gives its rows again; with fewer than k others all of them are found;
without queries or vectors there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written, written_batches

TOP, QUERY_MODULUS = 10, 100
LINES, SEED = 64, 13
#: Half-width of a window for a radius of one, standard deviations between the expected collisions at that radius and the threshold, and growth of the radius.
HALF, SURE, GROWTH = 0.8, 2.33, 1.25
#: Vectors of an index row, index rows of an Arrow batch, and queries of one pass.
BLOCK, BATCH, QUERY_ROWS = 4096, 4, 4096
INDEX = "block long, dims int, n int, ids binary, counts binary, vectors binary, places binary, orders binary"


def threshold(lines: int = LINES) -> int:
    p = math.erf(HALF / math.sqrt(2))
    return math.floor(lines * p - SURE * math.sqrt(lines * p * (1 - p)))


def lines_of(dims: int) -> np.ndarray:
    """dims x LINES standard normal numbers, the same in every task."""
    return np.random.default_rng([SEED, dims]).standard_normal((dims, LINES))


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows that take part, for each length of vector."""
    ids, column = batch.column(0), batch.column(1)
    if not batch.num_rows:
        return
    starts = np.asarray(column.offsets, dtype=np.int64)
    sizes = np.where(np.asarray(column.is_valid()) & np.asarray(ids.is_valid()), np.diff(starts), 0)
    flat = column.values.to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        m = flat[starts[rows][:, None] + np.arange(n)].astype(flat.dtype if flat.dtype.kind == "f" else np.float64)
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if good.any():
            yield keys[rows[good]], m[good]


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the distinct rows of m, and the class of each row."""
    rows = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    return first, of


def index_row(block: int, ids: np.ndarray, m: np.ndarray) -> dict:
    """A block: its distinct vectors in double precision, their ids, and their sorted projections."""
    first, of = _distinct(m)
    order = np.lexsort((ids, of))
    v = m[first].astype(np.float64)
    p = np.ascontiguousarray((v @ lines_of(v.shape[1])).T)
    orders = np.argsort(p, axis=1)
    return {
        "block": block, "dims": v.shape[1], "n": len(v), "ids": ids[order].astype(np.int64).tobytes(), "counts": np.bincount(of).astype(np.int32).tobytes(),
        "vectors": m[first].tobytes() if m.dtype == np.float32 else v.tobytes(), "places": np.take_along_axis(p, orders, axis=1).tobytes(), "orders": orders.astype(np.uint16).tobytes(),
    }


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index of all vectors, written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, defaultdict(list)

        def row(parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([index_row(number, np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts]))], schema=SCHEMA)

        for b in batches:
            for ids, m in vectors_of(b):
                for at in range(0, len(ids), BLOCK):
                    parts = held[m.shape[1]]
                    parts.append((ids[at : at + BLOCK], m[at : at + BLOCK]))
                    if sum(len(i) for i, _ in parts) + BLOCK_STEP > BLOCK:
                        yield row(held.pop(m.shape[1]))
        for parts in held.values():
            yield row(parts)

    return written_batches(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), task, INDEX, "neighbour-index", BLOCK_STEP)


#: Rows of an Arrow batch while the index is built; blocks end before they could outgrow their bound.
BLOCK_STEP = 1000
SCHEMA = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "counts", "vectors", "places", "orders")]])


class Block:
    """One block of the index."""

    def __init__(self, row: dict):
        n, self.dims = row["n"], row["dims"]
        kind = np.float32 if len(row["vectors"]) == 4 * n * self.dims else np.float64
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, self.dims).astype(np.float64)
        self.ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.places, self.orders = np.frombuffer(row["places"], np.float64).reshape(LINES, n), np.frombuffer(row["orders"], np.uint16).reshape(LINES, n)
        self.n = n

    def ends_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line, the slice of its array between low and high."""
        pairs = [(p.searchsorted(a, "left"), p.searchsorted(b, "right")) for p, a, b in zip(self.places, low, high, strict=True)]
        return np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])


class Nearest:
    """The best rows of one query so far: distance, then id."""

    def __init__(self, top: int):
        self.top, self.distance, self.ids = top, np.full(top, np.inf), np.zeros(top, np.int64)

    def add(self, distance: np.ndarray, ids: np.ndarray) -> None:
        d, i = np.append(self.distance, distance), np.append(self.ids, ids)
        order = np.lexsort((i, d))[: self.top]
        self.distance, self.ids = d[order], i[order]

    def search(self, block: Block, query: np.ndarray, place: np.ndarray, least: int) -> int:
        """Windows around the query grow until they reach the worst of the best; returns the distances computed."""
        count, seen, checked = np.zeros(block.n, np.int32), np.zeros(block.n, bool), 0
        radius = self.distance[-1] if np.isfinite(self.distance[-1]) else self._start(block, place)
        low = high = None
        while True:
            a, b = block.ends_of(place - HALF * radius, place + HALF * radius)
            if low is None:
                new = [o[i:j] for o, i, j in zip(block.orders, a, b, strict=True)]
            else:
                new = [o[i:j] for o, i, j in zip(block.orders, a, low, strict=True)] + [o[i:j] for o, i, j in zip(block.orders, high, b, strict=True)]
            count += np.bincount(np.concatenate(new), minlength=block.n).astype(np.int32)
            low, high = a, b
            found = np.flatnonzero((count >= least) & ~seen)
            if len(found):
                seen[found] = True
                checked += len(found)
                self._verify(block, query, found)
            if radius >= self.distance[-1] or (not a.any() and (b == block.n).all()):
                return checked
            radius = min(GROWTH * radius, self.distance[-1])

    def _start(self, block: Block, place: np.ndarray) -> float:
        """A radius whose windows hold about one vector in thirty."""
        step = max(self.top, block.n // 60)
        at = np.array([p.searchsorted(x) for p, x in zip(block.places, place, strict=True)])
        line = np.arange(LINES)
        reach = np.maximum(place - block.places[line, np.maximum(at - step, 0)], block.places[line, np.minimum(at + step, block.n - 1)] - place)
        span = float(block.places.max() - block.places.min())
        return max(float(np.median(reach)) / HALF, span * 1e-6, 1e-300)

    def _verify(self, block: Block, query: np.ndarray, found: np.ndarray) -> None:
        d = block.vectors[found] - query
        d = np.sqrt((d * d).sum(axis=1))
        near = d <= self.distance[-1]
        if not near.any():
            return
        found, d = found[near], d[near]
        if len(found) > 4 * self.top:  # the ids of a class are looked at only if the class can enter
            keep = d <= np.partition(d, self.top - 1)[self.top - 1]
            found, d = found[keep], d[keep]
        ids = [block.ids[s:e][: self.top] for s, e in zip(block.starts[found], block.ends[found], strict=True)]  # ids ascend, so the first ones are all that can enter
        self.add(np.repeat(d, [len(i) for i in ids]), np.concatenate(ids))


def search_block(index: DataFrame, queries: list[tuple[int, list[float]]], top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for one block of queries (id, vector), written."""
    spark = index.sparkSession
    by: dict[int, dict[bytes, int]] = defaultdict(dict)
    rows = []
    for i, v in queries:
        seen = by[len(v)]
        rows.append((len(v), seen.setdefault(np.array(v, np.float64).tobytes(), len(seen)), i))
    asked = {n: np.frombuffer(b"".join(seen), np.float64).reshape(len(seen), n) for n, seen in by.items()}
    least = threshold()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: [Nearest(top + 1) for _ in m] for n, m in asked.items()}
        places = {n: m @ lines_of(n) for n, m in asked.items()}
        for b in batches:
            for k in range(b.num_rows):
                block = Block(b.slice(k, 1).to_pylist()[0])
                for query, place, nearest in zip(asked.get(block.dims, ()), places.get(block.dims, ()), best.get(block.dims, ()), strict=True):
                    nearest.search(block, query, place, least)
        out = [(n, q, float(d), int(i)) for n, found in best.items() for q, x in enumerate(found) for d, i in zip(x.distance, x.ids, strict=True) if d < math.inf]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["dims", "query", "score", "vec_id"])

    found = written_batches(index, task, "dims int, query long, score double, vec_id long", "neighbours-found", BATCH)
    order = Window.partitionBy("dims", "query").orderBy("score", "vec_id")
    first = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    lists = first.groupBy("dims", "query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    names = spark.createDataFrame(rows, "dims int, query long, query_id long")
    own = F.array_position(F.transform("near", lambda x: (x["score"] == 0) & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("near", lambda x, i: i != own - 1), 1, top)  # each query leaves out its own row, once
    out = lists.join(F.broadcast(names), ["dims", "query"]).select("query_id", F.posexplode(others).alias("rank", "x"))  # 4,096 rows
    return written(out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score"), "neighbours")


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """The nearest vectors of each query row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, m in vectors_of(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(m.astype(np.float64)), pa.list_(pa.float64()))], ["id", "v"])

    spark = index.sparkSession
    asked = written_batches(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), task, "id long, v array<double>", "neighbour-queries", BLOCK_STEP)
    rows, out = asked.toLocalIterator(), None
    while block := list(islice(rows, QUERY_ROWS)):
        one = search_block(index, [(r["id"], r["v"]) for r in block], top)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where(F.col("vec_id") % QUERY_MODULUS == 0))
