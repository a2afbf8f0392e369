"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word hashes to one of BUCKETS rows and has a sparse random index vector (two entries of
+1 or -1 among DIMS). A row's context vector is the sum of the index vectors of the words
around its occurrences in the whole corpus. Tables have a fixed size (BUCKETS x (DIMS + 1)
numbers, about 4 MB), are summed per task and then per block in a stream. A document's
features are the mean and the spread of its words' normalised vectors, frequent words weighted
down, the mean likeness of neighbouring words' vectors, how often a word repeats the one before,
and the length. The network is trained in numpy on at most MAX_LABELLED labelled
documents (those with the least hash of doc_id); a temperature fitted on a fifth of them
calibrates its probabilities. Everything else reads all rows.

Labels come only from rows whose crc32(doc_id as text) modulo 4 is not 2. Labels, language,
source and id are never features.

Defined results: null and empty texts have zero features and a score like any other; repeated
rows are scored alike; null labels are skipped; without labels of both kinds the score is the
share of label 1, or 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, table, written
from .shingles import chunks, mix, word_hashes

BUCKETS, DIMS, REACH = 1 << 15, 32, 2
BLOCKS = 64
MAX_LABELLED = 20_000
FEATURES = 2 * DIMS + 3
#: Words that a document's averages count as if it had them besides its own, at what random words give; a few words alone say little.
PRIOR_WORDS = 10
FOLDS, HELD_OUT = 4, 2
KEEP_AT = 0.7
#: Words more frequent than this share of the corpus weigh less than half.
RARE = 1e-3


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs (two each) of the words' index vectors."""
    r = mix(h ^ np.uint64(0xD1B54A32D192ED03))
    place = np.stack([r % np.uint64(DIMS), (r >> np.uint64(20)) % np.uint64(DIMS)]).astype(np.int64)
    sign = 1.0 - 2.0 * np.stack([(r >> np.uint64(40)) & np.uint64(1), (r >> np.uint64(41)) & np.uint64(1)]).astype(np.float64)
    return place, sign


def context_table(texts: list[bytes]) -> np.ndarray:
    """BUCKETS x (DIMS + 1): summed index vectors of the neighbours, and the count, of each row."""
    h, doc = word_hashes(texts, lower=False)
    b, (place, sign) = _buckets(h), index_entries(h)
    cells, weights = [b * (DIMS + 1) + DIMS], [np.ones(len(b))]
    for gap in range(1, REACH + 1):
        same = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
        for mine, other in ((same, same + gap), (same + gap, same)):
            for j in range(2):
                cells.append(b[mine] * (DIMS + 1) + place[j][other])
                weights.append(sign[j][other])
    return np.bincount(np.concatenate(cells), np.concatenate(weights), BUCKETS * (DIMS + 1))


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, part in enumerate(np.split(total.astype("<f8"), BLOCKS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors (float32) and pooling weights of all buckets, from every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * (DIMS + 1))
        for batch in batches:
            for part in chunks(x.as_py() for x in batch.column(0).cast(pa.large_binary())):
                total += context_table(part)
        yield from _emit(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_py(), "<f4").astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "sums"])

    parts = map_batches(docs.select(text), count, "block int, sums binary")
    rows = map_batches(parts.repartition(BLOCKS, "block"), add, "block int, sums binary")
    whole = np.zeros(BUCKETS * (DIMS + 1))
    size = len(whole) // BLOCKS
    for r in rows.collect():  # at most BLOCKS rows, 8 MB together
        whole[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["sums"]))
    whole = whole.reshape(BUCKETS, DIMS + 1)
    n, v = whole[:, DIMS], whole[:, :DIMS]
    v = v - (v.sum(axis=0) / max(1.0, n.sum())) * n[:, None]
    v = v / np.maximum(1e-9, np.linalg.norm(v, axis=1))[:, None]
    return v.astype(np.float32), (RARE / (RARE + n / max(1.0, n.sum()))).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    h, doc = word_hashes(texts, lower=False)
    if not len(h):
        return out
    b = _buckets(h)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rows = doc[starts]
    w = weights[b]
    x = vectors[b]
    n = np.diff(np.append(starts, len(doc))).astype(np.float32)[:, None]
    own = n / (n + PRIOR_WORDS)
    mass = np.add.reduceat(w, starts)[:, None]
    mean = np.add.reduceat(x * w[:, None], starts, axis=0) / mass
    square = np.add.reduceat(x * x * w[:, None], starts, axis=0) / mass
    out[rows, :DIMS] = own * mean
    out[rows, DIMS : 2 * DIMS] = np.sqrt(own * np.maximum(0, square - mean * mean) + (1 - own) / DIMS)
    out[rows, 2 * DIMS] = np.log1p(n[:, 0])
    beside, again = np.zeros(len(b), np.float32), np.zeros(len(b), np.float32)
    inside = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    beside[inside] = np.einsum("nd,nd->n", x[inside], x[inside - 1])
    again[inside] = h[inside] == h[inside - 1]
    for k, v in ((1, beside), (2, again)):
        out[rows, 2 * DIMS + k] = (own * np.add.reduceat(v, starts)[:, None] / n)[:, 0]
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1)
        return z @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, size: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss of four fifths; the temperature minimises the log loss of the rest."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, fit = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[fit].mean(axis=0), np.maximum(1e-4, x[fit].std(axis=0))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    xs = ((x - centre) / scale).astype(np.float64)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // size)):
            a, t = xs[part], t + 1
            z = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(z @ p[2] + p[3], -40, 40))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (1 - z * z)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), z.T @ d + decay * p[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(check):
        z, target = net.logits(x[check]), y[check]
        loss = [(float(np.mean(np.logaddexp(0, -z / s) * target + np.logaddexp(0, z / s) * (1 - target))), s) for s in np.geomspace(0.25, 8, 41)]
        net.temperature = float(min(loss)[1])
    return net


def features(docs: DataFrame, vectors: np.ndarray, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (FEATURES float32 as bytes) of each row. The two tables have a fixed size and are broadcast."""
    known = docs.sparkSession.sparkContext.broadcast((vectors, weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = known.value
        for batch in batches:
            rows: list[bytes] = []
            for part in chunks(x.as_py() for x in batch.column(1).cast(pa.large_binary())):
                rows += [r.tobytes() for r in pooled(part, v, w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(narrow, task, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, x binary")


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def threshold(hashes: DataFrame, limit: int) -> int | None:
    """The largest h so that at most `limit` rows of hashes (column h, distinct) are <= h; None where all are. Counts of hash prefixes, 4,096 at a time, narrow it down; no more reaches the driver."""
    inside, shift, taken = hashes, 52, 0
    while True:
        counts = sorted((r["p"], r["c"]) for r in inside.groupBy(F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
        for p, c in counts:
            if taken + c > limit:
                break
            taken += c
        else:
            return None if inside is hashes else ((p + 1) << shift) - 1
        if shift == 0:
            return p - 1
        inside, shift = inside.where(F.shiftright("h", shift) == p), max(0, shift - 12)


def labelled_sample(rows: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the `limit` documents with the least hashes of doc_id, outside the held-out fold. Of rows that share an id one counts, that with the greatest features."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = written(known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")), "labelled")
    top = threshold(known.select("h"), limit)
    chosen = known if top is None else known.where(F.col("h") <= top)
    got = rows.join(chosen, "doc_id").groupBy("h", "doc_id", "quality").agg(F.max("x").alias("x")).collect()
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype="<f4").reshape(len(got), FEATURES).astype(np.float64)
    discard(known)
    return x, np.array([float(r["quality"]) for r in got])


def scored(rows: DataFrame, net: Network) -> DataFrame:
    """doc_id and score."""
    known = rows.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(x.as_py() for x in batch.column(1))
            x = np.frombuffer(raw, dtype="<f4").reshape(batch.num_rows, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.value.score(x), pa.float64())], names=["doc_id", "score"])

    return map_batches(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = written(features(docs, *word_vectors(docs)), "features")
    out = scored(rows, train(*labelled_sample(rows, labels)))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored as labels.quality marks them."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
