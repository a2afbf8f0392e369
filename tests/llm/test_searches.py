"""Resampling and searches against plain loops."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF, duck, rows_of

from pixelframe.llm import lexical_search as ls
from pixelframe.llm import neighbours as ann
from pixelframe.llm import resampling as rs
from pixelframe.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# --- resampling -----------------------------------------------------------------------------


def features(t):
    w = words(t)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


def brute_resampling(docs, items):
    """(doc_id, n_features, weight, score, rank) by the contract, in plain loops."""
    s, t = ([0] * 10000 for _ in range(2))
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for x in texts:
            for b in features(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out, order = [], []
    for k, (i, x) in enumerate(docs):
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(x)) >= 20:
            order.append((-score, i is None, i or 0, k))
    for rank, x in enumerate(sorted(order)[: 25 * len(order) // 100], 1):
        out[x[-1]][-1] = rank
    return sorted(map(tuple, out), key=repr)


def resampled(spark, docs, items):
    docs, items = (x.select(c) if c == "text" else x for x, c in ((docs, ""), (items, "text")))
    gain = rs.gains(rs.bucket_counts(docs), rs.bucket_counts(items))
    df = rs.drawn(rs.scored_runs(docs, gain))
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("block, run", [(1024, 1 << 17), (3, 40)])
def test_resampling(spark, monkeypatch, block, run):
    """The whole small table, with blocks and runs of production size and with tiny ones."""
    monkeypatch.setattr(rs, "BLOCK_ROWS", block)
    monkeypatch.setattr(rs, "RUN_ROWS", run)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(5)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampled(spark, docs, items)
    assert got == brute_resampling([tuple(r) for r in docs.collect()], [r.text for r in items.collect()])
    assert sorted(r[-1] for r in got if r[-1]) == list(range(1, max(r[-1] or 0 for r in got) + 1))


def test_resampling_odd(spark, docs, none, monkeypatch):
    """Nulls, empties, repeated rows and ids, clashing columns; rows without an id that repeat; no rows, no target."""
    monkeypatch.setattr(rs, "BLOCK_ROWS", 2)
    many = docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id IS NULL"))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    assert resampled(spark, many, docs.limit(7).select("text")) and len(rows) == len(resampled(spark, many, none.select("text")))
    got, want = resampled(spark, many, none.select("text")), brute_resampling(rows, [])
    assert got == want
    assert resampled(spark, none, docs.select("text")) == []


def test_pair_hashes():
    """Buckets from tables agree with the CRC of the joined words, also for words longer than the tables reach."""
    texts = ["a b a ñandú 日本 x" + "y" * 300 + " b " + "z" * 254 + " " + "w" * 255 + " c", "", "one", "a a a"]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None]})
    f = rs.Features()
    for _, w, n in rs.lots(batch, "text"):
        one, two, pairs = f.buckets(w, n)
        assert n.tolist() == [len(words(t)) for t in texts] + [0] and pairs.tolist() == [max(0, k - 1) for k in n]
        assert sorted([*one.tolist(), *two.tolist()]) == sorted(x for t in texts for x in features(t))


def test_tournament():
    """Blocks of many runs, with repeated scores, come out as one sorted list that stops where the draw ends."""
    rng = random.Random(4)
    for runs, wanted in ((1, 5), (7, 60), (40, 10_000)):
        blocks = []
        for run in range(runs):
            rows = sorted((-rng.randrange(9), False, rng.randrange(50), 3) for _ in range(rng.randrange(1, 40)))
            blocks += [{"run": run, "seq": i, "score": [-r[0] for r in rows[i : i + 4]], "doc_id": [r[2] for r in rows[i : i + 4]], "n_features": [3] * len(rows[i : i + 4])} for i in range(0, len(rows), 4)]
        all_keys = sorted(k for b in blocks for k in rs.keys_of(b))
        pieces = list(rs.merged(iter(sorted(blocks, key=lambda b: rs.keys_of(b)[0])), wanted))
        given = [k for b, i, j, hit in pieces if hit for k in rs.keys_of(b)[i:j]]
        rest = [k for b, i, j, hit in pieces if not hit for k in rs.keys_of(b)[i:j]]
        assert given == all_keys[:wanted] and sorted(rest) == all_keys[wanted:]


def test_resampling_query(spark):
    cols, rows = rows_of(QUERIES["op11_tournament_resampling"](spark, SF))
    assert cols == ["doc_id", "n_features", "rank", "score", "weight"] and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.isin(range(1, 1 + max(r[2] or 0 for r in rows)), [r[2] or 0 for r in rows]).all()


# --- lexical search -------------------------------------------------------------------------


def brute_search(docs, queries, top=10):
    terms = [words(t) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    counts = [Counter(w) for w in terms]
    df = Counter(t for c in counts for t in c)
    out, asked = [], {}
    for q, t in queries:
        asked.setdefault(q, set()).update(words(t))
    for q, ts in asked.items():
        found = []
        for (i, _), w, c in zip(docs, terms, counts, strict=True):
            m = 10 + 90 * len(w) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(q, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def searched(docs, queries):
    docs = docs.select("doc_id", "text")
    n, total = ls.corpus_size(docs)
    return sorted((tuple(r) for r in ls.search(ls.build_index(docs, n, total), queries, n).collect()), key=repr)


def test_search_sql(spark):
    assert rows_of(QUERIES["op12_block_max_wand"](spark, SF)) == duck(ORACLE_SQL["op12_block_max_wand"])


def test_search_small_parts(spark, monkeypatch):
    """Tiny shards and query blocks give the same rows as loops over all documents, among words of every frequency."""
    for name, value in (("SHARD_DOCS", 90), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(ls, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40))) for _ in range(300)]
    docs = [(k % 290 if k != 7 else None, t) for k, t in enumerate(texts)]
    queries = [(k, " ".join(rng.choices(vocabulary, k=6)).upper()) for k in range(20)] + [(3, "w1 w59"), (21, ""), (22, None), (None, "w4 w5"), (23, "unseen")]
    got = searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(queries, "item_id long, text string"))
    assert got == brute_search(docs, queries)


def test_search_one_shard(monkeypatch):
    """Tiny blocks and windows, in this process: exact scores and ties, and a threshold carried from shard to shard."""
    monkeypatch.setattr(ls, "BLOCK", 4)
    monkeypatch.setattr(ls, "WINDOW", 16)
    rng = np.random.default_rng(6)
    best, everything = [ls.Best(5) for _ in range(30)], []
    asked = [np.sort(rng.choice(40, 8, replace=False)) for _ in best]
    weights = rng.integers(1, 3000, 40)
    for number in range(3):
        sizes = rng.integers(0, 30, 120)
        ids = np.minimum(rng.geometric(0.08, sizes.sum()) - 1, 39)
        m = ls.lengths(sizes, 120, int(sizes.sum()))
        keys = rng.permutation(400)[:120].tolist()
        vocabulary = [b"%d" % k for k in range(ids.max() + 1)]
        ids[: len(vocabulary)] = np.arange(len(vocabulary))
        head, lists = (b.to_pylist() for b in ls._shard(number, vocabulary, ids, sizes, keys, 120, int(sizes.sum())))
        shard = ls.Shard(head[0]["df"], head[0]["meta"], head[0]["payload"])
        for r in lists:
            shard.add(int(r["term"]), r["df"], r["meta"], r["payload"])
        counts = np.zeros((120, 40), np.int64)
        np.add.at(counts, (np.repeat(np.arange(120), sizes), ids), 1)
        for b, terms in zip(best, asked, strict=True):
            shard.search(terms, weights[terms], b)
        everything.append((keys, counts, m))
    for b, terms in zip(best, asked, strict=True):
        rows = [(-sum(int(weights[t]) * (1000000000 * int(c[t]) // (1000 * int(c[t]) + 8 * int(x))) for t in terms if c[t]), k) for keys, counts, m in everything for k, c, x in zip(keys, counts, m, strict=True)]
        want = sorted(r for r in rows if r[0] < 0)[:5]
        assert [(-s, k) for s, k in zip(b.score.tolist(), b.key.tolist(), strict=True)] == want


def test_search_skips(monkeypatch):
    """Blocks below the threshold stay compressed, and postings survive their compression at every width."""
    monkeypatch.setattr(ls, "WINDOW", 256)
    n = 20_000
    sizes = np.where(np.arange(n) < 256, 1, 300)
    m = ls.lengths(sizes, n, int(sizes.sum()))
    doc = np.concatenate([np.arange(n), np.array([3, 9, 19_000])])
    term, tf = np.repeat([0, 1], [n, 3]), np.concatenate([np.ones(n, np.int64), [70_000, 1, 300]])
    meta, payload, block, byte = ls.postings(term, doc, tf, m)
    shard = ls.Shard(n, m.tobytes(), np.arange(n).tobytes() + bytes(n))
    for t in (0, 1):
        shard.add(t, int((term == t).sum()), meta[block[t] : block[t + 1]].tobytes(), payload[byte[t] : byte[t + 1]].tobytes())
        entry = shard.lists[t]
        parts = [ls.decoded(entry, k) for k in range(len(entry[1]))]
        assert np.array_equal(np.concatenate([p[0] for p in parts]), doc[term == t]) and np.array_equal(np.concatenate([p[1] for p in parts]), tf[term == t])
    best = ls.Best(10)
    shard.search(np.array([0, 1]), np.array([5, 9000]), best)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, np.where(term == 0, 5, 9000) * ls.impact(tf, m[doc]))
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best.key.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert shard.opened < len(meta) // 10


def test_search_odd(spark, docs, none):
    queries = spark.createDataFrame([(1, "the quick fox", "x"), (2, "École 日本語 wort5", "y"), (None, None, None)], "item_id long, text string, term string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert searched(docs, queries) == brute_search(rows, [(r.item_id, r.text) for r in queries.collect()])
    assert searched(none, queries) == [] and searched(docs, queries.limit(0)) == []


# --- nearest neighbours ---------------------------------------------------------------------


def brute_neighbours(rows, queries, top=10):
    """(query, rank, id, distance): every query against every other row, by place in rows."""
    out = []
    m = np.array([v for _, v in rows], np.float64)
    for at in queries:
        d = np.sqrt(((m - m[at]) ** 2).sum(axis=1))
        near = sorted((float(x), i) for k, (x, (i, _)) in enumerate(zip(d, rows, strict=True)) if k != at)[:top]
        out += [(rows[at][0], k, i, x) for k, (x, i) in enumerate(near, 1)]
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_neighbours_recall(spark):
    """Recall of the registered query, and ranks, distances and ties of what it finds."""
    sf = SF.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [k for k, (i, _) in enumerate(rows) if i % 100 == 0])
    got = found(QUERIES["op13_collision_counting"](spark, sf))
    assert [r[:2] for r in got] == sorted(r[:2] for r in want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.97 * len(want)
    by, vectors = {}, dict(rows)
    for q, _, i, s in got:
        assert q != i and s == pytest.approx(math.dist(vectors[q], vectors[i]), rel=1e-12)
        by.setdefault(q, []).append((s, i))
    assert all(v == sorted(v) for v in by.values())


def test_neighbours_copies(spark):
    """A third of all rows hold one vector: its copies find those with the smallest ids, and each leaves itself out."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist() if k % 3 else [1.0] * 8) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found(ann.search(ann.build_index(df), df.where("vec_id % 100 = 0")))
    want = brute_neighbours(rows, range(0, 600, 100))
    exact = [r for r in want if rows[r[0]][1] == [1.0] * 8]
    assert [r for r in got if rows[r[0]][1] == [1.0] * 8] == exact
    assert len(set(got) & {tuple(r) for r in want}) >= 0.95 * len(want)


def test_neighbours_odd(spark):
    """Vectors that take no part, other lengths, repeated rows and ids, fewer than ten others, nothing at all; a column named like the operator's own."""
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.5, 0.5]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (200, [1.0, 2.0, 3.0]), (300, [5.0])]
    bad = [(400, None), (500, [0.0, 0.0]), (600, [nan, 1.0]), (700, [inf, 1.0]), (800, [None, 1.0]), (900, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, query string").repartition(2)
    got = found(ann.search(ann.build_index(df), df.where("vec_id % 100 = 0")))
    two = [r for r in rows if len(r[1]) == 2]
    assert got == sorted(brute_neighbours(two, [0, 1, 2]))
    empty = df.limit(0)
    assert found(ann.search(ann.build_index(empty), empty)) == [] and found(ann.search(ann.build_index(df), empty)) == []
    assert ann.threshold() == 27


def test_neighbours_skip():
    """On clustered vectors the threshold keeps most distances from being computed, and windows only grow."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(64, 64)) * 3
    m = (centres[np.arange(4096) % 64] + rng.normal(size=(4096, 64)) * 0.1).astype(np.float32)
    block = ann.Block(ann.index_row(0, np.arange(4096), m))
    near = ann.Nearest(11)
    checked = near.search(block, m[5].astype(np.float64), m[5].astype(np.float64) @ ann.lines_of(64), ann.threshold())
    d = np.sqrt(((m.astype(np.float64) - m[5]) ** 2).sum(axis=1))
    assert len(set(near.ids) & set(np.argsort(d)[:11])) >= 10 and checked < 400
