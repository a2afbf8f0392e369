"""Jaccard self-join over word n-grams: a size-aware join of light and heavy sets.

Equal sets are one class from the start. Light (small) sets enumerate their fixed-size
subsets: two sets overlap in c elements exactly if they share a c-subset, so equal keys are
links and nothing is verified. Heavy (large) sets go through inverted lists. A list belongs to
a block of elements: elements are dealt into blocks by hash, sets linked at a similarity t
differ in at most D elements, so among any D + 1 blocks one is the same in both. A set is
posted under its first D + 1 blocks of two or three elements or more, which keeps frequent
single n-grams from making long lists. The boundary between light and heavy is the size at which
lists get cheaper than subsets, from the histogram of small sizes. Sets just under the
boundary do both, for partners across it.

Lists are scanned without making all pairs. First every set meets the most widely shared
member of its lists (the likely origin of its copies); verified links give components. Then
the members of a list from different components are compared by sketches of a fixed size,
which rule a pair out only where its sets differ too much, and the pairs left are verified. So
every link between components is found; links inside one cannot change it.

A class (of equal sets) is known by a 64-bit hash of its set; links are verified on the
texts. Defined results: null, empty and wordless texts have an empty set and are linked with
nothing; repeated rows get equal results; rows that share an id keep their own sets; a set
whose rows all lack an id is linked with equal sets only, and has no component number; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, maybe_in, table, written
from .components import components
from .shingles import all_sets, mix

#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 90
#: Largest size that may enumerate subsets.
MOST_LIGHT = 27
#: Sizes are grouped in levels that share one number of blocks.
LEVEL_FIRST, LEVEL_RATIO, PER_BLOCK = 16, 1.6, 7.5
#: Cost of a verified pair in postings.
VERIFY_COST = 40
#: Parity bits that rule most pairs out before their texts meet, and rows of a list that meet in one group.
SKETCH_BITS, TILE = 1024, 4096


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    return sorted({overlap_needed(n, m, percent) for m in partner_sizes(n, percent)})


def subset_keys(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


@lru_cache(1 << 16)
def differences(n: int, percent: int) -> int:
    """Most elements in which a set of n and a linked partner, of any size, can differ. Rounding makes this uneven in the partner's size, so all sizes are tried."""
    return max(n + m - 2 * overlap_needed(n, m, percent) for m in partner_sizes(n, percent))


def level(n: int) -> int:
    return max(0, math.ceil(math.log(max(n, 1) / LEVEL_FIRST) / math.log(LEVEL_RATIO) - 1e-9))


def blocks_of(lv: int, percent: int) -> int:
    top = LEVEL_FIRST * LEVEL_RATIO**lv
    need = differences(math.ceil(top), percent) + 1
    return max(math.ceil(top / PER_BLOCK), math.ceil((1.15 if need < top / 8 else 1.3) * need)) + 4


def thick_from(lv: int, percent: int) -> int:
    """Elements that make a block worth a list: fewer where many blocks have to share a set."""
    mean = LEVEL_FIRST * LEVEL_RATIO**lv / (blocks_of(lv, percent) - 4)
    return 3 if mean >= 6 else 2 if mean >= 2.5 else 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest light size. sizes: how many classes have each size up to a little over MOST_LIGHT.

    Light cost: one posting a subset. Heavy cost: one posting a block, and a verified pair for
    each set that is likely to find one, which for short lists means one in a thousand of the
    sets of partner size, at most one each. The boundary with the least sum wins.
    """
    light, heavy = {}, {}
    for n in range(1, MOST_LIGHT + 1):
        h = sizes.get(n, 0)
        near = sum(sizes.get(m, 0) for m in partner_sizes(n, percent)) - 1
        light[n] = h * subset_keys(n, percent)
        heavy[n] = h * (differences(n, percent) + 1) + VERIFY_COST * h * min(1.0, max(0, near) / 1000)
    sure = max(n for n in range(1, MOST_LIGHT + 1) if subset_sizes(n, percent) == [n]) if subset_sizes(1, percent) == [1] else 1
    return min(range(sure, MOST_LIGHT + 1), key=lambda x: (sum(light[n] for n in light if n <= x) + sum(heavy[n] for n in heavy if n > x), -x))


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0].astype(np.int64))


def list_keys(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys of the inverted lists that a set is posted in, at its own level and at that of larger partners."""
    n, out = len(s), []
    for lv in range(level(n), level(100 * n // percent) + 1):
        k = blocks_of(lv, percent)
        with np.errstate(over="ignore"):
            m = mix(s + np.uint64(0x51ED2701))
            block = ((m >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            count = np.bincount(block.astype(np.int64), minlength=k)
            order = np.argsort(block, kind="stable")
            ends = np.cumsum(count)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(m ^ np.uint64(0xA5A5A5A5))[order])])
            sums = total[ends] - total[ends - count]
            keys = mix(sums + mix(np.arange(k, dtype=np.uint64) + np.uint64(1000 * lv + 7)))
        thick, some = np.flatnonzero(count >= thick_from(lv, percent)), np.flatnonzero(count)
        need = differences(n, percent) + 1
        # a set without enough thick blocks is posted under all blocks that have elements, which takes in those of any partner
        out.append(keys[thick[:need]] if len(thick) >= need else keys[some] if len(some) >= need else keys)
    return out


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[bytes | None]:
    column = batch.column(i).cast(pa.large_binary())
    return (x.as_py() for x in column)


def classes(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, h and len (the text's hash and length), n (size of the set) and node (hash of the set; null where it is empty)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = [], []
            for s in all_sets(_texts(batch, 1), k):
                n.append(len(s))
                node.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "h", "len", "n", "node"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.length("text").alias("len"))
    return map_batches(rows, task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, len int, n long, node long")


def subset_postings(docs: DataFrame, light: int, k: int, percent: int) -> DataFrame:
    """key, key2, c, node, n of every subset of the light sets; a task posts a class once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for s in all_sets(_texts(batch, 0), k):
                n = len(s)
                if not 0 < n <= light or (node := signature(s)) in seen:
                    continue
                seen.add(node)
                with np.errstate(over="ignore"):
                    one, two = mix(s), mix(s ^ np.uint64(0x5DEECE66D))
                    for c in subset_sizes(n, percent):
                        gone = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(math.comb(n, c), n - c)
                        a = mix(one.sum(dtype=np.uint64) - one[gone].sum(axis=1, dtype=np.uint64) + np.uint64(c))
                        b = two.sum(dtype=np.uint64) - two[gone].sum(axis=1, dtype=np.uint64)
                        cols[0].append(a.view(np.int64))
                        cols[1].append(b.view(np.int64))
                        cols[2].append(np.full(len(a), c, np.int32))
                        cols[3].append(np.full(len(a), node, np.int64))
                        cols[4].append(np.full(len(a), n, np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "key2", "c", "node", "n"])

    return map_batches(docs.select("text"), task, "key long, key2 long, c int, node long, n int")


def subset_links(postings: DataFrame, percent: int) -> DataFrame:
    """Links a, b between light classes. In a group of one subset, sets of two sizes are linked all with all or not at all, so each meets the least set of every size that it is linked with."""
    group = ["key", "key2", "c"]
    least = postings.groupBy(*group, "n").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    by_size = least.groupBy(*group).agg(F.collect_list(F.struct(F.col("n").alias("m"), "least")).alias("sizes"), F.min("least").alias("lo"), F.max("most").alias("hi"))
    met = postings.join(by_size.where("lo <> hi").select(*group, "sizes"), group)
    pair = met.select("c", "n", "node", F.explode_outer("sizes").alias("s")).select("c", "n", "node", F.col("s.m").alias("m"), F.col("s.least").alias("least"))
    needed = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100.0 + percent) - F.lit(1e-9))
    return pair.where((F.col("c") >= needed) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def postings(docs: DataFrame, least: int, k: int, percent: int) -> DataFrame:
    """key, node of the inverted lists of all sets of at least that size; a task posts a class once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, nodes = [], []
            for s in all_sets(_texts(batch, 0), k):
                if len(s) < least or (node := signature(s)) in seen:
                    continue
                seen.add(node)
                for got in list_keys(s, percent):
                    keys.append(got.view(np.int64))
                    nodes.append(np.full(len(got), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes)], names=["key", "node"])

    return map_batches(docs.select("text"), task, "key long, node long")


def shared_lists(rows: DataFrame) -> DataFrame:
    """key, node, g of the lists with two classes or more, g rows each; what several tasks posted for one class counts once. Windows are read in order and spill, so a long list needs no memory."""
    w = Window.partitionBy("key").orderBy("node")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = rows.select("key", "node", F.lag("node").over(w).alias("before"), F.first("node").over(whole).alias("lo"), F.last("node").over(whole).alias("hi"), F.count(F.lit(1)).over(whole).alias("g"))
    return near.where("lo <> hi AND (before IS NULL OR before <> node)").select("key", "node", "g")


def _possible(percent: int) -> str:
    """SQL over na, nb and shared: the sizes allow a link, and as many lists are shared as one must share."""
    need = f"ceil({percent} * (na + nb) / {100.0 + percent} - 1e-9)"

    def diff(n: str) -> str:
        other = f"floor(100 * {n} / {float(percent)} + 1e-9)"
        return f"({n} + {other} - 2 * ceil({percent} * ({n} + {other}) / {100.0 + percent} - 1e-9))"

    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND shared >= least({diff('na')}, {diff('nb')}) + 1 - (na + nb - 2 * {need})"


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b whose sets, made anew from their texts, are linked. Hot members are joined in a way that Spark can split."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, a, b = all_sets(_texts(batch, 2), k), all_sets(_texts(batch, 3), k), [], []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), left, right, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return map_batches(two.select("a", "b", "ta", "tb"), task, "a long, b long")


def _first_pairs(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Each class with the member it shares most lists with, of those that are the most widely shared in some list. sizes: node, n."""
    shared = lists.groupBy("node").agg(F.sum("g").alias("pop")).join(sizes, "node")
    w = Window.partitionBy("key")
    ranked = lists.select("key", "node").join(shared, "node").select("key", "node", "n", F.max(F.struct("pop", "node", "n")).over(w).alias("top"))
    pairs = ranked.where("node <> top.node").groupBy(F.col("node").alias("a"), F.col("top.node").alias("b"), F.col("n").alias("na"), F.col("top.n").alias("nb")).agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(_possible(percent)).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def own_texts(rows: DataFrame, k: int) -> DataFrame:
    """node and text without texts of other sets under a repeated id, and a task's repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            kept = []
            for i, (node, s) in enumerate(zip(batch.column(0).to_pylist(), all_sets(_texts(batch, 1), k), strict=True)):
                if node not in seen and signature(s) == node:
                    seen.add(node)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return map_batches(rows, task, "node long, text string")


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """node and sketch: one parity bit for each of SKETCH_BITS hash buckets. Two sets differ in at least as many elements as their sketches in bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in all_sets(_texts(batch, 1), k):
                with np.errstate(over="ignore"):
                    at = (mix(s ^ np.uint64(0x3C6EF372)) >> np.uint64(20)).astype(np.int64) % SKETCH_BITS
                out.append(np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "sketch"])

    return map_batches(texts.select("node", "text"), task, "node long, sketch binary")


def tile_pairs(i: int, j: int, node: np.ndarray, n: np.ndarray, comp: np.ndarray, tile: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs between tiles i and j (or inside i) of one list that their sizes, components and sketches leave possible. All arrays are sorted by n."""
    left = np.flatnonzero(tile == i)
    right = left if i == j else np.flatnonzero(tile == j)
    a, b = [], []
    nr, cr, sr, vr = n[right], comp[right], sketch[right], node[right]
    for r, x in enumerate(left.tolist()):
        lo = r + 1 if i == j else int(np.searchsorted(nr, -(-percent * n[x] // 100)))
        hi = int(np.searchsorted(nr, 100 * n[x] // percent, side="right"))
        near = lo + np.flatnonzero(cr[lo:hi] != comp[x])
        if len(near):
            total = n[x] + nr[near]
            allowed = total - 2 * -(-percent * total // (100 + percent))
            near = near[np.bitwise_count(sr[near] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= allowed]
            a.append(np.full(len(near), node[x]))
            b.append(vr[near])
    return a, b


def _other_pairs(lists: DataFrame, sizes: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs of different components in one list that their sketches leave possible.

    A list is cut by size into tiles of TILE rows. A row goes to a group for each tile that holds
    partners of a possible size, so no group exceeds two tiles and tiles of far sizes never meet;
    only pairs that pass leave a group.
    """
    part = sizes.join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"), F.log(F.col("n").cast("double")).alias("size"))
    lab = lists.select("key", "node").join(part, "node").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("size", "node")))
    w, far = "PARTITION BY key ORDER BY size", f"{math.log(100 / percent) + 1e-9!r}D"
    whole = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    marks = lab.selectExpr(
        "*", f"min(comp) OVER {whole} AS lo", f"max(comp) OVER {whole} AS hi",
        f"count(1) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND {far} PRECEDING) AS below",
        f"count(1) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND {far} FOLLOWING) AS upto",
    ).where("lo <> hi")
    tile = lambda c: F.floor(c / F.lit(float(TILE))).cast("int")
    mixed = marks.select("key", "node", "n", "comp", tile(F.col("place") - 1).alias("tile"), tile(F.col("below")).alias("first"), tile(F.col("upto") - 1).alias("last"))
    meets = F.transform(F.sequence("first", "last"), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j")))
    rows = mixed.join(sketches(texts, k), "node").withColumn("m", F.explode_outer(meets)).select("key", "m.i", "m.j", "node", "n", "comp", "tile", "sketch")
    grouped = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(whole: pa.Table) -> pa.RecordBatch:
            col = [whole.column(c).to_numpy() for c in range(7)]
            bits = np.frombuffer(b"".join(whole.column(7).to_pylist()), dtype=np.uint64).reshape(len(col[0]), -1)
            group = np.stack(col[:3], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            a, b = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                x, y = tile_pairs(int(col[1][lo]), int(col[2][lo]), col[3][lo:hi], col[4][lo:hi].astype(np.int64), col[5][lo:hi], col[6][lo:hi], bits[lo:hi], percent)
                a += x
                b += y
            both = np.stack([np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])], axis=1)
            both = np.unique(np.sort(both, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:  # a group may go on in the next batch: what is held ends with an open group
            held.append(batch)
            whole = pa.Table.from_batches(held)
            last = np.stack([whole.column(c).to_numpy() for c in range(3)], axis=1)
            open_from = len(last) - int(np.argmax(np.concatenate([(last[::-1] != last[-1]).any(axis=1), [True]])))
            if open_from:
                yield solve(whole.slice(0, open_from))
            held = whole.slice(open_from).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return map_batches(grouped, task, "a long, b long").distinct()


def join_components(docs: DataFrame, k: int = 3, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return row_components(docs, k, percent, key, text).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, k: int = 3, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As join_components, with h and len, which tell rows of one id apart by their texts."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    base = written(classes(docs, k), "classes")
    known = written(base.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")), "nodes")
    small = {r["n"]: r["c"] for r in known.where(F.col("n") <= MOST_LIGHT * 100 // percent + 1).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    light = boundary(small, percent)
    lists = written(shared_lists(postings(docs, -(-percent * (light + 1) // 100), k, percent)), "lists")
    listed = written(known.join(lists.select("node").distinct(), "node", "left_semi").select("node", F.col("n").cast("int").alias("n"), F.col("first").alias("doc_id")), "listed")
    likely, _ = maybe_in(docs, listed, "doc_id")
    texts = written(own_texts(likely.join(listed, "doc_id").select("node", "text"), k), "texts")
    sizes = listed.select("node", "n")
    links = written(subset_links(subset_postings(docs, light, k, percent), percent).union(verify(_first_pairs(lists, sizes, percent), texts, k, percent)), "first-links")
    labels = written(components(links), "labels")
    more = written(verify(_other_pairs(lists, sizes, labels, texts, k, percent), texts, k, percent), "other-links")
    discard(lists, listed, texts)
    whole = components(links.union(more)) if more.limit(1).count() else labels
    out = labelled(base, known, whole)
    discard(links, labels, more)
    return out


def labelled(base: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Component numbers of classes back to rows: the least doc_id of each component."""
    part = known.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("comp"))
    ids = part.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = written(part.join(ids, "comp").select("node", "component_id"), "named")
    discard(known)
    return base.join(named, "node", "left").select("doc_id", "h", "len", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, links at a Jaccard similarity of 0.9."""
    return join_components(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the least id; near duplicates share 80 % of their five-word shingles.

    Empty texts are components of their own. Of rows repeated with id and text one stays; rows
    without an id stay. Of rows that share an id but not their text, each stays or goes with its
    own component.
    """
    parts = written(row_components(docs, k=5, percent=80), "components")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    others = written(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), "h", "len").distinct(), "copies")
    likely, clean = maybe_in(docs, others.select(F.col("__id").alias("doc_id")), "doc_id")
    gone = (likely["doc_id"] == others["__id"]) & (F.xxhash64(likely["text"]) == others["h"]) & (F.length(likely["text"]) == others["len"])
    kept = clean.unionByName(likely.join(others, gone, "left_anti"))
    repeated = written(parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    discard(parts)
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, chr(1)) FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x a, y b FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT * FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) b FROM r GROUP BY a))
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
