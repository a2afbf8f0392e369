"""N-best segmentation over a SentencePiece vocabulary.

The lattice of a text has an arc for each piece that matches at a place, and for each
character outside the vocabulary an arc that stands for its bytes. A segmentation's score is
the sum of its pieces' log-probabilities. The model file has merge ranks, which don't add up to a
likelihood, so a piece's probability follows from its rank by Zipf's law: the piece of rank r has
a share in proportion to 1 / (r + 1). Forward Viterbi scores are exact heuristics:
a backward A* search from the end of the lattice, ordered by (score so far + Viterbi score of
the rest), completes segmentations in descending order.

No piece reaches over the beginning of a word (a mark for space after another character), so
the lattice falls into chunks and a text's N best are combinations of its chunks' N best.
For each batch the distinct chunks are found by hash and the Viterbi tables of those that no earlier
one held (up to a bound) are filled together in numpy, forwards and backwards; the two tables also give the loss of each chunk's second
best. At most N - 1 chunks of a text, those with the least losses, can differ from their best
among its N best; only these are searched with A*. Chunks of more than LONG characters take
the same steps one by one.

Decoding turns ids into pieces, joins byte pieces as UTF-8, and spaces back.

Defined results: null and empty texts have no pieces and one segmentation of score 0; ties
prefer the longer last piece; fewer than N segmentations leave a shorter list; repeated rows
are treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .shingles import mix

SPACE = "▁"
_MARK = SPACE.encode()
N_BEST, LONG, BLOCK_CHARS, REMEMBERED, KEPT = 4, 64, 1 << 21, 100_000, 500_000
UNKNOWN_PENALTY = 10.0
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mul(a, b):
    with np.errstate(over="ignore"):
        return a * b


def _char(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class Pieces:
    """The model's pieces and scores, with a hashed table for numpy and a dict for Python."""

    SLOT_BITS = 20

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in normal}
        rank = np.zeros(size)
        rank[sorted(normal, key=lambda i: (-sp.get_score(i), i))] = np.arange(len(normal))
        # multiples of a power of two: sums are exact in any order, and ties are ties
        self.scores = np.round((-np.log(rank + 1) - np.log(np.sum(1 / np.arange(1, len(normal) + 1)))) * 2**20) / 2**20
        self.unknown = float(min(self.scores[i] for i in normal)) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece reaches over the beginning of a word")
        if len(self.bytes) not in (0, 256):
            raise ValueError("some byte pieces are missing")
        self.spelling = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode("utf-8", "surrogatepass") for i, t in enumerate(self.text)]
        self._index()

    def _index(self) -> None:
        raw, sizes = np.zeros(len(self.ids), np.uint64), np.array([len(t) for t in self.ids])
        chars = _char(np.frombuffer("".join(self.ids).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        first = np.cumsum(sizes) - sizes
        for k in range(self.longest):
            on = sizes > k
            raw[on] = _mul(raw[on], np.uint64(_BASE)) + chars[first[on] + k]
        keys = mix(raw)
        ids = np.array(list(self.ids.values()), dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.SLOT_BITS), np.arange((1 << self.SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.first).max())
        self.keys = np.append(self.keys, np.zeros(self.deep + 1, np.uint64))
        self.key_ids = np.append(self.key_ids, np.full(self.deep + 1, -1, np.int32))

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in _char(np.array([ord(x) for x in text], dtype=np.uint64)).tolist():
            h = (h * _BASE + c) & ((1 << 64) - 1)
        return int(mix(np.array([h], dtype=np.uint64))[0])

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Ids of substrings by their raw hash, -1 where no piece matches. Most slots hold no key or one."""
        h = mix(raw)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        at = self.first[slot]
        out = np.where(self.keys[at] == h, self.key_ids[at], -1)
        again = np.flatnonzero((self.first[slot + 1] - at > 1) & (out < 0))
        for d in range(1, self.deep):
            if not len(again):
                break
            a = at[again] + d
            hit = (self.keys[a] == h[again]) & (a < self.first[slot[again] + 1])
            out[again[hit]] = self.key_ids[a[hit]]
            again = again[~hit]
        return out

    def expand(self, c: str) -> list[int]:
        """Ids of one character outside the vocabulary."""
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [0]

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            out += bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8", "surrogatepass")
        text = out.decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def decoded(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, in bytes: pieces spelled out, bytes joined, marks turned into spaces, the one before the text dropped."""
        return self.spelled(ids).replace(_MARK, b" ")[1:]

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join([self.spelling[i] for i in ids.tolist()])

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two id lists spell the same bytes: the stretch between the ids that they share at both ends decides."""
        n = min(len(a), len(b))
        head = np.flatnonzero(a[:n] != b[:n])
        i = int(head[0]) if len(head) else n
        tail = np.flatnonzero(a[len(a) - n + i :][::-1] != b[len(b) - n + i :][::-1])
        j = int(tail[0]) if len(tail) else n - i
        return self.spelled(a[i : len(a) - j]) == self.spelled(b[i : len(b) - j])

    def arcs(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """For each end: (start, score, id) of the arcs that end there, longer ones first; id -1 stands for a character's bytes."""
        out: list[list[tuple[int, float, int]]] = [[]]
        for end in range(1, len(chunk) + 1):
            here = []
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(chunk[start:end])
                if i is not None:
                    here.append((start, float(self.scores[i]), i))
                elif start == end - 1:
                    here.append((start, self.unknown, -1))
            out.append(here)
        return out

    def viterbi(self, arcs: list[list[tuple[int, float, int]]]) -> list[float]:
        best = [0.0]
        for here in arcs[1:]:
            best.append(max(best[s] + v for s, v, _ in here))
        return best

    def nbest(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """Up to n (score, ids) of one chunk by backward A* under exact Viterbi heuristics."""
        arcs = self.arcs(chunk)
        ahead = self.viterbi(arcs)
        heap = [(-ahead[-1], 0, len(chunk), 0.0, None)]
        made, out = 0, []
        while heap and len(out) < n:
            _, _, end, score, path = heapq.heappop(heap)
            if end == 0:
                ids, p = [], path
                while p is not None:
                    (start, i), p = p
                    ids += self.expand(chunk[start]) if i < 0 else [i]
                out.append((score, ids))
                continue
            for start, v, i in reversed(arcs[end]):  # of equal ones the latest goes on first: the one with the longer last piece
                made -= 1
                heapq.heappush(heap, (-(score + v + ahead[start]), made, start, score + v, ((start, i), path)))
        return out


def marked(text: str) -> str:
    """The text as the vocabulary spells it: a space before it, and every space as its mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def combine(best: float, choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums of one loss from each list (each begins with 0): (score, rank taken in each list)."""
    rows: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for losses in choices:
        rows = sorted(((a + b, r + (k,)) for a, r in rows for k, b in enumerate(losses)), key=lambda x: (x[0], x[1]))[:n]
    return [(best - a, r) for a, r in rows]


class Solved:
    """Chunks that earlier runs of texts solved, by hash: best score, loss, and the stretch of flat that holds the ids. Forgets all when it holds too many."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.count, self.offset, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each chunk, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.row[at], -1)

    def add(self, keys: np.ndarray, best: np.ndarray, loss: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """New chunks, ids in their order."""
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(count) - count])
        self.flat = np.concatenate([self.flat, flat])
        self.best, self.loss, self.count = (np.concatenate(x) for x in ((self.best, best), (self.loss, loss), (self.count, count)))
        row = np.concatenate([self.row, len(self.row) + np.arange(len(keys))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.row = keys[order], row[order]


class Batch:
    """Distinct chunks of a run of texts: best ids and score, and the loss of the second best (inf where there is none). Chunks in `solved` aren't solved again, and new ones go there."""

    def __init__(self, pieces: Pieces, texts: list[str], solved: Solved | None = None):
        self.p, self.solved = pieces, solved or Solved()
        if len(self.solved.keys) > KEPT or len(self.solved.flat) > 8 * KEPT:
            self.solved.forget()
        parts = [np.frombuffer(marked(t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        self.codes = np.concatenate([np.zeros(0, np.uint32), *parts])
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        space = self.codes == ord(SPACE)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first[:-1][sizes > 0]] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.append(self.starts[1:], len(self.codes))[: len(self.starts)]
        self.bounds = np.searchsorted(self.starts, first)
        self._distinct()
        self._solve()

    def _distinct(self) -> None:
        n = len(self.codes)
        with np.errstate(over="ignore"):
            inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_char(self.codes) * inverse[1:])])
            self.raw = lambda i, j: (total[j] - total[i]) * power[j]
            h = mix(self.raw(self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        self.keys, index, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.at, self.length = self.starts[index], (self.ends - self.starts)[index]

    def chunk(self, u: int) -> str:
        a = int(self.at[u])
        return self.codes[a : a + int(self.length[u])].tobytes().decode("utf-32-le", "surrogatepass")

    def _solve(self) -> None:
        m = len(self.at)
        self.best, self.loss = np.zeros(m), np.full(m, np.inf)
        new = np.flatnonzero(self.solved.rows(self.keys) < 0)
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        order = new[np.argsort(self.length[new], kind="stable")]
        edges = np.searchsorted(self.length[order], np.arange(1, LONG + 2))
        for size in range(1, LONG + 1):
            group = order[edges[size - 1] : edges[size]]
            for k in range(0, len(group), 20_000):
                ids.append(self._group(group[k : k + 20_000], size))
        for u in order[edges[LONG] :].tolist():
            ids.append(self._long(u))
        owner = np.concatenate([np.zeros(0, np.int64), *[o for o, _ in ids]])
        flat = np.concatenate([np.zeros(0, np.int32), *[f for _, f in ids]])
        sort = np.argsort(owner, kind="stable")
        self.solved.add(self.keys[new], self.best[new], self.loss[new], np.bincount(owner, minlength=m).astype(np.int64)[new], flat[sort])
        at = self.solved.rows(self.keys)
        self.best, self.loss, self.count, self.offset, self.flat = self.solved.best[at], self.solved.loss[at], self.solved.count[at], self.solved.offset[at], self.solved.flat

    def _group(self, us: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi both ways for chunks of one length; owners and ids of their best pieces in order."""
        p, n, at = self.p, len(us), self.at[us]
        arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        alpha, back = [np.zeros(n)], [np.zeros(n, np.int64)]
        for j in range(1, size + 1):
            top, take = np.full(n, -np.inf), np.zeros(n, np.int64)
            for i in range(max(0, j - p.longest), j):
                found = p.find(self.raw(at + i, at + j))
                score = np.where(found >= 0, p.scores[found], p.unknown if i == j - 1 else -np.inf)
                if i < j - 1 and not (found >= 0).any():
                    continue
                arcs[i, j] = (score, found)
                via = alpha[i] + score
                better = via > top
                top, take = np.where(better, via, top), np.where(better, i, take)
            alpha.append(top)
            back.append(take)
        beta = [np.full(n, -np.inf) for _ in range(size)] + [np.zeros(n)]
        for i in range(size - 1, -1, -1):
            for j in range(i + 1, min(size, i + p.longest) + 1):
                if (i, j) in arcs:
                    beta[i] = np.maximum(beta[i], arcs[i, j][0] + beta[j])
        best, loss = alpha[size], np.full(n, np.inf)
        open_at = np.zeros((size + 1, n), dtype=bool)
        open_at[size] = True
        owner, ids = [], []
        for j in range(size, 0, -1):
            for i in range(j - 1, -1, -1):
                if (i, j) not in arcs:
                    continue
                score, found = arcs[i, j]
                taken = open_at[j] & (back[j] == i)
                gap = np.where(taken, np.inf, best - (alpha[i] + score + beta[j]))
                np.minimum(loss, gap, out=loss)
                rows = np.flatnonzero(taken)
                if len(rows):
                    open_at[i][rows] = True
                    owner.append(np.stack([us[rows], np.full(len(rows), i)]))
                    ids.append(found[rows])
        self.best[us], self.loss[us] = best, np.maximum(loss, 0)
        both, flat = np.concatenate(owner, axis=1), np.concatenate(ids)
        sort = np.lexsort((both[1], both[0]))
        who, place, flat = both[0][sort], both[1][sort], flat[sort]
        bare = np.flatnonzero(flat < 0)
        if len(bare):
            spelled = [p.expand(chr(int(c))) for c in self.codes[self.at[who[bare]] + place[bare]]]
            times = np.ones(len(flat), np.int64)
            times[bare] = [len(x) for x in spelled]
            start = np.concatenate([[0], np.cumsum(times)])
            who, flat = np.repeat(who, times), np.repeat(flat, times)
            for k, x in zip(bare.tolist(), spelled, strict=True):
                flat[start[k] : start[k] + len(x)] = x
        return who, flat

    def _long(self, u: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.p.nbest(self.chunk(u), 2)
        self.best[u] = got[0][0]
        if len(got) > 1:
            self.loss[u] = got[0][0] - got[1][0]
        return np.full(len(got[0][1]), u), np.array(got[0][1], dtype=np.int32)

    def ids_of(self, chunks: np.ndarray) -> np.ndarray:
        """Best ids of consecutive chunks."""
        n = self.count[chunks]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int32)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.flat[np.arange(total) + np.repeat(self.offset[chunks] - begin, n)]


class Segmenter:
    """N best of many texts; the A* results of searched chunks are remembered, up to a bound."""

    def __init__(self, path: str, n: int = N_BEST):
        self.p, self.n = Pieces(path), n
        self.known: dict[str, list[tuple[float, list[int]]]] = {}
        self.solved = Solved()

    def chunk_nbest(self, chunk: str) -> list[tuple[float, list[int]]]:
        got = self.known.get(chunk)
        if got is None:
            got = self.p.nbest(chunk, self.n)
            if len(self.known) < REMEMBERED and len(chunk) <= LONG:
                self.known[chunk] = got
        return got

    def __call__(self, texts: list[str]) -> Iterator[tuple[list[np.ndarray], list[float]]]:
        """For each text: the ids of its N best segmentations and their scores, best first."""
        b = Batch(self.p, texts, self.solved)
        for t in range(len(texts)):
            chunks = b.which[b.bounds[t] : b.bounds[t + 1]]
            best = float(b.best[chunks].sum())
            loss = b.loss[chunks]
            places: list[int] = []
            if self.n > 1 and len(loss):
                k = min(self.n - 1, len(loss))
                edge = np.partition(loss, k - 1)[k - 1]
                near = np.flatnonzero(loss <= edge)
                near = near[np.argsort(loss[near], kind="stable")][:k]
                places = sorted(int(x) for x in near if np.isfinite(loss[x]))
            found = [self.chunk_nbest(b.chunk(int(chunks[x]))) for x in places]
            rows = combine(best, [[f[0][0] - s for s, _ in f] for f in found], self.n)
            ids = b.ids_of(chunks)
            ends = np.concatenate([[0], np.cumsum(b.count[chunks])])
            lists = [ids]
            for _, ranks in rows[1:]:
                parts, at = [], 0
                for x, f, r in zip(places, found, ranks, strict=True):
                    if r:
                        parts += [ids[at : ends[x]], np.array(f[r][1], dtype=np.int32)]
                        at = ends[x + 1]
                lists.append(np.concatenate([*parts, ids[at:]]))
            yield lists, [s for s, _ in rows]


@lru_cache(1)
def segmenter(path: str, n: int) -> Segmenter:
    """One for all tasks of a worker: its tables and what it remembers depend on the model alone."""
    return Segmenter(path, n)


def _runs(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


MADE = ("n_pieces", "n_bytes", "ids_crc32", "n_segmentations", "scores", "decodes", "ids", "segmentations")
OUT = "n_pieces long, n_bytes long, ids_crc32 long, n_segmentations int, scores array<double>, decodes boolean, ids array<int>, segmentations array<array<int>>"


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _nested(lists: Sequence[np.ndarray]) -> pa.Array:
    """Id lists as one array of lists, without a Python object for each id."""
    return pa.ListArray.from_arrays(_offsets([len(x) for x in lists]), pa.array(np.concatenate(lists).astype(np.int32)))


def segmented(docs: DataFrame, model: str, n: int = N_BEST, text: str = "text") -> DataFrame:
    """The columns of docs, but for the text and any that are named like a result, and: pieces and byte pieces of the best segmentation, crc32 of its ids (unsigned 32-bit little-endian), the scores of the N best in order, whether all N decode to the text, the ids of the best, and those of all N."""
    keys = [c for c in docs.columns if c != text and c not in MADE]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(model, n)
        is_byte = np.zeros(len(seg.p.text), dtype=bool)
        is_byte[list(seg.p.byte_of)] = True
        for batch in batches:
            bodies = [x.as_py() or "" for x in batch.column(len(keys))]
            done = 0
            for part in _runs(bodies):
                rows = []
                for body, (lists, scores) in zip(part, seg(part), strict=True):
                    want, ids = body.encode("utf-8", "surrogatepass").replace(_MARK, b" "), lists[0]
                    same = seg.p.decoded(ids) == want and all(seg.p.alike(ids, x) for x in lists[1:])
                    rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), len(scores), scores, same, ids, lists))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.bool_())
                made = [pa.array(c, t) for c, t in zip(cols[:6], kinds, strict=True)]
                made += [_nested(cols[6]), pa.ListArray.from_arrays(_offsets([len(x) for x in cols[7]]), _nested([x for lists in cols[7] for x in lists]))]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(done, len(part)) for k in range(len(keys))], *made], names=[*keys, *MADE])
                done += len(part)

    narrow = docs.select(*keys, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != text)
    return map_batches(narrow, task, f"{head}, {OUT}")


def op3_nbest_astar(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """The four best segmentations of every whole text of documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segmented(docs, model or public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the best ids of each text and its N-best scores; n_chars goes. Null and empty texts have no ids and decode to an empty text; rows stay as they are in number, also repeated ones and those without an id; an empty table gives no rows."""
    import public_tokenizers

    return segmented(docs.select("doc_id", "lang", "source", F.col("text")), public_tokenizers.path("piece_bpe_32k.model")).drop("segmentations")
