"""Byte-level BPE of many texts at once through the tokenizers library.

Byte-level BPE cuts a text into pre-tokens by a fixed pattern and merges inside them only, so
the ids of a text are those of its pre-tokens in order. Here a batch of texts is cut in numpy,
its distinct pre-tokens are found by hash, and the library's model encodes each of them once.
The ids of earlier pre-tokens are remembered by hash, up to a bound.

Only texts of characters whose class no version of Unicode changes (Latin and general
punctuation) are cut here; every other text, any text with a control string of the vocabulary,
and any vocabulary of another kind go to the library whole. Tests hold both ways equal.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from .shingles import mix

CHUNK, REMEMBERED = 1 << 21, 600_000
OTHER, LETTER, NUMBER, WHITE, UNSURE = 0, 1, 2, 3, 255
_RANGES = (range(0x250), range(0x2000, 0x2070))
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _classes() -> np.ndarray:
    out = np.full(0x2071, UNSURE, dtype=np.uint8)
    for c in (c for r in _RANGES for c in r):
        kind = unicodedata.category(chr(c))
        out[c] = WHITE if c in _WHITE else UNSURE if kind == "Cn" else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return out


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


CLASS, BYTE = _classes(), _byte_characters()
CODE = mix(np.arange(len(CLASS), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def cut(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start of every pre-token in codes; first marks where each text begins.

    Contractions, then an optional space and letters, numbers or other characters, then white
    space but for the last character before something else, then white space.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = CLASS[codes]
    begin = first.copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    what = kind[runs]
    more = np.zeros(len(runs), dtype=bool)
    more[:-1] = ~first[runs[1:]]
    start = begin
    white = (what == WHITE) & more
    start[ends[white & (ends - runs >= 2)] - 1] = True
    start[ends[white][codes[ends[white] - 1] == 32]] = False
    quote = np.flatnonzero((what == OTHER) & (ends - runs == 1) & more & (codes[runs] == 39) & start[runs])
    quote = quote[what[quote + 1] == LETTER]
    if len(quote):
        q, stop = ends[quote], ends[quote + 1]
        a = codes[q]
        b = np.where(q + 1 < stop, codes[np.minimum(q + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & np.isin(a, [ord("r"), ord("v")])) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        start[q[hit]] = False
        after = (q + size)[hit & (q + size < stop)]
        start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """ids (uint32 arrays) of texts, in order."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        self.vocab = self.lib.get_vocab_size()
        spec = json.loads(self.lib.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.fast = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens") or []]
        self.plain_only = [t["content"] for t in spec.get("added_tokens") or []] if special_as_text and any(not t["special"] for t in spec.get("added_tokens") or []) else []
        self.model = self.lib.model
        self.known: dict[int, bytes] = {}
        self.power = [np.ones(1, np.uint64)] * 2

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        texts = iter(texts)
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= CHUNK or len(held) >= 4096:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        if not self.fast:
            return [self.plain(t) for t in texts]
        bad = [any(s in t for s in self.special) or any(s in t for s in self.plain_only) for t in texts]
        parts = [np.frombuffer(b"" if x else t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t, x in zip(texts, bad, strict=True)]
        for k, p in enumerate(parts):
            if len(p) and (CLASS[np.minimum(p, len(CLASS) - 1)] == UNSURE).any():
                bad[k], parts[k] = True, p[:0]
        size = np.array([len(p) for p in parts], dtype=np.int64)
        bound = np.concatenate([[0], np.cumsum(size)])
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        first = np.zeros(len(codes), dtype=bool)
        first[bound[:-1][size > 0]] = True
        starts = cut(codes, first)
        flat, count, which = self._ids(codes, starts)
        offset = np.concatenate([[0], np.cumsum(count)])
        each = count[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(total[-1]) + np.repeat(offset[which] - total[:-1], each)] if len(which) else np.zeros(0, np.uint32)
        at = total[np.searchsorted(starts, bound)]
        return [self.plain(t) if b else ids[at[k] : at[k + 1]] for k, (t, b) in enumerate(zip(texts, bad, strict=True))]

    def _ids(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the distinct pre-tokens one after another, how many each has, and which one stands at each start."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.append(starts[1:], n)
        if len(self.power[0]) <= n:
            self.power = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
        power, inverse = self.power
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODE[codes] * inverse[1 : n + 1])])
            h = mix((total[ends] - total[starts]) * power[ends] + (ends - starts).astype(np.uint64))
        keys, index, which = np.unique(h, return_index=True, return_inverse=True)
        known = self.known
        found = list(map(known.get, keys.tolist()))
        raw = codes.tobytes()
        new = [k for k, got in enumerate(found) if got is None]
        at = index[new]
        for k, a, b, key in zip(new, (4 * starts[at]).tolist(), (4 * ends[at]).tolist(), keys[new].tolist(), strict=True):
            found[k] = got = self._encode(raw[a:b].decode("utf-32-le", "surrogatepass"))
            if len(known) < REMEMBERED:
                known[key] = got
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4, which

    def _encode(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", BYTE[32])
        else:
            spelled = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

