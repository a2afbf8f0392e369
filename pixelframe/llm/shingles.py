"""Hashed word shingles of many texts at once, in numpy.

Words are found in the bytes of a chunk of texts; a word's hash is a polynomial over its
bytes, read off one running sum, and a shingle mixes the hashes of its words in order. All
hashes are 64 bits and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 .. n-1 and their inverses modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of its text, in order; with lower, A-Z count as a-z."""
    buf = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    sep = _SEPARATOR[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    with np.errstate(over="ignore"):
        total = np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[buf] * power[: len(buf)])
        h = (total[ends - 1] - total[starts - 1]) * inverse[starts]
        h = mix(h + (ends - starts).astype(np.uint64))
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    return h, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list[bytes], k: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: of k words, or the whole sequence where there are fewer, or none."""
    h, doc = word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    with np.errstate(over="ignore"):
        rolled = h[: max(0, len(h) - k + 1)].copy()
        for j in range(1, k):
            rolled = mix(rolled * np.uint64(3) + h[j : j + len(rolled)])
    at = 0
    for n in n_words.tolist():
        if n == 0:
            yield np.zeros(0, dtype=np.uint64)
        elif n < k:
            with np.errstate(over="ignore"):
                whole = h[at : at + 1] + np.uint64(n)
                for j in range(1, n):
                    whole = mix(whole * np.uint64(5) + h[at + j : at + j + 1])
            yield mix(whole + np.uint64(k))
        else:
            s = np.sort(rolled[at : at + n - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        at += n


def chunks(texts: Iterator[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of at most limit bytes together, or a single longer one; null is empty."""
    held, size = [], 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def all_sets(texts: Iterator[bytes | None], k: int = 3) -> Iterator[np.ndarray]:
    for part in chunks(texts):
        yield from shingle_sets(part, k)
