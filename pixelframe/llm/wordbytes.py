"""Words of letters, digits and all beyond ASCII, as UTF-8 bytes with A-Z lower-cased, for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Byte by byte: A-Z become a-z; a-z, digits and bytes from 0x80 on stay; all else separates.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


class Numbers(dict):
    """Numbers words in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: bytes | None) -> list[bytes]:
    """The words of one text; null and empty texts have none."""
    return text.translate(TABLE).split() if text else []


#: So many words are held at once; a text is never cut, so a longer one makes a lot of its own.
LOT_WORDS = 1 << 20


def lots(batch: pa.RecordBatch, text: str, most: int = LOT_WORDS) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first row, words, words of each row) for runs of rows of a batch, in order, that cover every row."""
    column = batch.column(text).cast(pa.large_binary())
    first, held, sizes = 0, [], []
    for i in range(len(column)):
        w = words_of(column[i].as_py())
        if held and len(held) + len(w) > most:
            yield first, held, np.array(sizes, np.int64)
            first, held, sizes = i, [], []
        held.extend(w)
        sizes.append(len(w))
    if sizes:
        yield first, held, np.array(sizes, np.int64)
