"""Token files: independent zstandard frames with a trailing seek table.

Layout of a file, all integers little-endian:

    frame*                      zstandard frames with content checksums; each holds the ids of whole documents
    skippable frame 0x184D2A5D  document index, itself a zstandard frame: a JSON line, then a row
                                (doc_id i64, frame u32, first token u32, tokens u32) for each document
    skippable frame 0x184D2A5E  seek table of the zstandard seekable format: for each frame compressed size,
                                size, XXH64's low 32 bits (u32 each); number of frames u32, flags u8, 0x8F92EAB1

A reader takes the tail of the file, then only the frames of the documents it wants.
Plain zstandard tools decompress the file as well. Ids take two bytes where the vocabulary
allows, else four.

Files lie in a folder that executors share (pyarrow's file systems: local or mounted paths,
hdfs and others where their client library is installed). A task writes under its attempt's
name and renames at the end; the manifest names the files of the attempts that succeeded, so
lost executors and repeated tasks leave no trace in what is read.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first and
is kept as -2**63; repeated ids keep one entry for each row, in text order; an empty table
writes no file; other columns are ignored. Control strings of the vocabulary inside a text
are ordinary text only where `special_as_text` is set.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, table
from .pretokens import Encoder

FRAME_TOKENS = 1 << 16
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("tokens", "<u4")])
SEEK_ROW = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
NO_ID = -(2**63)
END_ID = 0


class Writer:
    """Writes one file; close() ends it with its index and seek table."""

    def __init__(self, stream, vocab: int, frame_tokens: int = FRAME_TOKENS):
        self.stream, self.dtype = stream, np.dtype("<u2" if vocab <= 1 << 16 else "<u4")
        self.frame_tokens, self.pending, self.held = frame_tokens, [], 0
        self.index, self.seek, self.tokens, self.docs = [], [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: list[int] | np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_tokens:
            self._flush()
        self.index.append((NO_ID if doc_id is None else doc_id, len(self.seek), self.held, len(ids)))
        self.pending.append(np.asarray(ids).astype(self.dtype))
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs += 1

    def _flush(self) -> None:
        raw = np.concatenate(self.pending).tobytes()
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        head = json.dumps({"dtype": self.dtype.str, "docs": self.docs, "tokens": self.tokens}).encode() + b"\n"
        body = self.packer.compress(head + np.array(self.index, dtype=INDEX_ROW).tobytes())
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        rows = np.array(self.seek, dtype=SEEK_ROW).tobytes()
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE))


class Reader:
    """Random access to one file opened for seeking."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - 9 - n * SEEK_ROW.itemsize
        stream.seek(at)
        self.seek = np.frombuffer(stream.read(n * SEEK_ROW.itemsize), dtype=SEEK_ROW)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        stream.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index behind the frames")
        head, _, rows = zstandard.ZstdDecompressor().decompress(stream.read(length)).partition(b"\n")
        self.dtype = np.dtype(json.loads(head)["dtype"])
        self.index = np.frombuffer(rows, dtype=INDEX_ROW)

    def frame(self, k: int) -> np.ndarray:
        self.stream.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.seek["packed"][k])), max_output_size=int(self.seek["size"][k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.seek["check"][k]):
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, dtype=self.dtype)

    def rows(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order, of all documents or of the wanted ids; only their frames are read."""
        chosen = self.index if wanted is None else self.index[np.isin(self.index["doc_id"], np.fromiter(wanted, dtype=np.int64))]
        at, ids = -1, None
        for doc_id, k, first, n in chosen.tolist():
            if k != at:
                at, ids = k, self.frame(k)
            yield doc_id, ids[first : first + n]


def open_reader(uri: str) -> Reader:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path), fs.get_file_info(path).size)


MANIFEST = "part long, file string, docs long, tokens long, frames long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, special_as_text: bool = False) -> list[tuple]:
    """Encode the documents in ascending order of key and write one file for each range of keys.

    Returns the manifest, sorted: (part, file, docs, tokens, frames), one row a file.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
        writer = stream = None
        encode = Encoder(tokenizer, special_as_text)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(f"{base}/_{name}", compression=None)
                    writer = Writer(stream, encode.vocab)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(f"{base}/_{name}", f"{base}/{name}")
            row = [[context.partitionId()], [f"{folder}/{name}"], [writer.docs], [writer.tokens], [len(writer.seek)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.string()), *[pa.array(c, pa.int64()) for c in row[2:]]], names=["part", "file", "docs", "tokens", "frames"])

    ordered = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return sorted(tuple(r) for r in map_batches(ordered, task, MANIFEST).collect())


def scan_tokens(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of the manifest, a task for each."""
    starts, total = [], 0
    for _, file, _, tokens, _ in manifest:
        starts.append((file, total))
        total += tokens
    known = spark.sparkContext.broadcast(starts)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file, at = known.value[k]
                rows = []
                for doc_id, ids in open_reader(file).rows():
                    rows.append((None if doc_id == NO_ID else doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    n = len(manifest)
    return map_batches(spark.range(0, n, 1, max(1, n)), task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_seekable_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents: encoded, written in ascending doc_id order, and read back from the files."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, f"tokens-{uuid.uuid4().hex[:6]}"), path)
    return scan_tokens(spark, manifest)
