"""FITS binary tables as a Spark data source: spark.read.format("fits") and df.write.format("fits").

Files are split by bytes. A task reads the headers of its file and then the rows that begin inside
its split, so a large file is read by many tasks and the driver reads one header. Only
the columns of the given schema are decoded. A column of the schema that the table doesn't have is
a card of its header, or of the file's first header. Without a schema all columns of the first
file are taken.

Columns scaled by TSCAL and TZERO are doubles, but integers where they only move the range of an
unsigned number; TNULL gives null. Complex numbers and bits are arrays, and arrays of varying
length come from the heap. Options: hdu (1), split (bytes a task, 32 MiB). Paths are files,
folders (all *.fits below) or lists joined by commas, on any file system that Arrow reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .io import BLOCK, CARD, _header, _size, to_fits

#: Bytes and number type of each column code.
CODES = {"L": ("u1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "C": (">f4", "float"), "M": (">f8", "double"), "P": (">i4", ""), "Q": (">i8", "")}
#: Offsets that make signed numbers unsigned, and bytes signed.
UNSIGNED = {"B": -128, "I": 1 << 15, "J": 1 << 31}
CHUNK = 4 << 20


@dataclass
class Field:
    """One column: its code, numbers a cell, bytes and place in a row, element code of arrays in the heap, scale, offset and null."""

    name: str
    code: str
    n: int
    at: int
    width: int
    inner: str
    scale: float
    zero: float
    null: int | None

    @property
    def moved(self) -> bool:
        code = self.inner or self.code
        return self.scale == 1 and (self.zero == 0 or self.zero == UNSIGNED.get(code))

    @property
    def kind(self) -> str:
        code = self.inner or self.code
        one = "string" if code == "A" else "boolean" if code == "X" else CODES[code][1]
        if code not in "AXL" and not self.moved:
            one = "double"
        elif code == "J" and self.zero:
            one = "bigint"
        many = self.inner or code in "XCM" or (self.n != 1 and code != "A")
        return f"array<{one}>" if many else one


def fields(cards: dict) -> list[Field]:
    """The columns that a table's header describes."""
    out, at = [], 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        m = re.match(r"(\d*)([LXBIJKAEDCMPQ])([LBIJKEDCM]?)", str(cards[f"TFORM{k}"]).strip())
        if not m:
            raise ValueError(f"column {k} has the unknown form {cards[f'TFORM{k}']}")
        n, code = int(m[1] or 1), m[2]
        width = n if code == "A" else -(-n // 8) if code == "X" else n * np.dtype(CODES[code][0]).itemsize * (2 if code in "CMPQ" else 1)
        null = cards.get(f"TNULL{k}")
        name = str(cards.get(f"TTYPE{k}", f"col{k}")).lower()
        out.append(Field(name, code, n, at, width, m[3] if code in "PQ" else "", float(cards.get(f"TSCAL{k}", 1)), float(cards.get(f"TZERO{k}", 0)), None if null is None else int(null)))
        at += width
    return out


@dataclass
class Unit:
    cards: dict
    first: dict
    start: int
    width: int
    rows: int


def unit(file: pa.NativeFile, hdu: int) -> Unit:
    """Header hdu of an open file, and where its rows lie; data in front of it are skipped."""
    at, first = 0, {}
    for k in range(hdu + 1):
        raw = b""
        while not any(raw[i : i + CARD] == b"END".ljust(CARD) for i in range(max(0, len(raw) - BLOCK), len(raw), CARD)):
            file.seek(at + len(raw))
            block = file.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError(f"no unit {hdu}, or a header without END")
            raw += block
        cards, _ = _header(raw, 0)
        first = first or cards
        start = at + len(raw)
        at = start + -(-_size(cards) // BLOCK) * BLOCK
    return Unit(cards, first, start, int(cards["NAXIS1"]), int(cards["NAXIS2"]))


def _numbers(raw: np.ndarray, f: Field, code: str) -> pa.Array:
    """Cells of big-endian bytes, flat, as an Arrow array with scale, offset and null applied."""
    v = raw.view(CODES[code][0])
    if code == "L":
        return pa.array(v == ord("T"), mask=v == 0)
    gone = v == f.null if f.null is not None and code in "BIJK" else None
    v = v.astype(np.dtype(CODES[code][0]).newbyteorder("="))
    if not f.moved:
        v = v.astype(np.float64) * f.scale + f.zero
    elif code in "BIJ":
        v = v.astype(np.int64 if code == "J" and f.zero else np.int32) + (int(f.zero) if code != "J" or f.zero else 0)
    return pa.array(v, mask=gone)


def decode(table: np.ndarray, f: Field, heap) -> pa.Array:
    """A column from the bytes of whole rows (row, byte). heap(offset, size) gives bytes of the heap."""
    part = np.ascontiguousarray(table[:, f.at : f.at + f.width])
    if f.code == "A":
        return pa.array([bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in part], pa.string())
    if f.code == "X":
        return pa.array(list(np.unpackbits(part, axis=1)[:, : f.n].astype(bool)), pa.list_(pa.bool_()))
    if f.inner:
        size = np.dtype(CODES[f.inner][0]).itemsize * (2 if f.inner in "CM" else 1)
        place = part.view(CODES[f.code][0]).reshape(len(part), -1)[:, :2].astype(np.int64)
        cells = [heap(int(o), int(c) * size) for c, o in place]
        flat = _numbers(np.frombuffer(b"".join(cells), np.uint8), f, f.inner)
        ends = np.concatenate([[0], np.cumsum(place[:, 0] * (2 if f.inner in "CM" else 1))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
    flat, n = _numbers(part.reshape(-1), f, f.code), f.n * (2 if f.code in "CM" else 1)
    if not f.kind.startswith("array"):
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), flat)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of each file of a list of files and folders, in order."""
    out = []
    for p in (p.strip() for p in path.split(",")):
        system, local = fs.FileSystem.from_uri(p)
        root = p[: len(p) - len(local)] if p.endswith(local) else ""
        info = system.get_file_info(local)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(local, recursive=True)) if i.is_file and i.extension == "fits" and "/_" not in i.path[len(local.rstrip("/")) :]]
        out += sorted((root + i.path, i.size) for i in found)
    return out


def opened(path: str) -> pa.NativeFile:
    system, local = fs.FileSystem.from_uri(path)
    return system.open_input_file(local)


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.hdu, self.split = int(options.get("hdu", 1)), int(options.get("split", 32 << 20))

    def partitions(self) -> list[Split]:
        return [Split(p, at, at + self.split) for p, size in files(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        want = to_arrow_schema(self.schema)
        with opened(partition.path) as file:
            u = unit(file, self.hdu)
            # rows that begin inside the split, counted from the unit's start
            lo, hi = (min(u.rows, max(0, -(-(b - u.start) // max(1, u.width)))) for b in (partition.begin, partition.end))
            have = {f.name: f for f in fields(u.cards)}
            heap_at = u.start + int(u.cards.get("THEAP", u.width * u.rows))

            def heap(offset: int, size: int) -> bytes:
                file.seek(heap_at + offset)
                return file.read(size)

            step = max(1, CHUNK // max(1, u.width))
            for k in range(lo, hi, step):
                n = min(step, hi - k)
                file.seek(u.start + k * u.width)
                table = np.frombuffer(file.read(n * u.width), np.uint8)
                if table.size < n * u.width:
                    raise ValueError(f"{partition.path} ends inside a row")
                table = table.reshape(n, u.width)
                yield pa.RecordBatch.from_arrays([self._column(c, table, have, u, heap) for c in want], schema=want)

    @staticmethod
    def _column(c: pa.Field, table: np.ndarray, have: dict[str, Field], u: Unit, heap) -> pa.Array:
        if f := have.get(c.name.lower()):
            return decode(table, f, heap).cast(c.type)
        for cards in (u.cards, u.first):
            if (v := cards.get(c.name.upper())) is not None:
                v = str(v) if pa.types.is_string(c.type) else v
                return pa.array([v]).cast(c.type).take(pa.array(np.zeros(len(table), np.int32)))
        raise ValueError(f"neither a column nor a header card is named {c.name}")


def _array(c: pa.ChunkedArray) -> np.ndarray:
    """A column for to_fits. Null texts are empty and null floats NaN, as a table can't tell them apart; other nulls raise."""
    if pa.types.is_string(c.type):
        return np.array([v or "" for v in c.to_pylist()], object)
    if c.null_count and not pa.types.is_floating(c.type):
        raise ValueError("nulls can only be written in columns of text, float or double")
    got = np.array(c.to_pylist(), float) if c.null_count else np.array(c.to_pylist())
    return got.astype({pa.float32(): "f4", pa.int32(): "i4", pa.int16(): "i2"}.get(c.type, got.dtype))


class FitsWriter(DataSourceArrowWriter):
    """Files of at most `rows` rows (2^18), moved into their place when all tasks have ended.

    Files already there are kept, or deleted at the end when overwriting. What a failed task has
    written is deleted, and what one writes that outlives the failure of its job stays in a folder
    that readers don't look at.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run, self.rows = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex, int(options.get("rows", 1 << 18))

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = self._place()
        names, held, n = [], [], 0

        def put() -> None:
            t = pa.Table.from_batches(held)
            names.append(f"part-{uuid.uuid4().hex}.fits")
            system.create_dir(f"{root}/_{self.run}", recursive=True)
            with system.open_output_stream(f"{root}/_{self.run}/{names[-1]}") as out:
                out.write(to_fits({c: _array(t[c]) for c in t.column_names}))

        for batch in batches:
            for k in range(0, batch.num_rows, self.rows):
                part = batch.slice(k, self.rows)
                if n and n + part.num_rows > self.rows:
                    put()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            put()
        return Done(names)

    def commit(self, messages: list[Done]) -> None:
        system, root = self._place()
        system.create_dir(root, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.extension == "fits"] if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{root}/_{self.run}/{name}", f"{root}/{name}")
        for p in old:
            system.delete_file(p)
        self._clean(system, root)

    def abort(self, messages: list[Done]) -> None:
        self._clean(*self._place())

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no FITS file in {self.options['path']}")
        with opened(found[0][0]) as file:
            return ", ".join(f"`{f.name}` {f.kind}" for f in fields(unit(file, int(self.options.get("hdu", 1))).cards))

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsSource)
