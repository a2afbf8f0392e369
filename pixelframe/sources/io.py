"""Readers and writers: tables, zones, delimited text, FITS, remote SQL, staged runs."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ZONES = 50


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, rename: dict[str, str] | None = None, where: str | None = None, kind: str = "parquet") -> DataFrame:
    """Column list, rename map and filter; both reach the scan of a columnar file."""
    df = spark.read.format(kind).load(path)
    if where:
        df = df.where(where)
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in (columns or df.columns)])


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    out = df.select(*columns) if columns else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def zone(dec: Column) -> Column:
    return F.least(F.lit(ZONES - 1), F.floor((dec + 90.0) / (180.0 / ZONES))).cast("int")


def write_zones(df: DataFrame, path: str) -> None:
    """A catalogue with a column dec, laid out by declination zone: one shuffle, then a folder a zone."""
    df.withColumn("dec_zone", zone(F.col("dec"))).repartition("dec_zone", F.pmod(F.xxhash64("ra"), F.lit(8))).write.mode("overwrite").partitionBy("dec_zone").parquet(path)


def read_zones(spark: SparkSession, path: str, lo: float, hi: float) -> DataFrame:
    """Rows with lo <= dec < hi; only the folders of zones that overlap the range are listed and read."""
    first, last = (min(ZONES - 1, math.floor((d + 90.0) / (180.0 / ZONES))) for d in (lo, hi))
    return spark.read.parquet(path).where(F.col("dec_zone").between(first, last) & (F.col("dec") >= lo) & (F.col("dec") < hi))


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header line and given column types; a row that doesn't fit raises."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below a folder by name pattern: path, length, modificationTime."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def remote_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by a remote database through JDBC, whose driver has to be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable]], folder: str, upto: str, force: tuple[str, ...] = ()) -> DataFrame:
    """Run named stages in order, each (spark, previous DataFrame or None) -> DataFrame, and keep every result as Parquet; a finished stage is read back, not run again."""
    jvm = spark.sparkContext._jvm
    df, stale = None, False
    for name, stage in stages:
        path = f"{folder}/{name}"
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        done = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
        if stale or name in force or not done:
            stage(spark, df).write.mode("overwrite").parquet(path)
            stale = True
        df = spark.read.parquet(path)
        if name == upto:
            break
    return df


# --- FITS -----------------------------------------------------------------------------------

BLOCK, CARD = 2880, 80
_FORMS = {"L": ("u1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double")}


def _header(raw: bytes, at: int) -> tuple[dict[str, object], int]:
    """Cards of the header that begins at `at`, and where its data begin."""
    cards: dict[str, object] = {}
    while True:
        block = raw[at : at + BLOCK]
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] != "= ":
                continue
            body = card[10:]
            if m := re.match(r"\s*'((?:[^']|'')*)'", body):
                cards[key] = m[1].replace("''", "'").rstrip()
            else:
                v = body.split("/")[0].strip()
                cards[key] = v == "T" if v in ("T", "F") else float(v.replace("D", "E")) if re.search(r"[.EeD]", v) else int(v) if v else None
        if len(block) < BLOCK:
            raise ValueError("a header without END")


def _size(cards: dict) -> int:
    n = abs(int(cards.get("BITPIX", 8))) // 8
    dims = [int(cards[f"NAXIS{k}"]) for k in range(1, int(cards.get("NAXIS", 0)) + 1)]
    return (n * int(np.prod(dims)) + int(cards.get("PCOUNT", 0))) if dims else 0


def fits_units(raw: bytes) -> Iterator[tuple[dict, memoryview]]:
    """Header and data of each unit of a FITS file."""
    at = 0
    while at + BLOCK <= len(raw):
        cards, at = _header(raw, at)
        size = _size(cards)
        yield cards, memoryview(raw)[at : at + size]
        at += -(-size // BLOCK) * BLOCK


def _columns(cards: dict) -> list[tuple[str, int, str, int]]:
    """(name, repeats, code, offset) of each column of a binary table."""
    out, at = [], 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        m = re.match(r"(\d*)([A-Z])", str(cards[f"TFORM{k}"]))
        n, code = int(m[1] or 1), m[2]
        out.append((str(cards.get(f"TTYPE{k}", f"col{k}")), n, code, at))
        at += n * (1 if code == "A" else np.dtype(_FORMS[code][0]).itemsize)
    return out


def fits_schema(raw: bytes, hdu: int = 1) -> StructType:
    cards = next(c for k, (c, _) in enumerate(fits_units(raw)) if k == hdu)
    kind = lambda n, code: "string" if code == "A" else _FORMS[code][1] if n == 1 else f"array<{_FORMS[code][1]}>"
    return StructType.fromDDL(", ".join(f"`{name.lower()}` {kind(n, code)}" for name, n, code, _ in _columns(cards)))


def fits_rows(raw: bytes, wanted: list[str], hdu: int = 1) -> dict[str, pa.Array]:
    """The wanted columns of a binary table as Arrow arrays; other columns' bytes are skipped."""
    cards, data = next(u for k, u in enumerate(fits_units(raw)) if k == hdu)
    width, rows = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    table = np.frombuffer(data, dtype=np.uint8, count=width * rows).reshape(rows, width)
    out = {}
    for name, n, code, at in _columns(cards):
        if name.lower() not in wanted:
            continue
        if code == "A":
            part = np.ascontiguousarray(table[:, at : at + n])
            out[name.lower()] = pa.array([bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in part])
            continue
        dtype = np.dtype(_FORMS[code][0])
        part = np.ascontiguousarray(table[:, at : at + n * dtype.itemsize]).view(dtype).reshape(rows, n)
        part = part == ord("T") if code == "L" else part.astype(dtype.newbyteorder("=")) if code != "B" else part.astype(np.int32)
        if code == "I":
            part = part.astype(np.int32)
        flat = pa.array(part.ravel())
        out[name.lower()] = flat if n == 1 else pa.FixedSizeListArray.from_arrays(flat, n).cast(pa.list_(flat.type))
    return {c: out[c] for c in wanted}


def read_fits(spark: SparkSession, path: str, columns: list[str] | None = None, hdu: int = 1) -> DataFrame:
    """Binary tables of one layout, a file a task, from any file system that Spark reads. The schema comes from the first file."""
    files = spark.read.format("binaryFile").load(path)
    schema = fits_schema(bytes(files.select("content").first()["content"]), hdu)
    wanted = [c.lower() for c in columns] if columns else schema.fieldNames()
    chosen = StructType([schema[c] for c in wanted])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                cols = fits_rows(x.as_py(), wanted, hdu)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return files.select("content").mapInArrow(task, chosen)


def read_fits_images(spark: SparkSession, path: str, hdu: int = 0) -> DataFrame:
    """Images as pixels: path, x, y, d (double), with BSCALE and BZERO applied."""
    kinds = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cards, data = next(u for k, u in enumerate(fits_units(x.as_py())) if k == hdu)
                w, h = int(cards["NAXIS1"]), int(cards["NAXIS2"])
                img = np.frombuffer(data, dtype=kinds[int(cards["BITPIX"])], count=w * h).astype(np.float64).reshape(h, w)
                img = img * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
                for y in range(0, h, 256):
                    part = img[y : y + 256]
                    yy, xx = np.mgrid[y : y + len(part), :w]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(xx.ravel().astype(np.int32)), pa.array(yy.ravel().astype(np.int32)), pa.array(part.ravel())], names=["path", "x", "y", "d"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, "path string, x int, y int, d double")


def _cards(pairs: list[tuple[str, object]]) -> bytes:
    def text(v: object) -> str:
        return f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"

    raw = "".join(f"{f'{k:<8}= {text(v)}':<80}" for k, v in pairs) + f"{'END':<80}"
    return raw.encode("ascii").ljust(-(-len(raw) // BLOCK) * BLOCK)


def to_fits(columns: dict[str, np.ndarray]) -> bytes:
    """A FITS file with one binary table: numbers, booleans, text, and fixed-length arrays as two-dimensional columns."""
    codes = {"b": "L", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D"}
    fields, parts, rows = [], [], len(next(iter(columns.values()))) if columns else 0
    for name, v in columns.items():
        if v.dtype.kind in "OU":
            text = [str(x).encode("ascii", "replace") for x in v]
            n = max([1, *map(len, text)])
            fields.append((name, f"{n}A"))
            parts.append(np.frombuffer(b"".join(x.ljust(n) for x in text), dtype=np.uint8).reshape(rows, n))
            continue
        code = "L" if v.dtype.kind == "b" else codes[v.dtype.kind + str(v.dtype.itemsize)]
        n = v.shape[1] if v.ndim == 2 else 1
        raw = np.where(v, ord("T"), ord("F")).astype(np.uint8) if code == "L" else v.astype(_FORMS[code][0])
        fields.append((name, f"{n}{code}"))
        parts.append(np.ascontiguousarray(raw).view(np.uint8).reshape(rows, n * raw.dtype.itemsize))
    body = np.concatenate(parts, axis=1).tobytes() if parts else b""
    width = sum(p.shape[1] for p in parts)
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]
    for k, (name, form) in enumerate(fields, 1):
        head += [(f"TTYPE{k}", name), (f"TFORM{k}", form)]
    return _cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + _cards(head) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
