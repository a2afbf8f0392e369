"""Helpers shared by the training-data operators: table access, durable intermediate tables, word lists."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_us

#: Java pattern of a run of separators between words (space, tab, LF, VT, FF, CR).
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path goes to Spark's reader unchanged, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine; an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="pixelframe-shared-"))
        path = _OWN[0]
    return path.rstrip("/")


#: Folders made by this driver, for clear().
_MADE: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Delete all intermediate folders made so far. Results that are still to be read from them are lost, so write those first."""
    while _MADE:
        remove(spark, _MADE.pop())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop the files of their shuffles as they end, and not when the driver happens to collect garbage. For results that are executed once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors. The shuffles behind it are dropped as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.written_to)
        if df.written_to in _MADE:
            _MADE.remove(df.written_to)


#: Rows of a few numbers, and rows with a text of a few words, that may be broadcast.
FEW_NUMBERS, FEW_TEXTS = 1_000_000, 100_000


def sized(df: DataFrame, limit: int) -> DataFrame:
    """df, a written table, marked for broadcast if it has at most `limit` rows and for a shuffled join otherwise. The size of a compressed file says little about that."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


#: A prefilter has at most so many bitmaps of 4,096 bytes (32 MB together), and eight bits for each key until then.
BITMAP_BITS, MOST_BITMAPS = 32_768, 8_192


def maybe_in(df: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df that may have an equal row in keys over the columns of that name, and rows that surely have none.

    A hashed bitmap of the keys, broadcast, of a size that follows their number up to a fixed
    bound. With more keys than the bound serves more rows pass into the first part, which costs
    time and no result; joins with keys then shuffle that part alone.
    """
    of = lambda *c: F.xxhash64(*c)
    n = keys.count()
    count = max(1, min(MOST_BITMAPS, -(-8 * n // BITMAP_BITS)))
    bucket = lambda h: F.pmod(h, F.lit(count)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 20), F.lit(BITMAP_BITS))
    maps = keys.select(of(*columns).alias("h")).groupBy(bucket(F.col("h")).alias("__bucket")).agg(F.bitmap_construct_agg(bit(F.col("h"))).alias("__bits"))
    h = of(*columns)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit(h) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.join(F.broadcast(maps), bucket(h) == F.col("__bucket"), "left")
    hit = F.coalesce(F.call_function("shiftright", byte, F.pmod(bit(h), F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Maximal runs of non-separators; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of one byte a character go through the faster lower(), which changes the same letters there."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array of ints, op over all elements before it, from zero. Long arrays go in blocks of the square root of their size, as an array that grows by one element is copied each time."""

    def plain(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("s"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda b: F.slice(v, b * size + 1, size))
        before = lambda p: plain(F.transform(p, lambda b: F.aggregate(b, zero, op)), zero)
        return let(parts, lambda p: let(before(p), lambda starts: F.flatten(F.transform(p, lambda b, i: plain(b, F.get(starts, i))))))

    return let(values, lambda v: F.when(F.size(v) <= 64, plain(v, zero)).otherwise(blocks(v)))


def spread(df: DataFrame, values: Column, name: str) -> DataFrame:
    """df with a row for each array element. explode() would add a filter on the array's size, which Spark pushes to the scan and so evaluates the whole expression twice and inside itself; the outer form has none."""
    return df.withColumn(name, F.explode_outer(values)).where(F.col(name).isNotNull())


def kept_where(df: DataFrame, condition: Column) -> DataFrame:
    """df where condition holds, tested after the columns it reads: a row number that Spark may not push a filter through fences the costly expressions off."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where(condition & (F.col("_fence") >= 0)).drop("_fence")


#: Rows that a Python worker gets at once. Texts are long, and two of them meet in some rows.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(task, schema) in batches of at most BATCH_ROWS rows: the session's Arrow batches are lowered to that where they are larger."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    workers_find_us(df.sparkSession)
    return df.mapInArrow(task, schema)


def written_batches(df: DataFrame, task: Callable, schema: str, tag: str, rows: int) -> DataFrame:
    """df.mapInArrow(task, schema) in batches of at most that many rows, for rows of some megabytes, written; the session's setting is as before afterwards."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key)
    workers_find_us(df.sparkSession)
    conf.set(key, str(rows))
    try:
        return written(df.mapInArrow(task, schema), tag)
    finally:
        conf.set(key, before)
