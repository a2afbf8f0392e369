"""Sharding by fixed virtual slots.

A record hashes to one of `n_slots` virtual slots for ever. Bytes and rows are added up
for each slot (a table of at most n_slots rows, whatever the corpus size), and a small
versioned map says which shard holds a slot. Rebalancing edits the map, never the hash,
so only the slots whose entry changes move.

A stored map is found again by its folder: its newest version is read, edited by rebalancing or
by adding shards where that is called for, and the edited map is stored as the next version.

Defined results: a null text has no bytes and still counts one byte (its size is
bytes + 1); a null key hashes like any value; repeated rows each get their own place;
an empty table gives an empty result and a map without loads. Columns of the input
besides the key and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

N_SLOTS = 8192


def slot_of(*key: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a key; it never changes with the number of shards."""
    return F.pmod(F.xxhash64(*key), F.lit(n_slots).cast("long")).cast("int")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, by_text: bool = False) -> DataFrame:
    """key, size (UTF-8 bytes + 1), text_crc32, vslot for each row. With by_text a record is its key and text, so that rows of one key spread over slots."""
    body = F.coalesce(F.col(text), F.lit(""))
    record = [F.col(key), F.crc32(body.cast("binary"))] if by_text else [F.col(key)]
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        slot_of(*record, n_slots=n_slots).alias("vslot"),
    )


def slot_loads(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) of the slots in use. At most n_slots rows reach the driver."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["vslot"], r["b"], r["n"]) for r in got)


@dataclass
class SlotMap:
    """Slot -> shard, with the loads it was made from. Versions count up from 1."""

    n_slots: int
    n_shards: int
    shard: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    def loads(self, slots: list[tuple[int, int, int]]) -> list[int]:
        out = [0] * self.n_shards
        for s, b, _ in slots:
            out[self.shard[s]] += b
        return out


def build_map(slots: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Heaviest slot first to the shard with the fewest bytes (ties: lower slot, lower shard); unused slots go round."""
    shard = [s % n_shards for s in range(n_slots)]
    loads = [0] * n_shards
    for s, b, _ in sorted(slots, key=lambda x: (-x[1], x[0])):
        to = loads.index(min(loads))
        shard[s] = to
        loads[to] += b
    return SlotMap(n_slots, n_shards, shard)


def rebalance(old: SlotMap, slots: list[tuple[int, int, int]], tolerance: float = 0.01) -> SlotMap:
    """Move as few bytes as needed: the heaviest slot that fits goes from the fullest to the emptiest shard until they differ by at most tolerance of the mean."""
    shard, loads, moved = list(old.shard), old.loads(slots), []
    limit = tolerance * (sum(loads) / max(1, old.n_shards))
    by_shard: dict[int, list[tuple[int, int]]] = {k: [] for k in range(old.n_shards)}
    for s, b, _ in slots:
        by_shard[shard[s]].append((b, s))
    while loads and max(loads) - min(loads) > limit:
        src, dst = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[src] - loads[dst]
        fits = [x for x in by_shard[src] if x[0] < gap]
        if not fits:
            break
        b, s = max(fits, key=lambda x: (min(x[0], gap - x[0]), -x[1]))
        by_shard[src].remove((b, s))
        by_shard[dst].append((b, s))
        loads[src] -= b
        loads[dst] += b
        shard[s] = dst
        moved.append(s)
    return SlotMap(old.n_slots, old.n_shards, shard, old.version + 1, moved)


def grow(old: SlotMap, slots: list[tuple[int, int, int]], shards: int = 1) -> SlotMap:
    """Add shards; slots move only into the new ones, until each holds its share of the bytes."""
    n = old.n_shards + shards
    wide = SlotMap(old.n_slots, n, list(old.shard), old.version + 1)
    loads, size = wide.loads(slots), {s: b for s, b, _ in slots}
    share = sum(loads) / max(1, n)
    held: dict[int, list[int]] = {k: [] for k in range(n)}
    for s in sorted(size, key=lambda s: (size[s], s)):
        held[wide.shard[s]].append(s)
    for new in range(old.n_shards, n):
        while True:
            src = max(range(old.n_shards), key=lambda k: (loads[k], -k))
            if not held[src] or loads[new] + size[held[src][-1]] > share:
                held_fit = [s for s in held[src] if loads[new] + size[s] <= share]
                if not held_fit:
                    break
                s = held_fit[-1]
            else:
                s = held[src][-1]
            held[src].remove(s)
            loads[src] -= size[s]
            loads[new] += size[s]
            wide.shard[s] = new
            wide.moved.append(s)
    return wide


def versions_of(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The versions under path: those written to the end, and all that have a folder, as writers that died leave one behind."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    begun = {int(f.getName().removeprefix("map_version=")): f for f in folders if f.getName().startswith("map_version=")}
    return sorted(v for v, f in begun.items() if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))), sorted(begun)


def newest_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest whole version stored under path, or None. It has n_slots rows, whatever the corpus size."""
    versions, _ = versions_of(spark, path)
    if not versions:
        return None
    got = sorted((r["vslot"], r["shard"], r["n_shards"]) for r in spark.read.parquet(f"{path}/map_version={max(versions)}").select("vslot", "shard", "n_shards").collect())
    return SlotMap(len(got), got[0][2], [s for _, s, _ in got], max(versions))


def store_map(spark: SparkSession, smap: SlotMap, slots: list[tuple[int, int, int]], path: str) -> DataFrame:
    """Write the map as a new version under path and read it back: version, n_shards, vslot, shard, bytes, rows.

    The table has n_slots rows, whatever the corpus. The version is the next number beyond every
    folder there, so what a writer that died left behind is neither read nor in the way. Of two
    writers at once the second fails; it may read the newest map and edit that.
    """
    smap.version = max(smap.version, 1 + max(versions_of(spark, path)[1], default=0))
    load = {s: (b, n) for s, b, n in slots}

    def column(values: list[int], kind: str) -> Column:
        return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("vslot"))

    spark.range(smap.n_slots).select(
        F.lit(smap.version).alias("version"),
        F.lit(smap.n_shards).alias("n_shards"),
        F.col("id").cast("int").alias("vslot"),
    ).select(
        "version",
        "n_shards",
        "vslot",
        column(smap.shard, "int").alias("shard"),
        column([load.get(s, (0, 0))[0] for s in range(smap.n_slots)], "bigint").alias("bytes"),
        column([load.get(s, (0, 0))[1] for s in range(smap.n_slots)], "bigint").alias("rows"),
    ).coalesce(1).write.parquet(f"{path}/map_version={smap.version}")
    return spark.read.parquet(f"{path}/map_version={smap.version}")


def assign(rows: DataFrame, stored: DataFrame, slots: list[tuple[int, int, int]]) -> DataFrame:
    """Shard and gapless place in the shard for each row of measured(), whose slot loads are given. A place is the number of rows in the shard's lower slots and the row's rank in its slot. The map has a fixed number of rows, so it is broadcast."""
    load = {s: n for s, _, n in slots}
    n = F.coalesce(F.get(F.from_json(F.lit(json.dumps([load.get(s, 0) for s in range(max(load, default=0) + 1)])), "array<bigint>"), F.col("vslot")), F.lit(0))
    lower = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored.select("vslot", "shard", n.alias("n")).select("vslot", "shard", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("first"))
    in_slot = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(F.broadcast(firsts), "vslot")
        .withColumn("rank", F.row_number().over(in_slot))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "vslot")
    )


def edited(old: SlotMap | None, slots: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """The map for these loads: the old one where it still serves, the old one rebalanced or with more shards (rows move into those alone), or a new one where there is none or it has other slots or more shards. An empty table leaves an old map as it is."""
    if old is None or old.n_slots != n_slots or old.n_shards > n_shards:
        fresh = build_map(slots, n_shards, n_slots)
        fresh.version = old.version + 1 if old else 1
        return fresh
    if old.n_shards < n_shards:
        return grow(old, slots, n_shards - old.n_shards)
    even = rebalance(old, slots)
    return even if even.moved else old


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, path: str | None = None, by_text: bool = False) -> DataFrame:
    """Measure, find the newest map under path, edit and store it where needed, and place every row. Without a path the map is new."""
    spark = docs.sparkSession
    path = path or new_path(spark, "slotmap")
    rows = measured(docs, n_slots=n_slots, by_text=by_text)
    slots = slot_loads(rows)
    old = newest_map(spark, path)
    smap = edited(old, slots, n_shards, n_slots)
    stored = store_map(spark, smap, slots, path) if smap is not old else spark.read.parquet(f"{path}/map_version={smap.version}")
    return assign(rows, stored, slots)


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 under the law of near-equal bytes, with a new map, so that no earlier run decides. Rows that repeat an id spread by their texts."""
    placed = shard(table(spark, sf_dir, "documents"), 8, by_text=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
