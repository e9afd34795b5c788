"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map takes slots to shards.

The slots never change; only the map is edited. It is stored as rows (version, vslot, shard): a version holds the slots whose shard it
changes, and the shard of a slot at a version is that of its last edit up to there (``MapStore``). Two edits are made: ``grow`` hands
slots evenly from all shards to a new one, so a grown cluster moves rows only into its new shard, and the id and the number of shards
alone decide; ``rebalance`` moves slots from full to empty shards by the bytes that ``slot_bytes`` aggregates, and stores those bytes
with the version. The query follows the first law (``key``); for it bytes decide nothing but how finely a slot is cut into parts.
Everything over rows is DataFrame and SQL functions; the map is a few thousand numbers, made on the driver.

Places within a shard are gapless and need no sort of a whole shard: rows and bytes are aggregated per slot and part, the counts are
summed up along the shard, and rows are numbered within their part only. A slot has as many parts as its rows ask for, so that a part
holds about ``part_rows`` rows at any size of table, whatever its ids.

Defined results. A null id hashes like the empty text; null text has no bytes. Repeated rows go to one shard, each with a place of
its own. An id that a third of all rows share stays in one shard (the law says so), but its rows are spread over parts by their
place in the input, so that no task numbers them all. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import fresh_path, require, written

SLOTS = 8192


def slot_of(id_col: str, slots: int = SLOTS) -> Column:
    """The virtual slot of an id: the first 32 bits of the MD5 of the id as text, modulo the number of slots."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot, for ``shards`` shards: the result of growing from one shard up."""
    owner = [0] * slots
    for n in range(1, shards):
        owner = grown(owner, n)
    return owner


def grown(owner: list[int], shards: int) -> list[int]:
    """The map with one more shard: each old shard hands over its last slots until all hold the same, give or take one."""
    slots = len(owner)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, s in enumerate(owner):
        held[s].append(slot)
    out, wanted = owner[:], slots // (shards + 1)
    for _ in range(wanted):
        most = max(range(shards), key=lambda s: (len(held[s]), -s))
        out[held[most].pop()] = shards
    return out


def rebalanced(owner: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[int]:
    """Edits a map by measured bytes: slots go from the fullest to the emptiest shard while that narrows their gap."""
    out, load = owner[:], [0] * shards
    for slot, s in enumerate(owner):
        load[s] += slot_bytes.get(slot, 0)
    even = sum(load) / shards
    for _ in range(len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fitting = [(b, s) for s in range(len(out)) if out[s] == high and 0 < (b := slot_bytes.get(s, 0)) < gap]
        if gap <= tolerance * even or not fitting:
            break
        size, slot = min(fitting, key=lambda x: abs(gap / 2 - x[0]))
        out[slot] = low
        load[high], load[low] = load[high] - size, load[low] + size
    return out


class MapStore:
    """A slot map in a folder: versions 1, 2, ... as edits, each a table of its own that is never changed once written."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS) -> None:
        self.spark, self.path, self.slots, self.last = spark, path, slots, 0

    def _edit(self, before: list[int | None], after: list[int], load: DataFrame | None = None) -> int:
        """Writes the slots that change, with the rows and bytes (``load``) that the edit was made by."""
        moved = [(slot, s) for slot, s in enumerate(after) if before[slot] != s]
        numbers = F.expr("explode(split('" + ",".join(f"{slot}:{s}" for slot, s in moved) + "', ','))")
        rows = self.spark.range(1, numPartitions=1).select(numbers.alias("e")).filter("e <> ''")
        rows = rows.select(F.lit(self.last + 1).alias("version"), F.split("e", ":")[0].cast("long").alias("vslot"), F.split("e", ":")[1].cast("int").alias("shard"))
        none = self.spark.range(0).select(F.col("id").alias("vslot"), F.col("id").alias("rows"), F.col("id").alias("bytes"))
        rows.join(F.broadcast(load if load is not None else none), "vslot", "left").select("version", "vslot", "shard", "rows", "bytes").write.parquet(f"{self.path}/version={self.last + 1}")
        self.last += 1
        return self.last

    def edits(self, version: int | None = None) -> DataFrame:
        files = [f"{self.path}/version={v}" for v in range(1, (version or self.last) + 1)]
        return self.spark.read.schema("version int, vslot long, shard int, rows long, bytes long").parquet(*files)

    def at(self, version: int | None = None) -> DataFrame:
        """(vslot, shard) at a version (the last one): of each slot its last edit."""
        return self.edits(version).groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))

    def owners(self, version: int | None = None) -> list[int]:
        return [r.shard for r in self.at(version).orderBy("vslot").collect()]  # a number per slot

    def start(self, shards: int) -> int:
        return self._edit([None] * self.slots, first_map(shards, self.slots))

    def grow(self, shards: int) -> int:
        """One shard more than ``shards``: slots move to the new shard only."""
        now = self.owners()
        return self._edit(now, grown(now, shards))

    def rebalance(self, load: DataFrame, shards: int, tolerance: float = 0.02) -> int:
        """Moves slots by the bytes of ``slot_bytes``, and keeps these with the version."""
        now = self.owners()
        size = {r.vslot: r.bytes for r in load.select("vslot", "bytes").collect()}  # a row per slot
        return self._edit(now, rebalanced(now, size, shards, tolerance), load)


def slot_bytes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(vslot, rows, bytes): what each virtual slot holds; summed up before the shuffle, at most one row per slot and task."""
    return _loads(docs.select(slot_of(id_col, slots).alias("vslot"), size_of(text).alias("size")))


def _loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def assign(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS, part_rows: int = 200_000) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, and the bytes of its shard."""
    require(docs)
    spark = docs.sparkSession
    store = MapStore(spark, fresh_path(spark, "slot-map"), slots)
    now = store.start(shards)
    after = store.grow(shards)
    both = store.at(now).join(store.at(after).withColumnRenamed("shard", "grown_shard"), "vslot")
    rows = docs.select(F.col(id_col), slot_of(id_col, slots).alias("vslot"), size_of(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    # drawn before the table is written, hence the same for every later reader
    rows = written(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "slotted")
    # a slot's own count decides its parts, lest one id fill a part; slots and the map are a few thousand rows, so they may be broadcast
    load = written(_loads(rows), "slot-bytes")
    rows = rows.join(F.broadcast(load.select("vslot", F.ceil(F.col("rows") / part_rows).alias("parts"))), "vslot").withColumn("part", F.pmod("salt", "parts"))
    full = load.join(F.broadcast(both), "vslot").groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    counted = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(F.broadcast(both), "vslot")
    along = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("vslot", "part", "shard", "grown_shard", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("vslot", "part").orderBy(id_col, "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within)).join(offsets.join(F.broadcast(full), "shard"), ["vslot", "part"])
    return placed.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard", "shard_bytes")


def report(docs: DataFrame) -> DataFrame:
    return assign(docs.select("doc_id", "text"))
