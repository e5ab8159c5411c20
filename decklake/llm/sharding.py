"""Sharding by fixed virtual slots.

Records are hashed into N_SLOTS virtual slots, a number that never changes. Bytes and rows are summed per slot, and
a versioned map of slots to shards, kept as a table of all versions, says where a slot lives. The first version deals the
slots in turn, before any record is known; rebalancing to the bytes that are there edits the map only, in a new
version that moves few slots. A record's place in its shard is its slot's offset there plus its rank in the
slot, so no task ever holds a whole shard.

Bounds: the slot statistics and the map have N_SLOTS rows whatever the input is; only they reach the driver or are
broadcast. The hash takes id and text, so rows that share an id or a text still spread.

Edge cases: null ids and texts hash like any value; repeated rows get places of their own; an empty table gives an
empty result; extra columns, whatever their names, are not read. Texts of any length are measured in their row; a text larger than a shard's
share makes its shard as much too large. Rows of one id and text share a virtual slot: bytes are near equal where such rows are few.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, shared_dir, stored, text_of

N_SLOTS = 8192
#: Fixed value: bytes that a record needs besides its text.
OVERHEAD = 16


def slot_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(N_SLOTS)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """shards[slot] is the shard of a slot; a map is never changed, only followed by its next version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def dealt(n_shards: int) -> SlotMap:
        """The first version: slots in turn."""
        return SlotMap(1, n_shards, tuple(slot % n_shards for slot in range(N_SLOTS)))

    def rebalanced(self, sizes: list[int], n_shards: int | None = None, slack: float = 0.001) -> SlotMap:
        """The next version: slots leave shards that are above the mean by more than slack (or are gone), for the emptiest ones."""
        n_shards, shards = n_shards or self.n_shards, list(self.shards)
        load, held = [0] * max(n_shards, self.n_shards), {}
        for slot, shard in enumerate(shards):
            load[shard] += sizes[slot]
            held.setdefault(shard, []).append(slot)
        most, loose = sum(sizes) / n_shards * (1 + slack), []
        for shard, slots in held.items():
            for slot in sorted(slots, key=lambda i: (-sizes[i], i)):
                if shard >= n_shards or load[shard] - sizes[slot] >= sum(sizes) / n_shards and load[shard] > most:
                    load[shard] -= sizes[slot]
                    loose.append(slot)
        heap = [(load[s], s) for s in range(n_shards)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda i: (-sizes[i], i)):
            size, shard = heapq.heappop(heap)
            shards[slot] = shard
            heapq.heappush(heap, (size + sizes[slot], shard))
        return SlotMap(self.version + 1, n_shards, tuple(shards))

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the table of all versions."""
        rows = [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, n_shards int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, else the latest. N_SLOTS rows reach the driver."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("slot").collect()
        return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def slot_sizes(slotted: DataFrame) -> list[tuple[int, int]]:
    """(bytes, rows) of each of the N_SLOTS slots."""
    out = [(0, 0)] * N_SLOTS
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        out[r.virtual_slot] = (r.bytes, r.rows)
    return out


def place(docs: DataFrame, n_shards: int, id: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, shard, slot, map_version) of each row; slot is the place in the shard.

    maps: folder of the versioned maps (a fresh one if none is given). Its latest version is edited to these sizes, and the edited one
    is saved, read back and followed."""
    spark, whole = docs.sparkSession, text_of(text)
    slotted = stored(
        docs.select(
            F.col(id).alias("id"),
            (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            slot_of(F.col(id), F.col(text)).alias("virtual_slot"),
        )
    )
    sizes = slot_sizes(slotted)
    maps = maps or shared_dir(spark)
    if not exists(spark, maps):
        SlotMap.dealt(n_shards).save(spark, maps)
    current = SlotMap.load(spark, maps)
    edited = current.rebalanced([b for b, _ in sizes], n_shards)
    if (edited.n_shards, edited.shards) != (current.n_shards, current.shards):
        edited.save(spark, maps)
    plan = SlotMap.load(spark, maps)
    used, rows = [0] * n_shards, []
    for slot, shard in enumerate(plan.shards):
        rows.append((slot, shard, used[shard]))
        used[shard] += sizes[slot][1]
    where = spark.createDataFrame(rows, "virtual_slot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    ranked = slotted.withColumn("rank", rank).join(F.broadcast(where), "virtual_slot")
    return ranked.select(
        F.col("id").alias(id), "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(plan.version).alias("map_version")
    )
