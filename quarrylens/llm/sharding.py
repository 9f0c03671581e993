"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots, for ever. A small map says
which shard owns each slot. Bytes are summed per slot, slots are dealt to shards so that
their bytes come out near equal, and growing or mending the cluster edits the map only: it
moves whole slots, never single records. Each edit is a new version; old versions stay
readable.

The map has one row per slot, so what reaches the driver is bounded by the number of slots
whatever the size of the table. Texts are never shuffled.

Defined cases: a null text has no bytes (its size is 1) and checksum 0; a null id hashes by
its text; repeated rows are separate records; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import saved

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``owner[slot]`` is the shard of a slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def shard_of(self, slot: Column) -> Column:
        return F.element_at(F.lit(list(self.owner)), slot + F.lit(1))


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.coalesce(F.xxhash64(F.lit("id"), doc_id.cast("string")), F.lit(0))
    key = F.when(doc_id.isNull(), F.xxhash64(F.lit("text"), text)).otherwise(key)
    return F.pmod(key, F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def slot_loads(records: DataFrame) -> list[dict]:
    """Rows and bytes of each slot: at most one row per slot reaches the driver."""
    found = records.groupBy("slot").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )
    return [r.asDict() for r in found.collect()]


def deal(loads: list[dict], shards: int, slots: int = SLOTS) -> SlotMap:
    """First version: the heaviest slot left goes to the lightest shard."""
    weight = {r["slot"]: r["bytes"] for r in loads}
    owner = [0] * slots
    heap = [(0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-weight.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + weight.get(slot, 0), shard))
    return SlotMap(1, shards, tuple(owner))


def rebalance(old: SlotMap, loads: list[dict], shards: int) -> SlotMap:
    """Next version for ``shards`` shards: slots leave only shards that hold more than their
    share (or that go away), heaviest first, and land on the lightest shard."""
    weight = {r["slot"]: r["bytes"] for r in loads}
    fair = sum(weight.values()) / shards
    held: dict[int, list[int]] = {s: [] for s in range(max(shards, old.shards))}
    for slot, shard in enumerate(old.owner):
        held[shard].append(slot)
    load = {s: sum(weight.get(x, 0) for x in held[s]) for s in held}
    loose = [x for s in held if s >= shards for x in held[s]]
    for s in range(shards):
        for slot in sorted(held[s], key=lambda x: (-weight.get(x, 0), x)):
            w = weight.get(slot, 0)
            if w and load[s] - w >= fair:
                loose.append(slot)
                load[s] -= w
    owner = list(old.owner)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-weight.get(x, 0), x)):
        now, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (now + weight.get(slot, 0), shard))
    return SlotMap(old.version + 1, shards, tuple(owner))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add this version to the store at ``path``; a version is never overwritten."""
    rows = [(slot_map.shards, slot, shard) for slot, shard in enumerate(slot_map.owner)]
    frame = spark.createDataFrame(rows, "shards int, slot int, shard int")
    frame.coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``docs`` with a column ``shard`` (a clashing column of that name is replaced)."""
    slot = slot_of(F.col("doc_id"), F.col("text"), slots)
    records = docs.select(slot.alias("slot"), record_size(F.col("text")).alias("size"))
    slot_map = deal(slot_loads(records), shards, slots)
    return docs.withColumn("shard", slot_map.shard_of(slot))


def placements(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """One row per record: its size, checksum, virtual slot, shard and place in the shard.

    Places are counted inside each virtual slot and moved up by the rows of the slots before
    it in the same shard, so no task ever holds a shard.
    """
    doc_id, text = F.col("doc_id"), F.col("text")
    records = saved(
        docs.select(
            doc_id,
            record_size(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
            slot_of(doc_id, text, slots).alias("slot"),
        )
    )
    loads = slot_loads(records)
    slot_map = deal(loads, shards, slots)
    rows = {r["slot"]: r["rows"] for r in loads}
    before, filled = [0] * slots, [0] * shards
    for slot, shard in enumerate(slot_map.owner):
        before[slot] = filled[shard]
        filled[shard] += rows.get(slot, 0)
    order = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size")
    start = F.element_at(F.lit(before), F.col("slot") + F.lit(1)).cast("long")
    return records.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("slot").alias("virtual_slot"),
        slot_map.shard_of(F.col("slot")).cast("int").alias("shard"),
        (start + F.row_number().over(order) - F.lit(1)).cast("long").alias("place"),
        F.lit(slot_map.version).alias("map_version"),
    )


def op1_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylens.llm.common import table

    placed = placements(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
