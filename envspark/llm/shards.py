"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; bytes are summed per slot; a small,
versioned table maps slots to shards.  Placement is a lookup in that table, and rebalancing edits
the table (a new version) instead of rehashing records.

Cases: a null text has no bytes (size ``overhead``); null ids share the slot of the null hash;
repeated rows are separate records of one slot; an empty table gives a map whose slots are dealt
out evenly and no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

SLOTS = 8192
#: Records of one slot are numbered in groups of about this size, however large the slot is.
GROUP_ROWS = 50_000

MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def records(docs: DataFrame, slots: int = SLOTS, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): all that placement needs to know of a record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot; ``slots`` numbers whatever the size of the table."""
    out = [0] * slots
    for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        out[r[0]] = int(r[1])
    return out


def first_map(load: list[int], shards: int) -> list[int]:
    """Shard of each slot: the heaviest slot goes to the lightest shard, again and again."""
    heap = [(0, 0, s) for s in range(shards)]
    owner = [0] * len(load)
    for slot in sorted(range(len(load)), key=lambda i: (-load[i], i)):
        held, n, s = heapq.heappop(heap)
        owner[slot] = s
        heapq.heappush(heap, (held + load[slot], n + 1, s))
    return owner


def edited_map(load: list[int], owner: list[int], shards: int) -> list[int]:
    """``owner`` edited for ``shards`` shards (as many as before, or more): slots leave only shards
    above their share, and go only to shards below it; all others stay where they are."""
    owner = list(owner)
    held = [0] * shards
    for slot, s in enumerate(owner):
        held[s] += load[slot]
    share = sum(held) / shards
    moving = []
    for slot in sorted(range(len(load)), key=lambda i: (load[i], i)):
        if load[slot] and held[owner[slot]] - load[slot] >= share:
            held[owner[slot]] -= load[slot]
            moving.append(slot)
    heap = [(h, s) for s, h in enumerate(held) if h < share]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda i: (-load[i], i)):
        h, s = heapq.heappop(heap)
        owner[slot] = s
        heapq.heappush(heap, (h + load[slot], s))
    return owner


def save_map(spark: SparkSession, path: str, version: int, load: list[int], owner: list[int]) -> None:
    """Add a version to the stored map (a table of ``slots`` rows for each version)."""
    rows = [(version, slot, owner[slot], load[slot]) for slot in range(len(owner))]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == version)


def place(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their ``shard``.  The map is broadcast: it has a fixed number of rows."""
    return recs.join(F.broadcast(slot_map.select("virtual_slot", "shard", "version")), "virtual_slot")


def numbered(placed: DataFrame) -> DataFrame:
    """Adds ``slot``: the record's place in its shard, without gaps from 0.

    Records are counted per (virtual slot, group), groups being hash parts of about GROUP_ROWS;
    offsets are running sums over that small table, and only groups are sorted."""
    rows = placed.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-rows // GROUP_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(parts)))
    group = ["shard", "virtual_slot", "part"]
    counts = placed.groupBy(*group).count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("count")
    offsets = counts.select(*group, before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.withColumn("rank", rank).join(offsets, group).withColumn("slot", F.col("before") + F.col("rank"))


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Every record with its virtual slot, shard and place in the shard; version 1 of the map,
    balanced by the bytes of the slots, is stored under ``map_path``."""
    spark = docs.sparkSession
    recs = store(records(docs, slots), "records")
    load = slot_bytes(recs, slots)
    save_map(spark, map_path, 1, load, first_map(load, shards))
    return numbered(place(recs, load_map(spark, map_path, 1)))
