"""Sharding through a fixed number of virtual slots.

A record's hash picks one of thousands of slots, for good.  A slot map, a small versioned table,
says which shard holds each slot.  It is made from the bytes per slot, heaviest slot first into the
lightest shard; later versions edit it: a new shard takes slots from the others and nothing else
moves.  Only the bytes per slot, one row for each, reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns, written

SLOTS = 8192
MAP_SCHEMA = "virtual_slot int, shard int, bytes bigint, version int"


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, record_row`` of every record.

    A record's size is its text's bytes plus 16; a null text has no bytes.  Repeated rows share a
    slot; a null ``doc_id`` is hashed like any other value.  Texts are only measured, never moved.
    """
    raw = F.col("text").cast("binary")
    measured = own_columns(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text") + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")
    return measured.select(
        "*", slot.alias("virtual_slot"), F.monotonically_increasing_id().alias("record_row")
    )


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Bytes of every slot, empty ones too: at most ``slots`` rows on the driver."""
    found = {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    return [(slot, found.get(slot, 0)) for slot in range(slots)]


def first_map(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Version 0 of a slot map: the heaviest slot left goes to the lightest shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = []
    for slot, size in sorted(sizes, key=lambda s: (-s[1], s[0])):
        load, shard = heapq.heappop(heap)
        out.append((slot, shard, size, 0))
        heapq.heappush(heap, (load + size, shard))
    return sorted(out)


def grown_map(current: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The next version, with one more shard: the heaviest shard gives, slot by slot, until the new
    one has its share.  Slots move only to the new shard."""
    shards = 1 + max(s for _, s, _, _ in current)
    version = 1 + max(v for _, _, _, v in current)
    held: dict[int, list[tuple[int, int]]] = {}
    for slot, shard, size, _ in current:
        held.setdefault(shard, []).append((size, slot))
    heap = [(-sum(s for s, _ in slots), shard) for shard, slots in held.items()]
    heapq.heapify(heap)
    for slots in held.values():
        slots.sort(reverse=True)
    goal, got, moved = sum(s for _, _, s, _ in current) / (shards + 1), 0, set()
    while heap:
        load, shard = heapq.heappop(heap)
        fits = next((i for i, (size, _) in enumerate(held[shard]) if size and got + size <= goal), None)
        if fits is None:
            continue
        size, slot = held[shard].pop(fits)
        moved.add(slot)
        got += size
        heapq.heappush(heap, (load + size, shard))
    return [(s, shards if s in moved else h, b, version) for s, h, b, _ in current]


def rebalanced_map(
    current: list[tuple[int, int, int, int]], sizes: list[tuple[int, int]], slack: float = 0.02
) -> list[tuple[int, int, int, int]]:
    """The next version after sizes changed: shards above the mean by more than ``slack`` hand
    slots to the lightest shard; all other slots stay where they are."""
    now, version = dict(sizes), 1 + max(v for _, _, _, v in current)
    place = {slot: shard for slot, shard, _, _ in current}
    load = dict.fromkeys(place.values(), 0)
    for slot, shard in place.items():
        load[shard] += now.get(slot, 0)
    limit = (1 + slack) * sum(load.values()) / len(load)
    for slot in sorted(place, key=lambda s: (now.get(s, 0), s)):
        size, shard = now.get(slot, 0), place[slot]
        low = min(load, key=lambda s: (load[s], s))
        if load[shard] > limit and size and load[low] + size <= limit:
            load[shard] -= size
            load[low] += size
            place[slot] = low
    return [(s, place[s], now.get(s, 0), version) for s, _, _, _ in current]


def store_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Write one version of a slot map below ``path``; versions stay side by side."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """A stored version, the latest by default."""
    table = spark.read.parquet(path).select("virtual_slot", "shard", "bytes", "version")
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return sorted(map(tuple, table.where(F.col("version") == version).collect()))


def assign(records: DataFrame, slot_map: list[tuple[int, int, int, int]]) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the record's place in its shard from 0 without gaps.

    A place is the number of records in the shard's earlier virtual slots plus the place among
    those of its own, so no shard is sorted as a whole.  The map has one row per slot: it is
    broadcast.
    """
    spark = records.sparkSession
    table = spark.createDataFrame(slot_map, MAP_SCHEMA).select("virtual_slot", "shard")
    counted = records.groupBy("virtual_slot").count().join(F.broadcast(table), "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot")
    base = counted.select(
        "virtual_slot", "shard", (F.sum("count").over(earlier) - F.col("count")).alias("slot_base")
    )
    own = Window.partitionBy("virtual_slot").orderBy("record_row")
    ranked = records.withColumn("slot_rank", F.row_number().over(own) - 1)
    return ranked.join(F.broadcast(base), "virtual_slot").withColumn(
        "slot", F.col("slot_base") + F.col("slot_rank")
    ).drop("slot_base", "slot_rank", "record_row")


def shard_documents(
    docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, **kw
) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """All records with their shards by bytes, and the slot map, which is stored at ``map_path``.

    Records of equal texts go by their own ids and may lie in different shards: a text with a third of
    all rows could not stay together in shards of near-equal bytes.  A long text is one record of its
    size; shards are no more equal than the largest slot allows.  An empty table gives no records and a
    map of empty slots.
    """
    records = written(slotted(docs, slots, **kw))
    slot_map = first_map(slot_bytes(records, slots), shards)
    if map_path:
        store_map(docs.sparkSession, slot_map, map_path)
    return assign(records, slot_map), slot_map
