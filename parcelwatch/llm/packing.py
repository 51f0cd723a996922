"""Packing documents into training sequences by their length histogram.

Token streams are cut into pieces of at most one sequence.  The histogram of piece lengths, at most
``capacity`` numbers, is packed on the driver: lengths are placed longest first, always into the
shortest open pack, and whole counts move at once, so the work depends on the capacity and not on
the corpus.  The outcome is a list of patterns with counts.  Pieces are ranked within their length
(a prefix sum over small buckets, so a length that a third of all pieces share is still spread),
and rank intervals of the patterns tell each piece its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwatch.llm.bpe import batched, loaded
from parcelwatch.llm.common import own_columns, written

_PER_BUCKET = 200_000


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens[, ids]``: every document's ids, then
    ``end_id``, cut every ``capacity`` ids.

    A null text counts as empty and gives one piece that is just ``end_id``; a null ``doc_id`` and
    repeated rows are kept.
    """
    bpe = loaded(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        for batch in batches:
            owner, rows, kept, at = [], [], [], 0
            for texts in batched(batch.column(1).to_pylist()):
                for ids in bpe.encode(texts):
                    ids = np.concatenate((ids, end))
                    raw, n = ids.tobytes(), len(ids)
                    for start in range(0, n, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        owner.append(at)
                        rows.append((start, len(part) // 4, zlib.crc32(part), n))
                        if keep_ids:
                            kept.append(ids[start : start + capacity].astype(np.int32))
                    at += 1
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns += [pa.array(numbers[:, i]) for i in range(4)]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids array<int>" * keep_ids
    return own_columns(docs, id_col, text_col).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences each has.

    Longest length first; a length goes to the open packs with the most room left (the shortest
    ones).  Packs that get it become a new pattern; those left over keep theirs.  With no open
    pack, a new one takes as many of the length as it holds.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    full: list[tuple[list[int], int]] = []

    def put(pattern: list[int], number: int, room: int) -> None:
        if number and room:
            open_packs[room].append((number, pattern))
        elif number:
            full.append((pattern, number))

    for length in sorted(counts, reverse=True):
        left, room = counts[length], capacity
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                each = capacity // length
                put([length] * each, left // each, capacity - each * length)
                rest = left % each
                put([length] * rest, int(rest > 0), capacity - rest * length)
                break
            number, pattern = open_packs[room].pop()
            used = min(number, left)
            put(pattern, number - used, room)
            each = min(room // length, max(1, left // used))
            put(pattern + [length] * each, used, room - each * length)
            left -= used * each
    return full + [(p, n) for packs in open_packs.values() for n, p in packs]


def pattern_slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, rank behind the last, first sequence, offset`` of each pattern's places."""
    slots, rank, sequence = [], defaultdict(int), 0
    for lengths, number in patterns:
        offset = 0
        for length in lengths:
            slots.append((length, rank[length], rank[length] + number, sequence, offset))
            rank[length] += number
            offset += length
        sequence += number
    return slots


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; only ``length`` is looked at.

    Every piece is in exactly one sequence; offsets have no gaps.  ``pieces`` is read several times:
    give a written table.  Only the histogram reaches the driver and only the patterns' places are
    broadcast; both are bounded by the capacity.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        pattern_slots(pack_histogram(counts, capacity)) or [(0, 0, 0, 0, 0)],
        "slot_length bigint, slot_from bigint, slot_to bigint, slot_sequence bigint, slot_offset bigint",
    )
    buckets = max(8, -(-sum(counts.values()) // _PER_BUCKET))
    bucket = F.pmod(F.xxhash64("piece_row"), F.lit(buckets)).cast("int")
    rows = pieces.withColumn("piece_bucket", bucket)
    order = Window.partitionBy("length").orderBy("piece_bucket")
    before = (
        rows.groupBy("length", "piece_bucket").count()
        .withColumn("piece_base", F.sum("count").over(order) - F.col("count"))
        .select("length", "piece_bucket", "piece_base")
    )
    local = F.row_number().over(Window.partitionBy("length", "piece_bucket").orderBy("piece_row"))
    ranked = rows.withColumn("piece_rank", local - 1).join(before, ["length", "piece_bucket"])
    rank = F.col("piece_base") + F.col("piece_rank")
    place = (
        (F.col("length") == F.col("slot_length"))
        & (rank >= F.col("slot_from")) & (rank < F.col("slot_to"))
    )
    return ranked.join(F.broadcast(slots), place).select(
        *[c for c in pieces.columns if c != "piece_row"],
        (F.col("slot_sequence") + rank - F.col("slot_from")).alias("sequence_id"),
        F.col("slot_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, **kw) -> DataFrame:
    """Pieces of all documents with their sequences; an empty table gives an empty result."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id, **kw)
    # The row number is written with the piece, so that ranks are the same in every later read.
    return pack(written(pieces.withColumn("piece_row", F.monotonically_increasing_id())), capacity)
