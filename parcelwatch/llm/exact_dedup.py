"""Exact duplicates by composable polynomial fingerprints, confirmed by comparison.

A text's bytes are the coefficients of a polynomial, taken at a fixed point modulo two primes.  A text longer
than a chunk is cut into chunks that are dealt over the cluster and hashed as rows of their own; the
fingerprint of the whole follows from those of its chunks in order, each shifted by the length of what comes
after (``combine``).  Texts with equal fingerprints and lengths are then compared, chunk by chunk, with one
representative of their group.  Groups that hold different texts after all are told apart by a
cryptographic digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns, written

PRIMES = (2147483647, 2147483629)
POINTS = (1_103_515_245, 1_664_525_061)
CHUNK = 8192
CHUNK_BYTES = 1 << 20
_PART_BYTES = 1 << 18
_KEY = ["n_bytes", "hash_a", "hash_b"]


def _powers(point: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, np.uint64)
    for i in range(CHUNK - 2, -1, -1):
        out[i] = int(out[i + 1]) * point % prime
    return out


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """Fingerprint of two texts one after the other, from theirs and the length of the second."""
    return tuple(
        (a * pow(point, right_bytes, prime) + b) % prime
        for a, b, point, prime in zip(left, right, POINTS, PRIMES)
    )


class Fingerprinter:
    def __init__(self) -> None:
        self.powers = np.stack([_powers(x, p) for x, p in zip(POINTS, PRIMES)], 1)
        self.shift = [pow(x, CHUNK, p) for x, p in zip(POINTS, PRIMES)]

    def __call__(self, raw: bytes) -> tuple[int, int]:
        data = np.frombuffer(raw, np.uint8)
        head = len(data) % CHUNK
        # Products stay below 2**39 and sums of a chunk below 2**52.
        a, b = (data[:head].astype(np.uint64) @ self.powers[CHUNK - head :]).tolist()
        a, b = a % PRIMES[0], b % PRIMES[1]
        for start in range(head, len(data), 64 * CHUNK):
            block = data[start : start + 64 * CHUNK].reshape(-1, CHUNK).astype(np.uint64)
            for x, y in (block @ self.powers).tolist():
                a, b = (a * self.shift[0] + x) % PRIMES[0], (b * self.shift[1] + y) % PRIMES[1]
        return a, b


def _hashed(rows: DataFrame) -> DataFrame:
    """``n_bytes, hash_a, hash_b`` of the last column's bytes beside the other columns."""
    others, last = rows.columns[:-1], len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Fingerprinter()
        for batch in batches:
            numbers = []
            for cell in batch.column(last):
                raw = cell.as_buffer().to_pybytes()
                numbers.append((len(raw), *hashed(raw)))
            columns = [pa.array([n[i] for n in numbers], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], [*others, *_KEY])

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others]
    return rows.mapInArrow(run, ", ".join([*schema, *(f"{k} bigint" for k in _KEY)]))


def _chunks(n_bytes: Column, chunk_bytes: int) -> Column:
    """Numbers of a text's chunks, from 0; an empty text has one."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n_bytes / chunk_bytes) - 1, F.lit(0)).cast("int"))


def _chunk(raw: Column, number: Column, chunk_bytes: int) -> Column:
    return F.substring(raw, number * chunk_bytes + 1, F.lit(chunk_bytes))


def fingerprints(texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, text_sha256, n_bytes, hash_a, hash_b`` of every row of ``texts(doc_id, text)``."""
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    stamped = texts.withColumn("text_sha256", F.sha2(raw, 256))
    whole = _hashed(stamped.where(size <= chunk_bytes).select("doc_id", "text_sha256", "text"))
    # Rows of one table that are cut here are told apart by a number given where they are read.
    cut = stamped.where(size > chunk_bytes).withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", "text_sha256", raw.alias("raw"), F.explode(_chunks(size, chunk_bytes)).alias("number")
    )
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.select("row", "doc_id", "text_sha256", "number", _chunk(F.col("raw"), F.col("number"), chunk_bytes).alias("raw"))
    parts = _hashed(dealt.repartition(n, "row", "number"))
    lists = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
        F.array_sort(F.collect_list(F.struct("number", *_KEY))).alias("parts"),
    )
    kind = texts.schema["doc_id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                total, n_bytes = (0, 0), 0
                for part in parts:
                    total = combine(total, (part["hash_a"], part["hash_b"]), part["n_bytes"])
                    n_bytes += part["n_bytes"]
                out.append((n_bytes, *total))
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_sha256", *_KEY])

    schema = f"doc_id {kind}, text_sha256 string, n_bytes bigint, hash_a bigint, hash_b bigint"
    return whole.unionByName(lists.select("doc_id", "text_sha256", "parts").mapInArrow(joined, schema))


def _differing(rows: DataFrame) -> DataFrame:
    """Keys of sorted groups in which a chunk differs from the representative's, which comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, b""
        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for here, cell in zip(keys, batch.column(5)):
                raw = cell.as_buffer().to_pybytes()
                if here != key:
                    key, first = here, raw
                elif raw != first:
                    out.append(here[:3])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in out], pa.int64()) for i in range(3)], _KEY
            )

    return rows.mapInArrow(run, "n_bytes bigint, hash_a bigint, hash_b bigint").distinct()


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = _PART_BYTES,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Of rows with equal texts, the one with the largest ``doc_id`` stays (nulls come last; of
    repeated rows, one stays).  A null text counts as empty, and empty texts are equal to each other.  An
    empty table gives no rows.  Texts above ``chunk_bytes`` are hashed and compared in chunks of that size, in
    different tasks.

    The chunks of a group are compared in parts of about ``part_bytes``, or sixteen members if these have more;
    each part also gets the representative's chunk.  A group with a third of all rows is spread over many
    tasks.  Texts are shuffled once to be brought to their groups, and those of two or more once more.
    """
    texts = own_columns(docs, id_col, text_col)
    base = written(fingerprints(texts, chunk_bytes).withColumn("row", F.monotonically_increasing_id()))
    # Groups are written before rows are joined to them: a join that shares its shuffle with the
    # count of a group could not be split where one group has very many rows.
    kinds = base.groupBy(*_KEY, F.col("text_sha256").alias("sha")).agg(F.count("*").alias("n"))
    groups = kinds.groupBy(*_KEY).agg(F.sum("n").alias("size"), F.collect_list("sha").alias("shas"))
    # A digest brings a text that is read again to its group, by the same join at every size.
    shas = written(groups.where("size > 1").select(*_KEY, "size", F.explode("shas").alias("sha")))
    raw = F.col("text").cast("binary")
    held = written(
        texts.select(raw.alias("raw"), F.sha2(raw, 256).alias("sha")).join(shas.hint("merge"), "sha")
        .select(*_KEY, "size", "raw", F.monotonically_increasing_id().alias("held_row"))
    )
    first = written(held.groupBy(_KEY).agg(F.min("held_row").alias("first_row")))
    least = F.greatest(F.least(F.col("n_bytes"), F.lit(chunk_bytes)), F.lit(1))
    parts = F.ceil(F.col("size") / F.greatest(F.lit(part_bytes) / least, F.lit(16))).cast("int")
    lead = F.col("held_row") == F.col("first_row")
    part = F.when(lead, F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("held_row"), parts).cast("int"))
    )
    cut = held.join(first, _KEY).select(
        *_KEY, part.alias("parts"), lead.alias("lead"), "raw", F.explode(_chunks(F.col("n_bytes"), chunk_bytes)).alias("number")
    ).select(
        *_KEY, "number", F.explode("parts").alias("part"), "lead", _chunk(F.col("raw"), F.col("number"), chunk_bytes).alias("raw")
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_KEY, "number", "part"]
    dealt = cut.repartition(n, *order).sortWithinPartitions(*order, F.desc("lead"))
    differing = written(_differing(dealt.select(*order, "raw"))).withColumn("differ", F.lit(True))
    split = F.when(F.col("differ"), F.col("text_sha256")).otherwise("")
    told = base.join(differing, _KEY, "left").withColumn("digest", split).drop("differ")
    groups = written(
        told.groupBy(*_KEY, "digest").agg(
            F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")
        )
    )
    return told.join(groups, [*_KEY, "digest"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256",
    )
