"""Repeated passages by two-stage suffix sorting, spread over the cluster.

Stage one sorts only some suffixes directly: those that are smaller than their successors.  Suffixes
are compared by a hash of their first ``GRAM`` bytes, and one is sorted if it is the smallest of all
that start in some stretch of ``length - GRAM + 1`` bytes (an anchor).  Any string of ``length`` bytes
holds the same anchor at the same place wherever it occurs, so equal strings meet in the bucket of
their anchor, and every other suffix lies a known distance before one.

Stage two induces the rest: scanning a bucket for each distance ``d`` puts the suffixes that start
``d`` bytes before their anchors in order, stably by the bytes before the anchor, and by the order of
the anchors within those.  Adjacent suffixes of that order with a common prefix of ``length`` bytes
are repeats.

Surroundings of an anchor that are equal as a whole are counted once, by digest, before anything is
sorted: thousands of copies are one entry, and repeat themselves by their number.  Buckets with very
many different surroundings are solved by digests of their strings instead, which spread evenly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import written

GRAM = 32
_SEGMENT = 1 << 21
_MEMBERS = 1 << 15
_POINT = np.uint64((1 << 24) - 1)
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_VARIANT = ["gram", "around", "left", "right"]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on; ``data`` has ``GRAM`` spare bytes."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    n = len(data) - GRAM
    out = eight[:n] * _MIX[0]
    for i in range(1, GRAM // 8):
        out ^= out >> np.uint64(31)
        out += eight[8 * i : 8 * i + n]
        out *= _MIX[i]
    out ^= out >> np.uint64(29)
    return out


def anchors(data: bytes, begin: np.ndarray, size: np.ndarray, length: int) -> tuple:
    """Place of each anchor and of the first and last string of ``length`` bytes it stands for.

    ``begin`` and ``size`` are the texts in ``data``; strings never leave their text.
    """
    none = np.zeros(0, np.int64)
    whole = np.maximum(size - length + 1, 0)
    if not whole.any():
        return none, none, none, np.zeros(0, np.uint64)
    hashes = _gram_hashes(np.frombuffer(data + bytes(GRAM), np.uint8))
    least = (hashes & ~_POINT) | np.arange(len(hashes), dtype=np.uint64)
    width, stretch = 1, length - GRAM + 1
    while 2 * width <= stretch:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < stretch:
        least = np.minimum(least[: width - stretch], least[stretch - width :])
    string = _ranges(begin, whole)
    anchor = (least[string] & _POINT).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return anchor[first], string[first], string[last], hashes[anchor[first]]


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Text number, place and bytes, in runs of bounded size; long texts overlap by a string."""
    run, held = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), _SEGMENT):
            part = raw[at : at + _SEGMENT + length - 1]
            run.append((i, at, part))
            held += len(part)
            if held >= _SEGMENT:
                yield run
                run, held = [], 0
    if run:
        yield run


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """``gram, around, left, right, doc_id, text_hash, at`` for every anchor.

    ``around`` digests the bytes from ``left`` before the anchor to ``right`` behind its start: all
    strings that this anchor stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            for some in _segments(texts, length):
                data = b"".join(part for _, _, part in some)
                size = np.array([len(part) for _, _, part in some], np.int64)
                begin = np.cumsum(size) - size
                place, first, last, gram = anchors(data, begin, size, length)
                if not len(place):
                    continue
                owner = np.searchsorted(begin, place, side="right") - 1
                # Empty texts begin where the next one does.
                view = memoryview(data)
                around = np.array(
                    [digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64
                )
                text = np.array([i for i, _, _ in some])[owner]
                at = place - begin[owner] + np.array([a for _, a, _ in some])[owner]
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)),
                        pa.array((place - first).astype(np.int16)),
                        pa.array((last + length - place).astype(np.int16)),
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at),
                    ],
                    [*_VARIANT, "doc_id", "text_hash", "at"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = "gram bigint, around bigint, left smallint, right smallint"
    return texts.select("doc_id", "text_hash", "text").mapInArrow(
        run, f"{schema}, doc_id {kind}, text_hash bigint, at bigint"
    )


def _sorted(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows within their groups, and the prefix each shares with the one before it."""
    words = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    rows, group = rows[order], group[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared[group[1:] != group[:-1]] = -1
    return order, np.append(-1, shared)


def repeated_strings(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member, first and last distance of runs of strings that occur in two members of a group.

    ``data`` has the surroundings of all members one after the other.
    """
    n = len(group)
    reach = length - GRAM
    anchor = np.cumsum(left + right) - right
    padded = np.concatenate((np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)))
    column = np.arange(length)
    after = padded[(anchor + reach)[:, None] + column]
    after[column >= right[:, None]] = 0
    column = np.arange(-(-reach // 8) * 8)
    before = padded[np.maximum((anchor + reach - 1)[:, None] - column, 0)]
    before[column >= left[:, None]] = 0
    # Stage one: the anchors' own suffixes.
    order, shared = _sorted(after[:, : -(-length // 8) * 8], group)
    by_left, shared_left = _sorted(before, group)
    left, right = left[order], right[order]
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    place = place[order]
    hit = np.zeros((n, reach + 2), bool)
    # Stage two: suffixes d bytes ahead, induced from the anchors' order.
    for d in range(reach + 1):
        valid = np.flatnonzero((left >= d) & (right >= length - d))
        if len(valid) < 2:
            continue
        bucket = np.cumsum(shared_left < d).astype(np.uint16)[place[valid]]
        tail = np.cumsum(shared < length - d)[valid]
        induced = np.argsort(bucket, kind="stable")
        bucket, tail = bucket[induced], tail[induced]
        equal = np.flatnonzero((bucket[1:] == bucket[:-1]) & (tail[1:] == tail[:-1]))
        found = valid[induced]
        hit[found[equal], d] = hit[found[equal + 1], d] = True
    step = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    member, first = np.nonzero(step == 1)
    _, behind = np.nonzero(step == -1)
    return order[member], first, behind - 1


def _solve(rows: DataFrame, length: int) -> DataFrame:
    """``gram, around, left, right, low, high`` of repeats, from surroundings sorted by anchor.

    ``low`` and ``high`` are relative to the anchor.
    """

    def solve(columns: list) -> pa.RecordBatch:
        gram, around, left, right, data = columns
        group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
        member, first, last = repeated_strings(
            group, left.astype(np.int64), right.astype(np.int64), np.frombuffer(b"".join(data), np.uint8), length
        )
        out = [c[member] for c in (gram, around, left, right)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, out), pa.array(-last), pa.array(length - first)], [*_VARIANT, "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, _MEMBERS // 4):
                part = batch.slice(at, _MEMBERS // 4)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                columns.append(part.column(4).to_pylist())
                if held is None:
                    held = columns
                else:
                    held = [*(np.concatenate(p) for p in zip(held[:4], columns[:4])), held[4] + columns[4]]
                if len(held[0]) > _MEMBERS // 2:
                    whole = np.flatnonzero(held[0] != held[0][-1])
                    if len(whole):
                        cut = int(whole[-1]) + 1
                        yield solve([c[:cut] for c in held])
                        held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return rows.mapInArrow(
        run, "gram bigint, around bigint, left smallint, right smallint, low bigint, high bigint"
    )


def _strings(rows: DataFrame, length: int) -> DataFrame:
    """One digest for each string of each surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                member, ahead, digests = [], [], []
                for i, (left, right, data) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))):
                    for d in range(max(0, length - right), left + 1):
                        member.append(i)
                        ahead.append(d)
                        digests.append(xxhash.xxh3_128_digest(data[left - d : left - d + length]))
                two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [part.column(i).take(pa.array(member, pa.int64())) for i in range(4)]
                columns += [pa.array(ahead, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, [*_VARIANT, "ahead", "one", "two"])

    schema = "gram bigint, around bigint, left smallint, right smallint, ahead bigint, one bigint, two bigint"
    return rows.mapInArrow(run, schema)


def repeated_spans(texts: DataFrame, length: int = 200, most_variants: int = 12_000) -> DataFrame:
    """``doc_id, text_hash, spans``: byte ranges covered by repeats, for texts that have any.

    ``texts`` has ``doc_id, text_hash, text``.  Ranges may overlap; they are distinct.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = written(anchor_table(texts, length))
    # Written first: a join of two plain tables can split a frequent anchor over many tasks.
    several = written(every.groupBy("gram").agg(F.count("*").alias("uses")).where("uses > 1").select("gram"))
    repeated = written(every.join(several, "gram", "left_semi"))
    variants = written(
        repeated.groupBy(_VARIANT).agg(
            F.count("*").alias("uses"), F.first("doc_id").alias("doc_id"),
            F.first("text_hash").alias("text_hash"), F.first("at").alias("at"),
        )
    )
    whole = variants.where("uses > 1").select(
        *_VARIANT, (-F.col("left")).cast("bigint").alias("low"), F.col("right").cast("bigint").alias("high")
    )
    mixed = written(variants.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    wanted = variants.join(mixed, "gram").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct(*_VARIANT, "kinds", "at")).alias("wanted")
    )
    # Digests equal but for the text's number: a text and its hash tell which row is meant.
    owner = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "wanted")
    match = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
    raw = F.col("text").cast("binary")
    cut = F.transform(
        "wanted",
        lambda w: F.struct(
            *(w[c].alias(c) for c in (*_VARIANT, "kinds")),
            F.substring(
                raw, (w["at"] - w["left"] + 1).cast("int"), (w["left"] + w["right"]).cast("int")
            ).alias("data"),
        ),
    )
    cuts = texts.join(owner, match).select(F.explode(cut).alias("c")).select("c.*")
    cuts = written(cuts)
    few = cuts.where(F.col("kinds") <= most_variants).select(*_VARIANT, "data")
    solved = _solve(few.repartition(n, "gram").sortWithinPartitions("gram"), length)
    strings = written(_strings(cuts.where(F.col("kinds") > most_variants).select(*_VARIANT, "data"), length))
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ahead = F.col("ahead")
    dealt = strings.join(twice, ["one", "two"]).select(
        *_VARIANT, (-ahead).alias("low"), (F.lit(length) - ahead).alias("high")
    )
    found = whole.union(solved).union(dealt)
    return (
        repeated.join(found, _VARIANT)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))).alias("spans"))
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(s) for s in out]


def remove_repeats(
    docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
    keep_text: bool = True, most_variants: int = 12_000, carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, removed][, carried]`` of every row.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in this text or
    another, is removed; all places count, so none of the copies stays.  ``kept`` is the text that is
    left (characters cut in half are dropped), ``removed`` the byte ranges that went.  A null text
    counts as empty; texts below ``length`` bytes have no strings.  Repeated rows are copies of each
    other.  A null ``doc_id`` is an id like any other.  ``carried`` is a struct of the columns that
    ``carry`` names.  Long texts are read in segments; an empty table gives no rows.
    """
    texts = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.struct(*(docs[c] for c in carry)).alias("carried"),
    ).withColumn("text_hash", F.xxhash64("text"))
    carried = ["carried"] * bool(carry)
    spans = repeated_spans(texts.select("doc_id", "text", "text_hash"), length, most_variants)
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    match = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash"))
    rows = texts.join(spans, match, "left").select("doc_id", "text", "spans.low", "spans.high", *carried)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "removed"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span]
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, low, high in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = text.as_buffer().to_pybytes()
                cut = merged(list(zip(low.as_py(), high.as_py()))) if low.is_valid else []
                ends = [0, *(b for _, b in cut)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(raw)])) if cut else raw
                row = [len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    row += [kept.decode("utf-8", "ignore"), [{"low": a, "high": b} for a, b in cut]]
                for values, value in zip(out, row):
                    values.append(value)
            columns = [pa.array(values, type_) for values, type_ in zip(out, types)]
            columns += [batch.column(4)] if carried else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names + carried)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept string, removed array<struct<low: bigint, high: bigint>>" * keep_text
    if carried:
        schema += f", carried {texts.schema['carried'].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)
