"""Phrase collocations from count streams in prefix and suffix order.

Phrases are counted the external way: a task sorts the phrases of a run of words and sums equal ones, deals
the sorted run into buckets, and a bucket merges the runs of all tasks.  Every phrase is counted in one
bucket, so rare ones are dropped there, exactly.

What is left stands in two orders.  In prefix order a phrase follows its first part, in suffix order (by its
last words) it follows its rest: joining the sorted streams in lockstep delivers the left counts from the
one and the right counts from the other, and the counts of a phrase's extensions back to it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwatch.llm.common import written

# ASCII capitals become small letters, a tab a blank, and what parts pieces a byte that UTF-8 never has.
_BREAK = 0xFF
_FOLD = bytes(
    _BREAK if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_RUN_WORDS = 1 << 20
_MERGE = 1 << 21
_BUCKET_BYTES = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _order(columns: list[np.ndarray], limit: int) -> np.ndarray:
    """Order of rows of numbers below ``limit``."""
    bits = max(1, (limit - 1).bit_length())
    if bits * len(columns) < 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            key = (key << np.uint64(bits)) | column.astype(np.uint64)
        return np.argsort(key)
    return np.lexsort(columns[::-1])


def _summed(columns: list[np.ndarray], counts: np.ndarray, limit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = _order(columns, limit)
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts, first)


# --- runs -----------------------------------------------------------------------------------


def _words(raw: bytes) -> list[bytes]:
    """Words, with the break byte as a word between pieces."""
    return raw.translate(_FOLD).replace(b"\xff", b" \xff ").split()  # the only blank left is the space


def _chunks(raw: bytes, size: int, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in parts of about ``size`` bytes, and how many of them the part before had too."""
    at, tail = 0, []
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw):  # up to the end of a word
            gap = next((i for i in range(end, min(end + size, len(raw))) if _FOLD[raw[i]] in (32, _BREAK)), -1)
            end = gap if gap >= 0 else min(end + size, len(raw))
            if gap >= 0:
                break
        words = _words(raw[at:end])
        yield tail + words, len(tail)
        tail = (tail + words)[-(longest - 1) :] if longest > 1 else []
        at = end


def _blob(vocabulary: list[bytes], grams: list[tuple[list[np.ndarray], np.ndarray]]) -> bytes:
    """A sorted run of one bucket: its words, and for each length the word numbers and counts."""
    used = np.unique(np.concatenate([c for columns, _ in grams for c in columns]))
    words = b" ".join([vocabulary[i] for i in used.tolist()])
    kind = "<u2" if len(used) <= 1 << 16 else "<u4"
    parts = [struct.pack("<II", len(used), len(words)), words]
    for columns, counts in grams:
        parts.append(struct.pack("<I", len(counts)))
        parts += [np.searchsorted(used, c).astype(kind).tobytes() for c in columns]
        parts.append(counts.astype("<u4").tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unblob(blob: bytes, longest: int) -> tuple[list[bytes], list[tuple[list[np.ndarray], np.ndarray]]]:
    raw = zstandard.decompress(blob)
    n, size = struct.unpack_from("<II", raw)
    at = 8 + size
    words, kind = raw[8:at].split(b" "), np.dtype("<u2" if n <= 1 << 16 else "<u4")
    grams = []
    for order in range(1, longest + 1):
        (rows,) = struct.unpack_from("<I", raw, at)
        at += 4
        columns = []
        for _ in range(order):
            columns.append(np.frombuffer(raw, kind, rows, at).astype(np.int32))
            at += rows * kind.itemsize
        grams.append((columns, np.frombuffer(raw, "<u4", rows, at).astype(np.int64)))
        at += rows * 4
    return words, grams


class _Run:
    """Words of one language, waiting to be sorted."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.again: list[tuple[int, int]] = []  # places whose phrases were counted with the part before

    def add(self, words: list[bytes], seen: int) -> None:
        if seen:
            self.again.append((len(self.words), seen))
        self.words += words
        self.words.append(b"\xff")


def _counted(run: _Run, longest: int) -> tuple[list[bytes], list[tuple[list[np.ndarray], np.ndarray]]]:
    """The run's vocabulary in order, and its distinct phrases of each length with their counts."""
    vocabulary = sorted({*run.words, b"\xff"})  # the break comes last
    rank = dict(zip(vocabulary, range(len(vocabulary))))
    ids = np.fromiter(map(rank.__getitem__, run.words), np.int64, len(run.words))
    last = len(vocabulary) - 1
    grams, whole = [], np.ones(len(ids), bool)
    for order in range(1, longest + 1):
        n = max(0, len(ids) - order + 1)
        whole = whole[:n] & (ids[order - 1 :][:n] != last)
        fresh = whole.copy()
        for at, seen in run.again:
            # A phrase that ends among words seen before was counted there.
            fresh[at : max(at, at + seen - order + 1)] = False
        place = np.flatnonzero(fresh)
        columns = [ids[place + i] for i in range(order)]
        grams.append(_summed(columns, np.ones(len(place), np.int64), len(vocabulary)))
    return vocabulary, grams


def _dealt(run: _Run, longest: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The run's sorted counts by bucket; a phrase's bucket follows from its words alone."""
    vocabulary, grams = _counted(run, longest)
    own = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
    dealt = []
    for columns, counts in grams:
        mixed = np.zeros(len(counts), np.uint64)
        for column in columns:
            mixed = (mixed ^ own[column]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        dealt.append(([c[order] for c in columns], counts[order], cuts))
    for b in range(buckets):
        some = [([c[s[b] : s[b + 1]] for c in columns], n[s[b] : s[b + 1]]) for columns, n, s in dealt]
        if any(len(n) for _, n in some):
            yield b, _blob(vocabulary, some)


def _runs(texts: DataFrame, longest: int, buckets: int, run_words: int) -> DataFrame:
    """``bucket, lang, run`` for the words of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, _Run] = {}
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, some in waiting.items():
                rows = list(_dealt(some, longest, buckets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int64()), pa.array([lang] * len(rows), pa.string()),
                        pa.array([x for _, x in rows], pa.binary()),
                    ],
                    ["bucket", "lang", "run"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words, seen in _chunks(text.as_buffer().to_pybytes(), 8 * run_words, longest):
                    waiting.setdefault(lang, _Run()).add(words, seen)
                    held += len(words) + 1
                    if held >= run_words:
                        yield from emptied()
                        waiting, held = {}, 0
        yield from emptied()

    return texts.select("lang", "text").mapInArrow(run, "bucket bigint, lang string, run binary")


def _merged(runs: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, phrase, n_words, count`` of all phrases that occur ``least`` times, and of all words.

    A bucket's runs come in order of their language and are merged as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, held, waiting = None, {}, [], 0

        def compact() -> None:
            nonlocal waiting
            for i, parts in enumerate(held):
                if parts:
                    columns = [np.concatenate(c) for c in zip(*(c for c, _ in parts))]
                    held[i] = [_summed(columns, np.concatenate([n for _, n in parts]), len(rank))]
            waiting = -sum(len(n) for parts in held for _, n in parts)

        def finished() -> Iterator[pa.RecordBatch]:
            compact()
            words = list(rank)
            for i, parts in enumerate(held):
                for columns, counts in parts:
                    if i == 0:
                        yield rows([""], [0], [int(counts.sum())])
                    enough = np.flatnonzero(counts >= least)
                    chosen = [c[enough].tolist() for c in columns]
                    phrases = [b" ".join([words[w] for w in gram]).decode() for gram in zip(*chosen)]
                    yield rows(phrases, [i + 1] * len(phrases), counts[enough])

        def rows(phrases: list[str], sizes: list[int], counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[1]] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                    pa.array(sizes, pa.int32()), pa.array(counts, pa.int64()),
                ],
                ["lang", "phrase", "n_words", "count"],
            )

        for batch in batches:
            for bucket, lang, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (bucket, lang) != key:
                    if key is not None:
                        yield from finished()
                    key, rank, held, waiting = (bucket, lang), {}, [[] for _ in range(longest)], 0
                words, grams = _unblob(blob, longest)
                number = np.array([rank.setdefault(w, len(rank)) for w in words], np.int32)
                for i, (columns, counts) in enumerate(grams):
                    if len(counts):
                        held[i].append(([number[c] for c in columns], counts))
                        waiting += len(counts)
                if waiting > _MERGE:
                    compact()
        if key is not None:
            yield from finished()

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = runs.repartition(n, "bucket").sortWithinPartitions("bucket", "lang")
    return in_order.mapInArrow(run, "lang string, phrase string, n_words int, count bigint")


def phrase_counts(
    texts: DataFrame, longest: int = 3, least: int = 10, run_words: int = _RUN_WORDS, bucket_bytes: int = _BUCKET_BYTES
) -> DataFrame:
    """``lang, phrase, n_words, count`` of all phrases that occur ``least`` times; ``texts`` has no nulls.

    A row of ``n_words`` 0 has a share of all words of the language.  ``run_words`` bounds what a task
    sorts at once, ``bucket_bytes`` the text whose phrases a bucket gets.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-size // bucket_bytes))
    return _merged(_runs(texts, longest, buckets, run_words), longest, least)


# --- streams --------------------------------------------------------------------------------


def _floor_ratio(scale: int, a: Column, left: Column, right: Column) -> Column:
    """``floor(scale * a * a / (left * right))`` in whole numbers, exact for counts below ``10 ** 16``.

    The outcome is ``scale`` at most, as a phrase is not more frequent than its parts.
    """
    whole = "decimal(38,0)"
    above = (a.cast("decimal(19,0)") * a.cast("decimal(19,0)")).cast(whole) * F.lit(scale).cast("decimal(7,0)")
    below = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
    return F.call_function("div", above.cast(whole), below.cast(whole))


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50, scale: int = 1_000_000,
    text_col: str = "text", lang_col: str = "lang", run_words: int = _RUN_WORDS, bucket_bytes: int = _BUCKET_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    Words are lower-cased (A-Z) and stand in pieces between punctuation and line ends; phrases of two to
    ``longest`` words never leave a piece.  A phrase that occurs ``a >= least`` times is cut into a first
    part (``l`` times) and a rest (``r`` times); its ``score`` is the least ``floor(scale * a * a / (l * r))``
    of its cuts, of equal ones the first.  It is dropped if a longer such phrase around it has at least
    ``share`` percent of its occurrences.  ``n`` counts the words of the language.

    A null language is ``und``, a null text empty.  Repeated rows count each time, ids play no part.  Long
    texts are taken in parts that share the words a phrase can span.  Empty tables give no rows.
    """
    texts = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    counts = written(phrase_counts(texts, longest, least, run_words, bucket_bytes))
    totals = counts.where("n_words = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    known = counts.where("n_words > 0").select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), "count")
    words = F.split("phrase", " ")
    phrases = counts.where("n_words > 1").select("lang", "phrase", F.col("count").alias("a"), "n_words", words.alias("words"))

    k = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "k", _part(1, k).alias("head"), _part(k + 1, F.col("n_words") - k).alias("tail")
    )

    def delivered(stream: DataFrame, part: str, name: str, how: str = "inner") -> DataFrame:
        """The counts of ``part`` by a lockstep join of two streams sorted by it."""
        some = known.withColumnRenamed("count", name).hint("merge")
        match = (F.col("lang") == F.col("part_lang")) & (F.col(part) == F.col("part"))
        return stream.join(some, match, how).drop("part_lang", "part")

    in_prefix_order = delivered(cuts, "head", "l")
    in_suffix_order = delivered(in_prefix_order, "tail", "r")
    score = _floor_ratio(scale, F.col("a"), F.col("l"), F.col("r"))
    least_cut = in_suffix_order.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    # A phrase around another one is no more frequent than the extension by one word that lies in it.
    wide = phrases.where("n_words > 2")
    size = F.col("n_words") - 1
    inner = F.explode(F.array(_part(1, size), _part(2, size))).alias("inside")
    extended = wide.select(F.col("lang").alias("wide_lang"), inner, "a").groupBy("wide_lang", "inside").agg(
        F.max("a").alias("longer")
    )
    scored = least_cut.join(
        extended.hint("merge"), (F.col("lang") == F.col("wide_lang")) & (F.col("phrase") == F.col("inside")), "left"
    )
    covered = F.coalesce(100 * F.col("longer") >= share * F.col("a"), F.lit(False))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.where(~covered).select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
