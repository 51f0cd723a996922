"""Benchmark decontamination by suffix arrays of the training texts.

Every task turns its share of the documents into shards of bounded size and builds a suffix array over the
words of each.  All suffixes of the benchmark are looked up in it by binary search, which gives the longest
verbatim match of each suffix and the places of all windows that occur.  Documents never leave their task.

Words are compared as numbers from the benchmark's vocabulary, which are exact: a word that no item has is 0
and matches nothing.  The benchmark is the query set; it is dealt into blocks of bounded size, and each block
is looked up in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns, written

# ASCII capitals become small letters, other ASCII but digits and letters blanks; the rest stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CHUNK = 1 << 22
_SHARD = 1 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _chunks(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in runs of bounded size; a run ends between two words."""
    at = 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        part = raw[at:end].translate(_FOLD)
        if end < len(raw):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(raw):  # one word is longer than a run
                more = raw[end : end + _CHUNK].translate(_FOLD)
                end += len(more)
                gap = more.find(b" ")
                cut, part = (len(part) + gap if gap >= 0 else -1), part + more
            if cut >= 0:
                part = part[:cut]
        at += max(len(part), 1)
        yield part.split()


def _pack(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of numbers below ``2 ** bits`` as fewer 64-bit keys of the same order."""
    each = 64 // bits
    keys = []
    for i in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.uint64)
        for column in columns[i : i + each]:
            key = (key << np.uint64(bits)) | column.astype(np.uint64)
        keys.append(key << np.uint64(bits * (each - len(columns[i : i + each]))))
    return keys


class SuffixArray:
    """Suffixes of a sequence of word numbers, ordered by their first ``depth`` words.

    ``at`` has the places in order.  Suffixes whose first word is 0 match nothing and are left out.
    """

    def __init__(self, ids: np.ndarray, depth: int, bits: int) -> None:
        self.ids = np.concatenate((ids, np.zeros(depth, ids.dtype)))
        self.depth, self.bits = depth, bits
        place = np.flatnonzero(ids)
        keys = _pack([self.ids[place + i] for i in range(depth)], bits)
        order = np.argsort(keys[0])
        for i, key in enumerate(keys[1:], 1):
            # Only suffixes that agree so far need the next words.
            same = np.append(False, np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys[:i]]))
            tied = np.flatnonzero(same | np.append(same[1:], False))
            if not len(tied):
                break
            group = np.cumsum(~same[tied])
            order[tied] = order[tied][np.lexsort((key[order[tied]], group))]
        self.at = place[order]
        self.keys = [k[order] for k in keys]

    def _bound(self, wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """How many suffixes stand before each wanted key, by bisection."""
        low = np.searchsorted(self.keys[0], wanted[0], "left")
        high = np.searchsorted(self.keys[0], wanted[0], "right")
        if len(self.keys) == 1:
            return high if right else low
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            before, even = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for key, want in zip(self.keys[1:], wanted[1:]):
                key, want = key[mid], want[open_]
                before |= even & (key < want)
                even &= key == want
            before |= even & right
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        return low

    def find(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Range in ``at`` of the suffixes that begin with the first ``size`` words of each query."""
        columns = [queries[:, i] for i in range(size)]
        none, all_ = np.zeros(len(queries), np.int64), np.full(len(queries), (1 << self.bits) - 1, np.int64)
        rest = self.depth - size
        low = self._bound(_pack(columns + [none] * rest, self.bits), False)
        return low, self._bound(_pack(columns + [all_] * rest, self.bits), True)

    def longest(self, sequence: np.ndarray, starts: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Length of the longest match of each suffix of ``sequence``, a neighbour of its place."""
        place = self._bound(_pack([queries[:, i] for i in range(self.depth)], self.bits), False)
        best = np.zeros(len(starts), np.int64)
        if not len(self.at):
            return best
        for neighbour in (np.maximum(place - 1, 0), np.minimum(place, len(self.at) - 1)):
            at, size = self.at[neighbour], np.zeros(len(starts), np.int64)
            live = np.arange(len(starts))
            while len(live):
                a, b = at[live] + size[live], starts[live] + size[live]
                fits = (a < len(self.ids)) & (b < len(sequence))
                live, a, b = live[fits], a[fits], b[fits]
                live = live[(self.ids[a] == sequence[b]) & (sequence[b] > 0)]
                size[live] += 1
            best = np.maximum(best, size)
        return best


class Benchmark:
    """Suffixes and windows of a block of items, as numbers of their own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        words = [(number[name], words_of(raw)) for name, raw in items]
        vocabulary = sorted({w for _, some in words for w in some})
        self.rank = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.names, self.window = names, window
        self.bits = max(1, len(vocabulary).bit_length())
        # All items in one sequence, a 0 behind each.
        owner, ids = [], []
        for item, some in words:
            ids += [*map(self.rank.__getitem__, some), 0]
            owner += [item] * (len(some) + 1)
        self.ids = np.array([*ids, *[0] * window], np.int64)
        item = np.array(owner, np.int64)
        self.starts = np.flatnonzero(self.ids[: len(owner)])
        self.suffixes = self.ids[self.starts[:, None] + np.arange(window)]
        ends = np.flatnonzero(self.ids[: len(owner)] == 0)
        left = ends[np.searchsorted(ends, self.starts)] - self.starts  # words to the end of the item
        size = np.diff(ends, prepend=-1) - 1
        whole = size[np.searchsorted(ends, self.starts)]
        # Words behind the end of an item belong to others.
        self.suffixes[np.arange(window) >= left[:, None]] = 0
        # Distinct windows and the items that have them.
        wide = np.minimum(whole, window)
        begins = np.flatnonzero(left >= wide)
        rows = np.column_stack((wide[begins], self.suffixes[begins]))
        self.windows, self.example, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.example = begins[self.example]
        self.owners: list[set[int]] = [set() for _ in self.windows]
        for w, i in zip(which.ravel().tolist(), item[self.starts[begins]].tolist()):
            self.owners[w].add(i)


def _search(array: SuffixArray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and places of all occurrences."""
    # A window occurs where the longest match of its suffix is as long.
    longest = array.longest(bench.ids, bench.starts, bench.suffixes)[bench.example]
    numbers, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(bench.windows[:, 0]).tolist():
        some = np.flatnonzero((bench.windows[:, 0] == size) & (longest >= size))
        low, high = array.find(bench.windows[some, 1:], size)
        count = high - low
        numbers.append(np.repeat(some, count))
        shift = np.repeat(low - (np.cumsum(count) - count), count)
        places.append(array.at[np.arange(int(count.sum())) + shift])
    return np.concatenate(numbers), np.concatenate(places)


class _Text:
    """What is known of one text: its words, and where which windows were found."""

    def __init__(self) -> None:
        self.n_words, self.first, self.last, self.found = 0, [], [], set()

    def add(self, first: np.ndarray, size: np.ndarray, window: np.ndarray) -> None:
        self.first.append(first)
        self.last.append(first + size - 1)
        self.found.update(np.unique(window).tolist())

    def spans(self) -> list[dict[str, int]]:
        """Maximal runs of hit words."""
        if not self.first:
            return []
        first, last = np.concatenate(self.first), np.concatenate(self.last)
        order = np.argsort(first, kind="stable")
        first, reach = first[order], np.maximum.accumulate(last[order])
        new = np.append(True, first[1:] > reach[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(first)) - 1
        return [{"first": a, "last": b} for a, b in zip(first[begin].tolist(), reach[end].tolist())]


def _solve(shard: list[tuple[_Text, int, np.ndarray]], bench: Benchmark) -> None:
    """Look all of the benchmark's suffixes up in one shard; runs of words are parted by 0."""
    begin = np.cumsum([0, *(len(ids) + 1 for _, _, ids in shard)])
    ids = np.concatenate([np.append(ids, 0) for _, _, ids in shard])
    array = SuffixArray(ids, bench.window, bench.bits)
    if not len(array.at):
        return
    window, place = _search(array, bench)
    run = np.searchsorted(begin, place, side="right") - 1
    order = np.lexsort((place, run))
    window, place, run = window[order], place[order], run[order]
    for r in np.unique(run).tolist():
        text, offset, words = shard[r]
        a, b = np.searchsorted(run, [r, r + 1])
        first = place[a:b] - begin[r]
        text.add(first + offset, bench.windows[window[a:b], 0], window[a:b])


def _matches(texts: DataFrame, bench, window: int, shard_words: int) -> DataFrame:
    """``sha, doc_id, n_words, spans, items`` of every text, for one block of the benchmark."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bench.value
        rank = known.rank.get
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            texts, shard, held = [], [], 0
            for cell in batch.column(2):
                text = _Text()
                texts.append(text)
                tail = np.zeros(0, np.int64)
                for words in _chunks(cell.as_buffer().to_pybytes()):
                    ids = np.fromiter(map(rank, words, repeat(0)), np.int64, len(words))
                    ids = np.concatenate((tail, ids))
                    shard.append((text, text.n_words - len(tail), ids))
                    text.n_words += len(words)
                    # The next run begins with the words that a window may share with this one.
                    tail = ids[max(0, len(ids) - window + 1) :]
                    held += len(ids)
                    if held >= shard_words:
                        _solve(shard, known)
                        shard, held = [], 0
            if shard:
                _solve(shard, known)
            items = [sorted({known.names[i] for w in t.found for i in known.owners[w]}) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([t.n_words for t in texts], pa.int64()),
                    pa.array([t.spans() for t in texts], span), pa.array(items, pa.list_(pa.string())),
                ],
                ["sha", "doc_id", "n_words", "spans", "items"],
            )

    schema = f"sha string, doc_id {kind}, n_words bigint, spans array<struct<first: bigint, last: bigint>>"
    return texts.select("sha", "doc_id", "text").mapInArrow(run, schema + ", items array<string>")


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[Callable]:
    """The items in blocks of about ``block_bytes``, to be fetched one after the other."""
    text = F.coalesce(items[text_col], F.lit(""))
    rows = items.select(F.coalesce(items[item_col].cast("string"), F.lit("")).alias("item"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))

    def fetch(some: DataFrame) -> list[tuple[str, bytes]]:
        return [(r["item"], r["text"].encode()) for r in some.collect()]

    return [partial(fetch, rows.where(block == i) if n > 1 else rows) for i in range(n)]


def find_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = _SHARD, block_bytes: int = 1 << 24,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole of an item that has fewer words;
    an item without words has none.  ``spans`` are the maximal runs of words that some occurrence covers
    (``first`` and ``last``, from 0), ``n_hit`` their words, ``items`` the ids, as sorted strings, of the
    items with a window that occurs.  Rows of the benchmark with one id are one item; a null id is the
    empty string.  A null text has no words; null ids, repeated rows and very long texts (searched in
    overlapping runs) are kept as they are.  An empty table gives no rows, an empty benchmark no hits.

    One block of the benchmark (``block_bytes``) is sent to every task, and the corpus is read once for
    each block.  A shard has ``shard_words`` words and one run of words at most.
    """
    spark = docs.sparkSession
    texts = own_columns(docs, id_col, text_col)
    blocks = _blocks(items, item_col, item_text_col, block_bytes)
    # An id and the digest of a text say which row is meant when several reads are brought together.
    sha = F.sha2(F.col("text").cast("binary"), 256) if len(blocks) > 1 else F.lit("")
    texts = texts.withColumn("sha", sha)
    found = [
        _matches(texts, spark.sparkContext.broadcast(Benchmark(rows(), window)), window, shard_words) for rows in blocks
    ]
    merged = found[0] if len(found) == 1 else _merge_blocks(found)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _merge_blocks(found: list[DataFrame]) -> DataFrame:
    """Spans and items of all blocks together; of the rows, only those that a block hits are shuffled."""
    found = [written(f) for f in found]
    hits = reduce(DataFrame.union, found).where(F.size("items") > 0)
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("sha").alias("hit_sha")).agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("every"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
    )

    def joined(runs, s):
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        before = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        touches = F.coalesce(s["first"] <= last["last"] + 1, F.lit(False))
        return F.when(touches, F.concat(before, F.array(longer))).otherwise(F.concat(runs, F.array(s)))

    hits = hits.withColumn("hit_spans", F.aggregate("every", F.slice("every", 1, 0), joined))
    rows = found[0].select("doc_id", "sha", "n_words")
    match = rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["sha"] == hits["hit_sha"])
    return rows.join(hits, match, "left").select(
        "doc_id", "n_words",
        *(F.coalesce(f"hit_{c}", F.array().cast(found[0].schema[c].dataType)).alias(c) for c in ("spans", "items")),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, **columns) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    whole = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("sha")).alias("key"), docs[text_col].alias("text"), F.struct("*").alias("doc"))
    rest = {k: v for k, v in columns.items() if k not in ("id_col", "text_col")}
    found = find_matches(whole, items, window, "key", "text", **rest)
    bad = written(found.where("n_hit > 0").select(F.col("doc_id.id").alias("bad_id"), F.col("doc_id.sha").alias("bad_sha")).distinct())
    match = F.col("key.id").eqNullSafe(F.col("bad_id")) & (F.col("key.sha") == F.col("bad_sha"))
    return whole.join(bad, match, "left_anti").select("doc.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **columns) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``."""
    found = find_matches(docs, items, window, **columns)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


