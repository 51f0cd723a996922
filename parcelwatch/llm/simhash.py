"""SimHash near-duplicates through a Gray-ordered hierarchical index of fingerprints.

The index is a forest.  Its upper nodes factor out a mask of bits and the pattern that their
members share there: within ``distance`` bits, one of ``distance + 1`` parts of the bits must agree,
so each fingerprint goes to the node of each part, and nodes with many members are split again by
parts of their free bits.  Below, members stand in the order of their Gray ranks, which puts similar
patterns next to each other; every run of eight is a node that again factors out what its members
share, up to one node for the group.  Nodes are joined top down: differences in the factored bits
stay counted below, so a pair of nodes that differs too much is dropped whole, and one that cannot
differ too much links whole.  Each group passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns, written
from parcelwatch.llm.graph import components

_FAN = 8
_PAIRS = 1 << 19
_SHINGLES = 1 << 16
_BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _add_bits(found: list[bytes], words: int, seed: int, ones: np.ndarray) -> int:
    """Count the bits of all shingles of consecutive words; returns the number of shingles."""
    joined, n = b" ".join(found), len(found) - words + 1
    length = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(length + 1) - 1
    begin, end, digest = (end - length)[:n].tolist(), end[words - 1 :].tolist(), xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        cut = zip(begin[at : at + _SHINGLES], end[at : at + _SHINGLES])
        hashes = np.array([digest(joined[a:b], seed) for a, b in cut], ">u8").view(np.uint8)
        for i, column in enumerate(hashes.reshape(-1, 8).T):
            ones[8 * i : 8 * i + 8] += np.bincount(column, minlength=256) @ _BITS
    return n


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """64-bit SimHash of the ``words``-word shingles of a text; zero without words.

    A long text is taken block by block; the last words of a block go on into the next.
    """
    raw = text.encode().lower()
    ones, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw):
        gap = _BLANK.search(raw, at + _BLOCK)
        end = gap.start() if gap else len(raw)
        held += raw[at:end].split()
        at = end
        if len(held) >= words:
            n += _add_bits(held, words, seed, ones)
            held = held[len(held) - words + 1 :]
    if not n and held:
        n = _add_bits(held, len(held), seed, ones)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(texts: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """``doc_id, code``: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(text.as_py(), words, seed) for text in batch.column(1)]
            codes = np.array(codes, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "code"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, code bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _children(mask: int, distance: int) -> list[int]:
    """``mask`` with one of ``distance + 1`` parts of its free bits added."""
    free = [bit for bit in range(63, -1, -1) if not mask >> bit & 1]
    return [
        mask | sum(1 << int(bit) for bit in part)
        for part in np.array_split(np.array(free, object), distance + 1) if len(part)
    ]


def upper_nodes(codes: DataFrame, distance: int, capacity: int = 4096, levels: int = 4) -> DataFrame:
    """``mask, pattern, code``: members of the nodes that hold more than one fingerprint.

    Any two codes within ``distance`` bits share a node.  A node above ``capacity`` is replaced by
    its children, level by level; on the last one so few bits are free that a node is bounded by
    their combinations.
    """
    rows = codes.select(F.lit(0).cast("bigint").alias("mask"), "code")
    masks, done = [0], []
    for level in range(levels):
        below = {m: _children(m, distance) for m in masks}
        masks = [c for children in below.values() for c in children]
        table = F.create_map(*(
            part for m, children in below.items()
            for part in (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in children)))
        ))
        rows = rows.select(F.explode(F.element_at(table, F.col("mask"))).alias("mask"), "code")
        rows = rows.select("mask", F.expr("code & mask").alias("pattern"), "code")
        if level == levels - 1:
            done.append(rows)
            break
        sizes = rows.groupBy("mask", "pattern").count()
        large = written(sizes.where(F.col("count") > capacity).select("mask", "pattern"))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, ["mask", "pattern"], "left_anti"))
        rows = rows.join(large, ["mask", "pattern"], "left_semi").select("mask", "code")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _levels(codes: np.ndarray, group: np.ndarray) -> list[tuple]:
    """From single codes up to one node per group: AND, OR, first and number of children."""
    one = np.ones(len(codes), np.int64)
    out = [(codes, codes, np.arange(len(codes)), one)]
    while True:
        low, high = out[-1][:2]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        if len(new) == len(group):
            return out
        inside = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
        first = np.flatnonzero(inside % _FAN == 0)
        count = np.diff(np.append(first, len(group)))
        out.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), first, count))
        group = group[first]


def _join(codes: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between places of ``codes``, which are ordered by group and Gray rank."""
    tree = _levels(codes, group)
    # Places below each node, for nodes that link as a whole.
    below = [(np.arange(len(codes)), np.ones(len(codes), np.int64))]
    for _, _, first, count in tree[1:]:
        start, size = below[-1]
        below.append((start[first], np.add.reduceat(size, first)))
    top = np.arange(len(tree[-1][0]))
    stack = [(len(tree) - 1, top[i : i + _PAIRS], top[i : i + _PAIRS]) for i in range(0, len(top), _PAIRS)]
    while stack:
        level, a, b = stack.pop()
        low, high, first, count = tree[level]
        shared = ~(low[a] ^ high[a]) & ~(low[b] ^ high[b])
        apart = np.bitwise_count((low[a] ^ low[b]) & shared)
        free = np.bitwise_count(~shared)
        near = apart + free <= distance
        start, size = below[level]
        if level == 0:
            near &= a != b
            yield a[near], b[near]
            continue
        if near.any():
            for x, y in ((a[near], b[near]), (b[near], a[near])):
                yield _ranges(start[x], size[x]), np.repeat(start[y], size[x])
        open_ = ~near & (apart <= distance)
        a, b = a[open_], b[open_]
        step = max(1, _PAIRS // (_FAN * _FAN))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            number = count[x] * count[y]
            within = _ranges(np.zeros(len(x), np.int64), number)
            width = np.repeat(count[y], number)
            u = np.repeat(first[x], number) + within // width
            v = np.repeat(first[y], number) + within % width
            once = u <= v
            stack.append((level - 1, u[once], v[once]))


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each place the smallest one it is linked to, directly or not."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = root[a], root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _group_links(rows: DataFrame, distance: int) -> DataFrame:
    """A spanning forest ``u, v`` of the links in each group of rows sorted by node."""

    def solve(mask: np.ndarray, pattern: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(code), pattern, mask))
        mask, pattern, code = mask[order], pattern[order], code[order]
        new = np.append(True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        code, group = code[many], group[many]
        u = v = np.zeros(0, np.int64)
        if len(code):
            root = _forest(_join(code, group, distance), len(code))
            linked = root != np.arange(len(code))
            u, v = code.view(np.int64)[linked], code.view(np.int64)[root[linked]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns[2] = columns[2].view(np.uint64)
            held = [np.concatenate(pair) for pair in zip(held, columns)]
            if len(held[0]) < 1 << 17:
                continue
            # The last group may go on in the next batch.
            last = (held[0] != held[0][-1]) | (held[1] != held[1][-1])
            whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if whole:
                yield solve(*(c[:whole] for c in held))
                held = [c[whole:] for c in held]
        yield solve(*held)

    return rows.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 3, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints that differ in at most ``distance`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` that links lead to (nulls are passed over).  Texts without words, null ones
    too, have fingerprint zero and are linked like any other; repeated rows are kept.  Equal
    fingerprints are one entry of the index, however many rows have them.  Long texts are read in
    blocks; an empty table gives no rows.
    """
    base = written(fingerprints(own_columns(docs, id_col, text_col), words, seed))
    codes = written(base.groupBy("code").agg(F.min("doc_id").alias("low")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = upper_nodes(codes.select("code"), distance, capacity).repartition(n, "mask", "pattern")
    links = _group_links(nodes.sortWithinPartitions("mask", "pattern"), distance)
    found = components(links, "u", "v")
    placed = codes.join(found, codes["code"] == found["node"], "left").select(
        "code", "low", F.coalesce("root", "code").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return base.join(placed.join(least, "root").select("code", "component_id"), "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )
