"""Exact, SimHash and suffix duplicates against plain Python."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelwatch.llm import common, exact_dedup, graph, simhash, suffix_dedup


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


def _exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        ids = sorted(ids, key=lambda i: i != keep)
        out += [(i, keep, len(ids), n == 0, _sha(text.encode())) for n, i in enumerate(ids)]
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact(odd, odd_rows, outcome):
    assert outcome(exact_dedup.exact_duplicates(odd), *COLUMNS) == _exact(odd_rows)
    for chunk_bytes in (100, 5000):  # texts of many chunks, and parts of few members
        found = exact_dedup.exact_duplicates(odd, chunk_bytes=chunk_bytes, part_bytes=1)
        assert outcome(found, *COLUMNS) == _exact(odd_rows)


def test_fingerprints_of_chunks_are_those_of_texts(spark, odd):
    texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = {n: sorted(repr(tuple(r)) for r in exact_dedup.fingerprints(texts, n).collect()) for n in (64, 1000, 1 << 20)}
    assert rows[64] == rows[1000] == rows[1 << 20]


def test_exact_in_large_groups(spark, outcome):
    """A group above sixteen members is compared in several parts."""
    rows = [(i, "same text " * 20 if i % 3 else f"own {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert outcome(exact_dedup.exact_duplicates(docs, chunk_bytes=64, part_bytes=100), *COLUMNS) == _exact(rows)


def test_exact_tells_equal_fingerprints_apart(odd, odd_rows, outcome, monkeypatch):
    """With a fingerprint of the length alone, comparison has all the work."""
    monkeypatch.setattr(exact_dedup.Fingerprinter, "__call__", lambda self, raw: (0, 0))
    assert outcome(exact_dedup.exact_duplicates(odd, part_bytes=1), *COLUMNS) == _exact(odd_rows)


def test_fingerprints_compose():
    rng, hashed = np.random.default_rng(1), exact_dedup.Fingerprinter()
    for size in (0, 1, 255, 8191, 8192, 8193, 70_000, 600_000):
        raw = rng.bytes(size)
        plain = tuple(
            sum(b * pow(x, size - 1 - i, p) for i, b in enumerate(raw)) % p if size < 10_000 else None
            for x, p in zip(exact_dedup.POINTS, exact_dedup.PRIMES)
        )
        cut = int(rng.integers(0, size + 1))
        both = exact_dedup.combine(hashed(raw[:cut]), hashed(raw[cut:]), size - cut)
        assert hashed(raw) == both and (plain[0] is None or plain == both)


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def _simhash(text, k):
    words = _words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def test_long_texts_are_taken_in_blocks(odd_rows, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 40)
    for _, text in odd_rows[:40]:
        for k in (1, 3, 5):
            assert simhash.fingerprint(text or "", k) == _simhash(text, k)


def _components(codes, distance):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


def _near(rows, k, distance):
    codes = [_simhash(t, k) for _, t in rows]
    roots, least = _components(codes, distance), {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(repr((i, f"{c:016x}", least.get(r))) for (i, _), c, r in zip(rows, codes, roots))


@pytest.mark.parametrize("distance, capacity", [(3, 4096), (3, 2), (8, 3)])
def test_simhash(odd, odd_rows, outcome, distance, capacity):
    found = simhash.near_duplicates(odd, words=3, distance=distance, capacity=capacity)
    assert outcome(found, "doc_id", "fingerprint", "component_id") == _near(odd_rows, 3, distance)


def test_index_joins_close_codes(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):  # chains and dense clusters
        code = rng.choice(codes[-60:])
        for _ in range(rng.randrange(5)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    codes = sorted(set(codes))
    group = np.zeros(len(codes), np.int64)
    values = np.array(codes, np.uint64)
    values = values[np.argsort(simhash.gray_rank(values))]
    root = simhash._forest(simhash._join(values, group, 3), len(values))
    assert root.tolist() == _components([int(c) for c in values], 3)


def test_close_codes_share_a_node():
    rng = random.Random(4)
    masks = [0]
    for _ in range(2):
        masks = [c for m in masks for c in simhash._children(m, 3)]
    for _ in range(500):
        differ = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not differ & m for m in masks)


def test_gray_ranks():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    random.Random(1).shuffle(links)
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    expected = {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(200)}
    assert dict(map(tuple, found)) == expected and len(found) == len(expected)


def _repeats(rows, length):
    raws, counts = [(t or "").encode() for _, t in rows], {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            counts[raw[i : i + length]] = counts.get(raw[i : i + length], 0) + 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append(repr((doc, len(raw), sum(gone), spans, _sha(kept), kept.decode("utf-8", "ignore"))))
    return sorted(out)


@pytest.mark.parametrize("length, variants", [(200, 12_000), (200, 2), (64, 12_000)])
def test_suffixes(odd, odd_rows, outcome, length, variants):
    found = suffix_dedup.remove_repeats(odd, length=length, most_variants=variants, carry=["size", "spans"])
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    assert outcome(found, *columns) == _repeats(odd_rows, length)
    assert {tuple(r[0]) for r in found.select("carried").collect()} == {(2, None)}


def test_suffixes_of_texts_cut_into_segments(spark, outcome, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    rng = random.Random(9)
    base = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(1, base), (2, base[500:2500]), (3, "x" * 900), (4, base[:1000] + "#" + base[1000:]), (5, "ab" * 400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffix_dedup.remove_repeats(table)
    assert outcome(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept") == _repeats(rows, 200)


def test_empty_tables(none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_passing_tables_are_deleted(spark, odd, outcome, monkeypatch):
    paths = []
    make = common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda session: paths.append(make(session)) or paths[-1])
    plain = outcome(suffix_dedup.remove_repeats(odd), "doc_id", "kept_sha256")
    left, paths[:] = list(paths), []
    with common.passing_tables(spark):
        kept = common.written(suffix_dedup.remove_repeats(odd), lasting=True)
    assert outcome(kept, "doc_id", "kept_sha256") == plain
    assert len(paths) > 3 and [os.path.exists(p) for p in paths] == [False] * (len(paths) - 1) + [True]
    assert all(map(os.path.exists, left))
    with pytest.raises(RuntimeError), common.passing_tables(spark):
        common.written(odd)
        raise RuntimeError
    assert not os.path.exists(paths[-1])
