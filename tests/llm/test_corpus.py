"""Collocations, decontamination and manifests against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parcelwatch.llm import collocations, decontamination, merkle


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- collocations ---------------------------------------------------------------------------


def _collocations(rows, longest=3, least=10, top=2000, share=50):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in known.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in known.items():
            if longer[p] and 100 * longer[p] >= share * a:
                continue
            cuts = ((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(map(repr, out))


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    words = "a b c D é \xa0x \x00 the of".split(" ")
    gaps = [" "] * 4 + ["  ", "\t", ". ", "\n", ", "]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))

    base = text(30)
    rows = [(rng.choice([None, "en", "en", "fr", "und"]), rng.choice([None, "", text(5), text(40), base])) for _ in range(150)]
    return rows + [("en", text(4000)), ("en", "z" * 3000 + " " + text(40)), ("de", "once upon a time " * 12)]


@pytest.mark.parametrize("options", [{}, {"top": 30}, {"longest": 5, "share": 80}, {"longest": 2, "least": 3}])
@pytest.mark.parametrize("sizes", [{}, {"run_words": 50, "bucket_bytes": 1000}, {"run_words": 7, "bucket_bytes": 300}])
def test_collocations(spark, spoken, outcome, options, sizes):
    docs = spark.createDataFrame(spoken, "lang string, text string").withColumn("phrase", F.lit("x")).repartition(3)
    found = collocations.collocations(docs, **options, **sizes)
    assert outcome(found, *PHRASE) == _collocations(spoken, **options)


def test_large_vocabularies_and_sums(monkeypatch):
    """Rows of numbers too wide for one key are sorted all the same."""
    rng = random.Random(2)
    rows = [[rng.randrange(3) for _ in range(300)] for _ in range(3)]
    columns = [collocations.np.array(r) for r in rows]
    counts = collocations.np.arange(300)
    narrow, wide = (collocations._summed(columns, counts, limit) for limit in (3, 1 << 40))
    expected = collections.Counter()
    for i, gram in enumerate(zip(*rows)):
        expected[gram] += i
    for (some, sums) in (narrow, wide):
        assert dict(zip(zip(*(c.tolist() for c in some)), sums.tolist())) == dict(expected)


def test_scores_are_exact(spark):
    numbers = [(10**15 + 7, 10**15 + 9, 10**15 + 8), (3, 7, 10**15), (10, 10, 10), (999_999_999_999, 10**12, 10**12 + 1)]
    table = spark.createDataFrame(numbers, "a bigint, l bigint, r bigint")
    got = table.select("a", "l", "r", collocations._floor_ratio(1_000_000, F.col("a"), F.col("l"), F.col("r")).alias("s"))
    for a, left, right, score in got.collect():
        assert score == 1_000_000 * a * a // (left * right)


def test_planted_phrase_leads(spark):
    """Ten times the same three words, among words that occur once."""
    rows = [("en", f"w{i} Blue Harbour lights w{i + 1000}.") for i in range(10)]
    (only,) = collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert tuple(only) == ("en", 1, "blue harbour lights", 10, 10, 10, 50, 1_000_000)


# --- decontamination ------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _contamination(docs, items, window):
    asked = collections.defaultdict(set)
    for i, text in items:
        words = WORD.findall(_lower(text))
        k = min(window, len(words))
        for a in range(len(words) - k + 1) if k else ():
            asked[tuple(words[a : a + k])].add("" if i is None else str(i))
    sizes, out = {len(w) for w in asked}, []
    for i, text in docs:
        words, hit, ids = WORD.findall(_lower(text)), set(), set()
        for k in sizes:
            for a in range(len(words) - k + 1):
                if found := asked.get(tuple(words[a : a + k])):
                    ids |= found
                    hit |= set(range(a, a + k))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def exam():
    rng = random.Random(3)
    words = "a b c dé é7 漢 X Y".split()

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "\n", "-", " ' "]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 8, 12, 30]))) for i in range(25)] + [(None, text(5)), (3, text(6)), (4, None)]
    docs = [(None if i % 9 == 8 else i, text(rng.randrange(60))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, text(3000)), (503, "q" * 9000 + " " + text(50)), (504, items[-2][1])]
    return docs + docs[:5], items


@pytest.mark.parametrize("window", [1, 4, 10])
@pytest.mark.parametrize("sizes", [{}, {"shard_words": 7}, {"block_bytes": 900}])
def test_contamination(spark, exam, outcome, monkeypatch, window, sizes):
    docs, items = exam
    if "shard_words" in sizes:
        monkeypatch.setattr(decontamination, "_CHUNK", 40)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("spans", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("sha", F.lit("x"))
    assert outcome(decontamination.contamination(table, asked, window, **sizes), *HITS) == _contamination(docs, items, window)


def test_decontaminate_keeps_clean_rows(spark, exam):
    docs, items = exam
    clean = [r for r, found in zip(docs, (_contamination([d], items, 4)[0] for d in docs)) if found.endswith("False)")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("key", F.lit(1))
    left = decontamination.decontaminate(table, spark.createDataFrame(items, "item_id bigint, text string"), 4)
    assert left.columns == table.columns
    assert sorted(map(repr, ((r[0], r[1]) for r in left.collect()))) == sorted(map(repr, clean))


def test_longest_matches_and_order():
    rng = random.Random(4)
    ids = decontamination.np.array([rng.randrange(4) for _ in range(500)])
    array = decontamination.SuffixArray(ids, 6, 33)  # one word a key
    padded = [*ids.tolist(), *[0] * 6]
    suffixes = [padded[i : i + 6] for i in array.at.tolist()]
    assert suffixes == sorted(suffixes) and len(suffixes) == int((ids > 0).sum())
    asked = [rng.randrange(1, 4) for _ in range(60)]
    sequence = decontamination.np.array([*asked, *[0] * 6])
    starts = decontamination.np.arange(60)
    windows = sequence[starts[:, None] + decontamination.np.arange(6)]

    def longest(i):
        whole = "".join(map(str, padded))
        return max(k for k in range(61 - i) if "".join(map(str, asked[i : i + k])) in whole)

    best = array.longest(sequence, starts, windows).tolist()
    # Matches beyond the sorted depth are found if one of the neighbours has them.
    assert all(b == w if w <= 6 else b >= 6 for b, w in zip(best, map(longest, range(60))))


# --- manifests ------------------------------------------------------------------------------


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        run = level[first : first + 3]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= 3
    return out


def _manifest(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for some in by_source.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {s: _levels([_leaf(r) for r in by_source[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path = _path(trees[s], i) + _path(top, k)
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = _leaf((*r[:4], r[4].replace("\n", "")) if cut else r)
            for before, behind in path:
                folded = _sha("".join(before) + folded + "".join(behind))
            proof = _sha("".join("".join(a + b) for a, b in path))
            out.append((r[0], _leaf(r), trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(map(repr, out))


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LEAVES = "doc_id bigint, source string, lang string, n_chars bigint, text string, idx int, proof string"


@pytest.mark.parametrize("n, levels", [(1, 5), (2, 5), (3, 1), (4, 1), (60, 1), (300, 2), (900, 5)])
def test_manifest(spark, outcome, monkeypatch, n, levels):
    rng = random.Random(n)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "_BLOCK", f"idx div {3**levels}")
    rows = [
        (
            None if i % 31 == 30 else i, rng.choice([None, "b", "é", "Z", "a", "a", "a", ""]), rng.choice([None, "en"]),
            rng.choice([None, i]), rng.choice([None, "", "x\ny", "é\n" * 5, "plain", "long\n" * 5000]), 1, "p",
        )
        for i in range(n)
    ]
    rows += rows[: n // 10]
    docs = spark.createDataFrame(rows, LEAVES).repartition(3)
    found = merkle.manifest(docs, tampered=merkle.without_line_ends)
    assert outcome(found, *MANIFEST) == _manifest([r[:5] for r in rows])


def test_planted_manifest(spark):
    """Four leaves of one source: two runs, of which the second is a single node."""
    docs = spark.createDataFrame([(i, "s", None, None, f"t{i}") for i in range(4)], LEAVES.split(", idx")[0])
    rows = {r["doc_id"]: r for r in merkle.manifest(docs).collect()}
    leaves = [_sha(f"1:{i}1:s--2:t{i}") for i in range(4)]
    first, second = _sha("".join(leaves[:3])), _sha(leaves[3])
    assert rows[3]["root"] == rows[3]["subroot"] == _sha(first + second)
    assert rows[1]["proof"] == f"1{leaves[0]}{leaves[2]},0{second}"
    assert rows[3]["proof"] == f"0,1{first}" and rows[3]["proof_sha256"] == _sha(first)
    assert all(r["verified"] and r["leaf"] == leaves[i] for i, r in rows.items())


# --- common ---------------------------------------------------------------------------------


def test_empty_tables(spark, none):
    docs = none.withColumn("lang", F.lit("x")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    items = none.select(F.col("doc_id").alias("item_id"), "text")
    assert collocations.collocations(docs).collect() == []
    assert decontamination.contamination(docs, items).collect() == []
    assert merkle.manifest(docs).collect() == []
    one = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    (row,) = decontamination.contamination(one, items).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)
