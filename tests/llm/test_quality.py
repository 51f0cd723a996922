"""Line field, line rules, license scans and shards."""

import itertools
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwatch.llm import licenses, quality_crf, quality_rules, sharding
from parcelwatch.llm.oracles import ORACLES
from parcelwatch.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        evidence, step = rng.normal(size=n), rng.normal(size=(2, 2))
        total, bad = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(e for e, y in zip(evidence, labels) if y)
            weight = np.exp(score + sum(step[a][b] for a, b in zip(labels, labels[1:])))
            total, bad = total + weight, bad + weight * np.array(labels)
        assert np.allclose(quality_crf.bad_marginals(evidence.tolist(), step), bad / total)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    size = np.array([3, 1, 6])
    x = rng.normal(size=(10, quality_crf.WIDTH))
    bad, weights, step = rng.integers(0, 2, 10).astype(float), rng.normal(size=quality_crf.WIDTH) / 5, rng.normal(size=(2, 2))

    def likelihood(weights, step):
        out = 0.0
        for at, n in zip(np.cumsum(size) - size, size):
            evidence, y = x[at : at + n] @ weights, bad[at : at + n].astype(int)
            own = evidence @ y + sum(step[a][b] for a, b in zip(y, y[1:]))
            every = [
                sum(e for e, z in zip(evidence, labels) if z) + sum(step[a][b] for a, b in zip(labels, labels[1:]))
                for labels in itertools.product((0, 1), repeat=int(n))
            ]
            out += own - np.log(np.exp(every).sum())
        return out

    by_weight, by_step, _ = quality_crf._gradient(x, bad, quality_crf._chains(size), weights, step)
    for i in (0, 7):
        move = np.eye(quality_crf.WIDTH)[i] * 1e-5
        slope = (likelihood(weights + move, step) - likelihood(weights - move, step)) / 2e-5
        assert np.isclose(by_weight[i], slope, atol=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        move = np.zeros((2, 2))
        move[a, b] = 1e-5
        slope = (likelihood(weights, step + move) - likelihood(weights, step - move)) / 2e-5
        assert np.isclose(by_step[a, b], slope, atol=1e-4)


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    rows = REGISTRY["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_model_learns_only_from_rows_not_held_out(spark, odd):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    assert not quality_crf.train(odd, labels).weights.any()


def test_scores_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality_crf.train(odd, labels)
    found = quality_crf.score(odd, model).collect()
    by_text = {}
    for i, text in odd_rows:
        by_text.setdefault(i, set()).add(quality_crf.document_score(text or "", model)[0])
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(any(abs(r["score"] - s) < 1e-9 for s in by_text[r["doc_id"]]) for r in found)
    assert quality_crf.score(none, quality_crf.train(none, labels)).count() == 0


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, hit = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rule_counts(odd, odd_rows, outcome, none):
    found = quality_rules.measure(odd)
    assert outcome(found, "doc_id", *COUNTS) == sorted(repr((i, *_counts(t))) for i, t in odd_rows)
    assert found.where("kept AND base_failed").count() == 0
    assert quality_rules.measure(none).count() == 0


def test_repeated_windows_overlap(spark, outcome):
    texts = ["w " * 30, " ".join(map(str, range(8))) * 2, " ".join([*map(str, range(9)), "x", *map(str, range(9))]), "a b c " * 9]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert outcome(quality_rules.measure(table), "doc_id", *COUNTS) == sorted(repr((i, *_counts(t))) for i, t in enumerate(texts))


def test_lines_are_removed_before_documents(spark):
    prose = "\n".join(f"This is sentence number {i} about quite{i} another thing." for i in range(12))
    texts = {
        "clean": prose,
        "bar": prose + "\nHome | News | Sports | Contact | About",
        "boiler": prose + "\nAll rights reserved.",
        "marks": prose + "\n*** ### $$$ %%% !!!",
        "lost": "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(12)) + "\n" + prose[:100],
    }
    table = spark.createDataFrame([(k, t, len(t), "x") for k, t in texts.items()], "doc_id string, text string, n int, kept string")
    found = {r["doc_id"]: r for r in quality_rules.clean(table, "text", "n").collect()}
    assert set(found) == {"clean", "bar", "boiler", "marks"}
    assert {r["text"] for r in found.values()} == {prose} and found["bar"]["n"] == len(prose)
    assert found["clean"]["kept"] == "x"


def _kept_lines(spark, lines):
    """Which of the lines stay when each is judged alone."""
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    return [lines[r["doc_id"]] for r in quality_rules.measure(table).sort("doc_id").collect() if r["n_bad_lines"] == 0]


def test_phrases_inside_clean_lines_stay(spark):
    clean = [
        "The design updates were reviewed.", "Notes from a travel blog in Tokyo", "Assign up to five of them.",
        "He came back to topple the king.", "In terms of use and value it is poor.", "She read the privacy policy aloud in class.",
        "Few readers click here twice, and hardly any sign up.", "A long day. " * 50 + "All rights reserved.",
    ]
    bad = [
        "All rights reserved.", "Copyright (c) 2019-2021 Jane Doe and others. All Rights Reserved.",
        "© 2020 Acme Inc. All rights reserved.", "Privacy Policy | Terms of Use | Cookie Settings", "> Read our privacy policy",
        "This website uses cookies to improve your experience.", "Click here to read more", "Sign up for our newsletter!",
        "Skip to main content", "Back to top", "Log in to your account", "Please enable JavaScript to view this page.",
        "Share on Facebook Share on Twitter", "Subscribe to our weekly newsletter", "Lorem ipsum dolor",
    ]
    assert _kept_lines(spark, clean + bad) == clean
    con, phrase = duckdb.connect(), quality_rules.BOILERPLATE
    hits = [con.execute("SELECT regexp_matches(?, ?)", [x, phrase]).fetchone()[0] for x in clean + bad]
    assert hits == [False] * len(clean) + [True] * len(bad)


def test_punctuation_is_no_junk(spark):
    clean = [
        '"Yes," he said, "no."', "“No!” “Yes!” “Why?” “Go!”", "Stop! Wait! No! Go!", '"Well..." he said. "I... I..."',
        "See Smith (2019), Lee (2020).", "[1] A. B. Lee, C. D. Wu (2019), pp. 3-9.", "1.2, 3.4, 5.6, 7.8", "-1.5; +2.5; -3.5",
        "$12.50, $13.75", "10% 20% 30% 40%", "x = f(a, b);", "if (a && b || c != d) {", "a[i][j] += b[i] * c[j];",
        'd.get("k", [])[0]["x"]', 'print(f("x"));',
    ]
    bad = [
        "*** ### $$$ %%% !!!", "The&&& an.", "En&&& in%%% to%%% the&&&", "THAT!! IN!! THREND!! WITH!!", "w$ w# w@ w$",
        "a # b $ c % d & e * f @", "------", "Chapter 1 ........ 5", "- - - - - -", "(((((((((", "!?!?!?!?", "w* w* w* w*",
    ]
    assert _kept_lines(spark, clean + bad) == clean
    table = spark.createDataFrame([("x", "\n".join(clean * 3))], "id string, text string")
    assert quality_rules.measure(table, "id").first()["lost_chars"] == 0


def test_marks_are_the_same_in_sql_and_linear(spark):
    rng, signs = np.random.default_rng(3), list("aZé7 \t.,;:!?\"'()[]<>-=+*#$%&|/_“”…。\u20ac")
    lines = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    long = [c * 100_000 for c in (" ", ".", ", ", "! a", "\t!", "a ", "a, ", "a && ", "(", "$1 ", "sign up ", "a- ")]
    table = spark.createDataFrame(list(enumerate(lines + long)), "i int, line string")
    found = table.select("i", F.regexp_count("line", F.lit(quality_rules.MARKS)), F.col("line").rlike(quality_rules.BOILERPLATE))
    started = time.monotonic()
    rows = sorted(map(tuple, found.collect()))
    assert time.monotonic() - started < 60
    con = duckdb.connect()
    con.execute("CREATE TABLE lines AS SELECT * FROM (SELECT unnest(?) AS line)", [lines])
    query = "SELECT len(regexp_extract_all(line, ?)), regexp_matches(line, ?) FROM lines"
    same = con.execute(query, [quality_rules.MARKS, quality_rules.BOILERPLATE]).fetchall()
    assert [r[1:] for r in rows[: len(lines)]] == same


def test_rules_stay_out_of_python(odd):
    plan = quality_rules.measure(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark, none):
    notice = dict(licenses.KNOWN[-1:])["MIT"]
    texts = [
        notice, "Copyright (c) 2019 Someone\n\n" + notice.upper().replace("LICENSE", "LICENCE"), notice + " more",
        "Text.\nReleased under the  MIT licence!\nLicensed under CC BY-NC 4.0", None, "", "licensed under nothing",
    ]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, license_id string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    assert [found[i]["text_license"] for i in range(7)] == ["MIT", "MIT", None, None, None, None, None]
    assert (found[3]["n_license_lines"], found[3]["line_licenses"]) == (2, "CC-BY-NC-4.0,MIT")
    assert licenses.scan_licenses(none).count() == 0
    again = licenses.scan_licenses(table.union(table))
    assert again.count() == 14
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_of_null_ids_and_long_texts(spark):
    notice = dict(licenses.KNOWN[-1:])["MIT"]
    long = "word, and word;\n" * 200_000
    rows = [(None, notice, "a"), (None, notice, "b"), (None, None, "c"), (1, long, "d"), (2, long + "Released under the MIT License.\n", "e")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, text_license string")
    found = licenses.scan_licenses(table).collect()
    assert sorted(str(r["text_license"]) for r in found if r["doc_id"] is None) == ["MIT", "MIT", "None"]
    lines = {r["doc_id"]: (r["n_license_lines"], r["text_license"]) for r in found if r["doc_id"]}
    assert lines == {1: (0, None), 2: (1, None)}


def test_usual_licenses_are_known(spark):
    def text(name):
        return (Path(licenses.__file__).with_name("license_texts") / f"{name}.txt").read_text(encoding="utf-8")

    mit = dict(licenses.KNOWN[-1:])["MIT"].split("\n\n", 1)[1]
    bsd = text("BSD-3-Clause")
    two = bsd[: bsd.index("3. ")] + bsd[bsd.index("THIS SOFTWARE") :]
    apache = text("Apache-2.0")
    cases = [
        ("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright Jane Doe 2020\n\n" + mit),
        ("MIT", "Copyright Jane Doe, 2019-2020. All rights reserved.\nCopyright John Roe 2021\r\n" + mit),
        ("BSD-3-Clause", bsd), ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, A\n\n" + two),
        ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 A")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        *((i, text(i)) for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")),
        (None, "Copyright notice of Jane Doe 2020 must stay, and\n" + mit),
    ]
    lines = ["GPL-3.0-or-later", "LGPL", "MPL-2.0", "BSD-2-Clause", "Apache-2.0 OR MIT"]
    rows = [t for _, t in cases] + [f"x\n// SPDX-License-Identifier: {i}\ny" for i in lines]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = licenses.scan_licenses(table).sort("doc_id").collect()
    assert [r["text_license"] for r in found[: len(cases)]] == [i for i, _ in cases]
    assert [r["line_licenses"] for r in found[len(cases) :]] == lines


def test_licenses_at_any_wrap(spark):
    """Whole texts are known however their paragraphs are wrapped."""
    import textwrap

    cases = []
    for name in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"):
        text = (Path(licenses.__file__).with_name("license_texts") / f"{name}.txt").read_text(encoding="utf-8")
        for width in (60, 72, 100, 100_000):
            paragraphs = re.split(r"\n[ \t]*\n", text)
            cases.append((name, width, "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)))
    table = spark.createDataFrame([(i, c[2]) for i, c in enumerate(cases)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["text_license"] for r in licenses.scan_licenses(table).collect()}
    missed = [(name, width) for i, (name, width, _) in enumerate(cases) if found[i] != name]
    assert not missed


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = REGISTRY[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, expected))


def test_shards(odd, odd_rows, none):
    placed, slot_map = sharding.shard_documents(odd, shards=4, slots=64)
    rows = placed.collect()
    measured = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    raw = [(i, (t or "").encode(), t) for i, t in odd_rows]
    assert measured == sorted((i is None, i or 0, len(b) + 16, zlib.crc32(b)) for i, b, _ in raw)
    for shard in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    place = {slot: shard for slot, shard, _, _ in slot_map}
    assert all(place[r["virtual_slot"]] == r["shard"] for r in rows)
    assert sharding.shard_documents(none)[0].count() == 0


def test_shards_are_of_near_equal_bytes(spark):
    """A text with a third of all rows does not weigh on one shard."""
    size = F.when(F.col("id") % 3 == 0, 300).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size.cast("int")).alias("text"))
    placed, _ = sharding.shard_documents(docs, shards=40)
    bytes_of = [r["n"] for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(bytes_of) == 40 and max(bytes_of) <= 1.005 * min(bytes_of)


def test_slot_maps(spark, tmp_path):
    rng = np.random.default_rng(1)
    sizes = list(enumerate(rng.integers(1, 2000, 4096).tolist()))
    first = sharding.first_map(sizes, 40)

    def loads(rows):
        out = {}
        for _, shard, size, _ in rows:
            out[shard] = out.get(shard, 0) + size
        return out

    assert max(loads(first).values()) <= 1.001 * min(loads(first).values())
    grown = sharding.grown_map(first)
    assert all(b[1] in (a[1], 40) for a, b in zip(first, grown)) and len(loads(grown)) == 41
    assert max(loads(grown).values()) <= 1.05 * min(loads(grown).values())
    changed = [(s, 3 * n if s % 40 == 0 else n) for s, n in sizes]
    edited = sharding.rebalanced_map(grown, changed)
    moved = sum(a[1] != b[1] for a, b in zip(grown, edited))
    assert max(loads(edited).values()) <= 1.03 * np.mean(list(loads(edited).values())) and 0 < moved < 1000
    for version in (first, grown, edited):
        sharding.store_map(spark, version, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")) == edited
    assert sharding.load_map(spark, str(tmp_path / "map"), 0) == first


def test_plain_marks_bound_the_patterns(spark):
    """Lines with too few characters beside letters, numbers and blanks need neither pattern."""
    rng = np.random.default_rng(6)
    chars = list("ab7é漢 \t") + list("!?%$&|<>=*()[]{},;:'\"./_+-…¿¡、。»›•·#@©~^`\\€") + ["...", " | ", " > ", "&&", " == ", "8%"]
    lines = [("".join(rng.choice(chars, rng.integers(0, 30))),) for _ in range(20_000)]
    line = F.col("line")
    marks, bars, plain = (
        F.regexp_count(line, F.lit(p)) for p in (quality_rules.MARKS, quality_rules.SEPARATORS, quality_rules.PLAIN)
    )
    words, size = F.regexp_count(line, F.lit(r"[^ \t-\r]+")), F.length(line)
    ungated = (
        ((marks >= quality_rules.MIN_MARKS) & (marks * 100 > size * quality_rules.MARK_PERCENT))
        | ((bars >= quality_rules.MIN_SEPARATORS) & (bars * 100 > words * quality_rules.SEPARATOR_PERCENT))
        | line.rlike(quality_rules.BOILERPLATE)
    )
    seen = spark.createDataFrame(lines, "line string").select(
        (marks <= plain).alias("a"), (bars <= plain).alias("b"),
        (quality_rules.line_fails(line) == ungated).alias("c"), ungated.alias("fails"),
    ).collect()
    assert all(r["a"] and r["b"] and r["c"] for r in seen)
    assert 1000 < sum(r["fails"] for r in seen) < 19_000
