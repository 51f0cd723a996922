"""Chunks and parts against the operators that read whole files and lines."""

import random

import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import automata, chunks, ioc, lines, long_lines
from parcelwatch.plans import scan

SCANNERS = ("static", "obfuscation", "secrets", "ioc")


def _rows(df):
    return sorted(map(repr, df.collect()))


def _random(rng, pieces, most):
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("size", [1, 2, 7, 65536])
def test_comment_lines_at_any_size(make_files, size):
    rng = random.Random(11)
    pieces = ["/*", "*/", "a", " ", "\n", "\n", "/", "*", "é😀"]
    texts = {f"f{i}.js": _random(rng, pieces, 40) for i in range(300)}
    files = make_files({"p": texts | {"empty.js": "", "null.js": None, "open.js": "/*" + "x\n" * 60}, "q": {"f1.js": "/*\na"}})
    expected = lines.block_comment_lines(files)
    got = chunks.comment_lines(files, size)
    assert got.columns == expected.columns and dict(got.dtypes) == dict(expected.dtypes)
    assert _rows(got) == _rows(expected)
    assert got.count() > 300


def test_joined_leftovers_open_a_comment(make_files):
    # With closed comments left out, a slash and a star may come together.
    texts = {"a.js": "//*x*/*\nin\n*/ out\nout", "b.js": "//*x*//*y*/*\nin", "c.js": "/*/\nin\n/*/\nout", "d.js": "a/ *\nout"}
    got = chunks.comment_lines(make_files({"p": texts}), 1).select("path", "line").collect()
    assert {tuple(r) for r in got} == {("a.js", 2), ("a.js", 3), ("b.js", 2), ("c.js", 2), ("c.js", 3)}


def test_comment_lines_of_nothing(make_files):
    assert chunks.comment_lines(make_files({"p": {"a.js": "/*\nx"}}).limit(0), 1).collect() == []


def test_effects_are_sequential_reading():
    rng = random.Random(12)
    for automaton in (chunks._MARKS, long_lines._QUOTING):
        for _ in range(300):
            text = _random(rng, [*automaton.symbols, "a", "bb", "é"], 30)
            for start, letter in enumerate(automata._composed(automaton, text)):
                state = start
                for c in text:
                    at = automaton.symbols.find(c)
                    state = automaton.moves[state][at]
                assert ord(letter) - ord("A") == state, (text, start)
    block = "/*a\n" * automata._BLOCK
    assert automata._composed(chunks._MARKS, block) == automata._composed(chunks._MARKS, "/*a\n" * 3)


def test_leads_lead_to_their_states():
    for state, lead in enumerate(long_lines._LEADS):
        assert automata._composed(long_lines._QUOTING, lead)[0] == chr(ord("A") + state)


PIECES = [
    "eval(x)", "eval  (", "exec(a)", "execSync(b)", ".exec(c)", "spawn(", "new \t Function (", "got(u)", "fetch", "(",
    "require(;)", "require( x", "require('x')", "child_process", "process.env", "fs. rm ", "undici", "_", "1",
    "'", '"', "`", "\\", "//", "/", " ", "   ", ";", "{", "}", ",", "<", "]", "é", "😀",
    "https://evil.nightdock.xyz/a.js", "https://github.com/x", "ftp://f.cc/", "http://", "46.17.40.9", "1.2.3.4.5", ".).",
    "\\x68\\x74\\x74\\x70\\x3a\\x2f\\x2f\\x65\\x2e\\x78\\x79\\x2f", "\\x68", "\\u0068\\u0074\\u0074\\u0070\\u003a\\u002f\\u002f\\u0065\\u002e\\u0063\\u0063",
    "String.fromCharCode(104,116,116,112,58,47,47,99,46,99,99, 47)", "aHR0cHM6Ly9kcm9wLm5pZ2h0ZG9jay54eXovcGFyY2Vs",
    "QUJD" * 126, "ghp_abcdefghijklmnopqrstuvwxyz0123456789", 'api_key = "abcdefghij0123456789"', "/*", "*/", "\n", "if (a) return ",
]


def _line_files(make_files, seed, n, most):
    rng = random.Random(seed)
    texts = {f"f{i}.{rng.choice(['js', 'js', 'ts', 'md', 'json'])}": _random(rng, PIECES, most) for i in range(n)}
    return make_files({"p": texts | {"empty.js": "", "null.js": None}, "q": {"f0.js": "  eval(x); " + "y;" * 700}})


@pytest.mark.parametrize("size", [1, 20, 300])
def test_hits_at_any_size(make_files, size):
    files = _line_files(make_files, 13, 250, 40)
    whole = scan.scan_hits(files, SCANNERS)
    parts = scan.scan_hits(files, SCANNERS, longest=size)
    assert parts.dtypes == whole.dtypes
    assert _rows(scan.findings_of(parts)) == _rows(scan.findings_of(whole))
    seen = [ioc.sightings(h).drop("fragment", "nth") for h in (parts, whole)]
    assert _rows(seen[0]) == _rows(seen[1])
    assert _rows(ioc.locations(ioc.sightings(parts))) == _rows(ioc.locations(ioc.sightings(whole)))


def test_one_scanner_and_carried_columns(make_files):
    files = _line_files(make_files, 14, 60, 30).withColumn("part", F.lit(3)).withColumn("tag", F.length("path"))
    for scanner in SCANNERS:
        got = scan.scan_hits(files, (scanner,), carry=("tag",), longest=10)
        assert _rows(got.drop("sighting")) == _rows(scan.scan_hits(files, (scanner,), carry=("tag",)).drop("sighting"))


def test_parts_are_the_line(spark):
    rng = random.Random(15)
    texts = [(i, _random(rng, PIECES, 30).replace("\n", "")) for i in range(100)]
    parts = long_lines.cut(spark.createDataFrame(texts, "id int, text string"), ["id"], 5).collect()
    joined = {}
    for row in sorted(parts, key=lambda r: (r["id"], r["part"])):
        joined[row["id"]] = joined.get(row["id"], "") + row["text"]
    assert joined == {i: t for i, t in texts if t}
    with pytest.raises(ValueError):
        long_lines.cut(spark.createDataFrame(texts, "id int, text string"), ["id"], 0)


def test_giant_line_is_dealt_out(make_files):
    text = "const a = 'eval(x)'; b(\"https://drop.nightdock.xyz/p\");" * 40_000 + "// spawn(z)"
    files = make_files({"p": {"giant.js": text}})
    found = scan.findings_of(scan.scan_hits(files, ("static", "obfuscation"), longest=1 << 16)).collect()
    by_rule = {r["rule_id"]: r for r in found}
    assert by_rule["eval"]["severity"] == by_rule["spawn"]["severity"] == "info"
    assert by_rule["long-line"]["message"].startswith(f"Very long line ({len(text)} chars)")


def test_own_rules_are_not_read_in_parts(make_files):
    from parcelwatch import rules

    own = (rules.LineRule("x", rules.INFO, "x", "a;b"),)
    with pytest.raises(ValueError):
        scan.scan_hits(make_files({"p": {"a.js": "x"}}), ("static",), own, longest=5)
