"""Set-wise operators against plain sequential readings of the same rules, on random input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parcelwatch import rules
from parcelwatch.functions import decode
from parcelwatch.functions import text as tx
from parcelwatch.operators.lines import explode_lines
from parcelwatch.operators.obfuscation import classify_arrays


def random_text(rng, pieces, most):
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, most)))


def test_comment_states(make_files):
    rng = random.Random(1)
    pieces = ["/*", "*/", "a", " ", "\n", "\n", "/", "*"]
    texts = {f"f{i}.js": random_text(rng, pieces, 40) for i in range(400)}

    def states(text):
        inside = False
        for line in text.split("\n"):
            yield inside
            if inside:
                inside = "*/" not in line
            else:
                inside = "/*" in re.sub(r"/\*.*?\*/", "", line)

    expected = {(p, i): s for p, t in texts.items() for i, s in enumerate(states(t), 1)}
    rows = explode_lines(make_files({"p": texts}), ["path"]).collect()
    assert {(r["path"], r["line"]): r["in_comment"] for r in rows} == expected


def test_code_prefix(spark):
    rng = random.Random(2)
    pieces = ["'", '"', "`", "\\", "/", "//", "a", " ", "(", "\U0001f600", "é"]
    prefixes = sorted({random_text(rng, pieces, 12) for _ in range(3000)})

    def outside(text):
        mark, i = None, 0
        while i < len(text):
            if mark is None:
                if text.startswith("//", i):
                    return True
                mark = text[i] if text[i] in "'\"`" else None
            elif text[i] == "\\":
                i += 1
            elif text[i] == mark:
                mark = None
            i += 1
        return mark is not None

    frame = spark.createDataFrame([(p,) for p in prefixes], "text string")
    rows = frame.select("text", F.col("text").rlike(rules.CODE_PREFIX).alias("clean")).collect()
    assert [r["text"] for r in rows if r["clean"] == outside(r["text"])] == []


def test_code_prefix_takes_long_lines(spark):
    long_lines = ["x" * 200_000, "'a'," * 100_000, "a/b" * 100_000, "'" + "\\'" * 100_000]
    frame = spark.createDataFrame([(p,) for p in long_lines], "text string")
    rows = frame.select(F.col("text").rlike(rules.CODE_PREFIX)).collect()
    assert [r[0] for r in rows] == [True, True, True, False]


def first_array(text):
    """Position of the first bracket followed by 51 string literals, and of what follows them."""
    for at in (i for i, c in enumerate(text) if c == "["):
        n, j = 0, at + 1
        while n < 51:
            while j < len(text) and text[j].isspace():
                j += 1
            if j >= len(text) or text[j] not in "'\"`":
                break
            end = j + 1
            while end < len(text) and text[end] != text[j]:
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                break
            n, j = n + 1, end + 1
            while j < len(text) and (text[j].isspace() or text[j] == ","):
                j += 1
        if n == 51:
            return at, j
    return None


def array_kind(text):
    found = first_array(text)
    if found is None:
        return None
    windows = text[found[1] : found[1] + 500], text[max(0, found[0] - 1000) : found[0]]
    pairs = [(r"\[\s*'push'\s*\]", r"\[\s*'shift'\s*\]"), (r"\.\s*push\s*\(", r"\.\s*shift\s*\(")]
    rotated = any(re.search(a, w) and re.search(b, w) for w in windows for a, b in pairs)
    return "rotated" if rotated else "data"


def test_string_arrays(spark):
    rng = random.Random(3)
    literals = ["'a'", '"b"', "`c`", "'\\''", '"["', "'x]'"]
    glue = [",", ", ", " ", ",\n", ""]
    extras = ["a.push(a.shift())", "t['push'](t['shift']())", ".push(", ".shift(", "[", "]", "'", "[" * 3, "x;"]

    def array():
        n = rng.choice([49, 50, 51, 52, 60, 5])
        return "[" + "".join(rng.choice(literals) + rng.choice(glue) for _ in range(n)) + rng.choice(["]", ""])

    def filler():
        return rng.choice(["", rng.choice(extras), " " * rng.choice([480, 499, 500, 990, 1000, 1001])])

    texts = sorted(
        {"".join(filler() + rng.choice([array(), "", rng.choice(extras)]) + filler() for _ in range(rng.randint(1, 4)))
         for _ in range(500)}
    )
    frame = spark.createDataFrame([(t,) for t in texts], "content string")
    rows = classify_arrays(frame).collect()
    wrong = [r["content"] for r in rows if r["array_kind"] != array_kind(r["content"])]
    assert wrong == []
    assert {array_kind(t) for t in texts} == {None, "data", "rotated"}


def test_array_of_many_strings(spark):
    frame = spark.createDataFrame([("[" + '"a",' * 50_000 + "]",), ("['" * 20_000,)], "content string")
    assert [r["array_kind"] for r in classify_arrays(frame).collect()] == ["data", None]


def test_utf16_helpers(spark):
    rng = random.Random(4)
    texts = sorted({random_text(rng, ["a", "é", "\U0001f600", "漢"], 12) for _ in range(400)})

    def units(text):
        return text.encode("utf-16-be")

    def whole(raw):
        return raw.decode("utf-16-be", "ignore")

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = frame.select("t", tx.utf16_length(t), tx.utf16_left(t, 5), tx.utf16_right(t, 5)).collect()
    for text, length, left, right in rows:
        raw = units(text)
        assert length == len(raw) // 2
        assert left == whole(raw[:10]), text
        tail = raw[-10:]
        if len(tail) >= 2 and 0xDC <= tail[0] <= 0xDF:
            tail = tail[2:]
        assert right == whole(tail), text


def test_surrogates(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(300):
        values = [rng.choice([0xD83D, 0xDE00, 0x41, 0xD800, 0xDFFF, 0xE000]) for _ in range(rng.randint(1, 8))]
        raw = b"".join(v.to_bytes(2, "big") for v in values)
        text = raw.decode("utf-16-be", "surrogatepass")
        cases.append((raw.hex(), re.sub("[\ud800-\udfff]", "�", text)))
    frame = spark.createDataFrame(cases, "h string, expected string")
    rows = frame.select("h", "expected", decode.from_utf16_hex(F.col("h")).alias("got")).collect()
    assert [r["h"] for r in rows if r["got"] != r["expected"]] == []


@pytest.mark.parametrize("path, code", [
    ("a.js", True), ("a.tsx", False), ("a.test.mjs", False), ("test.js", True), ("x/tests/a.js", False),
    ("x\\test\\a.js", False), ("a.spec.ts", False), ("a.cjs", True), (".js", False), ("a.d.cts", False),
])
def test_code_files(spark, path, code):
    assert spark.createDataFrame([(path,)], "p string").select(tx.is_code_file(F.col("p"))).first()[0] is code


def test_awkward_lines_stay_cheap(spark, make_files):
    """Long runs that a careless pattern would try again at every position."""
    from parcelwatch.plans.scan import scan_contents, scan_ioc

    n = 300_000
    texts = {
        "blanks.js": "eval(x)" + " " * n + "eval(y)",
        "letters.js": "a" * n + "://" + "b" * n,
        "dots.js": "http://" + "." * n + "x",
        "runs.js": ("Q" * 499 + " ") * 600,
        "quotes.js": "['" * n,
        "comments.js": "/* a */" * (n // 7) + "\n" + "*/ /*\n" * 20_000,
        "escapes.js": "\\x4" * n,
        "digits.js": "1.1." * n,
    }
    files = make_files({"p": texts})
    rows = scan_contents(files).groupBy("file").count().collect()
    assert {r["file"] for r in rows} >= {"blanks.js", "letters.js", "dots.js"}
    assert scan_ioc(files).count() > 0
