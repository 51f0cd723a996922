import random

import pytest

from parcelwatch.operators.obfuscation import file_entropy
from parcelwatch.plans.scan import scan_obfuscation

ARRAY = "var t=[" + ",".join(f'"word{i}"' for i in range(60)) + "];"
ROTATE = "(function(a){a.push(a.shift())})(t);"
HEX = '"' + r"\x68\x74\x74\x70\x73" + '"'
_shuffler = random.Random(5)


def _spread(n_symbols):
    """Text whose entropy is the logarithm of the number of symbols."""
    symbols = [chr(0x4E00 + i) for i in range(n_symbols)] * 10
    _shuffler.shuffle(symbols)
    return "".join(symbols)


CASES = {
    "plain": "function add(a, b) { return a + b; }\n" * 20,
    "entropy-critical": _spread(128),
    "entropy-warning": _spread(80),
    "entropy-minified": "var x;" + "a" * 3 + "\n" + _spread(200) + " ;",
    "short": _spread(20),
    "hex": "const a = " + HEX,
    "hex-short": r'const a = "\x68\x74\x74"',
    "base64": 'b = "' + "QUJD" * 167 + '"',
    "long": "x" * 1200,
    "exactly-long": "- " * 500,
    "astral-long": "\U0001f600" * 501,
    "minified": "var a=1;" + "b" * 600 + "\n" + HEX,
    "saturated": " ".join(f"_0x{i:04x}" for i in range(30)) + "c" * 600 + " var\n" + HEX,
    "data": ARRAY,
    "rotated-after": ARRAY + ROTATE,
    "rotated-before": ROTATE + ARRAY,
    "rotated-far": ARRAY + " " * 600 + ROTATE,
    "bracket-calls": ARRAY + "t['push'](t['shift']());",
    "fifty": "var t=[" + ",".join('"a"' for _ in range(50)) + "];",
    "first-only": ARRAY + " " * 2000 + ROTATE + ARRAY,
    "mixed-quotes": "var t=[" + ", ".join(["'a]'", '"b\\"["', "`c`"][i % 3] for i in range(55)) + "]",
}


@pytest.fixture(scope="module")
def files(make_files):
    return make_files({k: {"a.js": v} for k, v in CASES.items()})


@pytest.fixture(scope="module")
def found(files, by_package):
    rows = by_package(scan_obfuscation(files))
    return {k: sorted((r["rule_id"], r["severity"]) for r in v) for k, v in rows.items()}


def test_quiet_files(found):
    for pkg in ("plain", "short", "hex-short", "exactly-long", "fifty"):
        assert pkg not in found, pkg


def test_entropy(found, files):
    assert found["entropy-critical"][0] == ("entropy-critical", "critical")
    assert found["entropy-warning"][0] == ("entropy-warning", "warning")
    assert ("entropy-critical", "info") in found["entropy-minified"]
    measured = {r["pkg"]: r["entropy"] for r in file_entropy(files).collect()}
    assert measured["entropy-critical"] == pytest.approx(7.0)
    assert "short" not in measured


def test_encoded_runs(found):
    assert found["hex"] == [("hex-run", "warning")]
    assert found["base64"] == [("base64-run", "warning")]
    assert ("hex-run", "info") in found["minified"]
    assert ("hex-run", "warning") in found["saturated"]


def test_long_lines_count_utf16_units(found):
    assert ("long-line", "info") in found["long"]
    assert found["astral-long"] == [("long-line", "info")]


def test_string_arrays(found):
    assert found["data"] == [("string-array", "info")]
    assert found["mixed-quotes"] == [("string-array", "info")]
    for pkg in ("rotated-after", "rotated-before", "bracket-calls"):
        assert ("string-array", "critical") in found[pkg], pkg
    assert ("string-array", "info") in found["rotated-far"]
    # Only the first large array of a file is judged.
    assert ("string-array", "info") in found["first-only"]


def test_entropy_counts_units_not_points(make_files):
    from math import log2

    text = "a\U0001f600" * 100
    row = file_entropy(make_files({"p": {"a.js": text}})).first()
    share = 100 / 300
    assert row["entropy"] == pytest.approx(-2 * share * log2(share))
