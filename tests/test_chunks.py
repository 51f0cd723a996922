import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import chunks, obfuscation

LONG = "".join(chr(33 + i * i % 90) for i in range(3000))
FILES = {
    "long.js": LONG,
    "lines.js": "let a = 1;\n\r\n" * 90,
    "astral.js": "x😀é" * 130,
    "only-astral.js": "😀" * 128,
    "same.js": "a" * 500,
    "least.js": "ab" * 128,
    "short.js": "ab" * 127,
    "empty.js": "",
    "notes.md": LONG,
}


def _entropies(df):
    return {r["path"]: round(r["entropy"], 9) for r in df.collect()}


@pytest.mark.parametrize("size", [1, 7, 64, 65536])
def test_entropy_at_any_size(make_files, size):
    files = make_files({"p": FILES, "q": {"null.js": None, "long.js": LONG}})
    got = chunks.file_entropy(files, size)
    expected = obfuscation.file_entropy(files)
    key = ["pkg", "path"]
    assert got.count() == 7
    rows = {(r["pkg"], r["path"]): r["entropy"] for r in got.collect()}
    assert rows == pytest.approx({tuple(r[c] for c in key): r["entropy"] for r in expected.collect()}, abs=1e-9)


@pytest.mark.parametrize("size", [1, 7, 65536])
def test_chunks_are_the_text(make_files, size):
    files = make_files({"p": FILES | {"null.js": None}})
    cut = chunks.cut(files, size)
    assert cut.filter(F.length("content") > size).count() == 0
    parts = {}
    for row in sorted(cut.collect(), key=lambda r: (r["path"], r["chunk"])):
        assert row["chunk"] == len(parts.setdefault(row["path"], []))
        parts[row["path"]].append(row["content"])
    assert {path: "".join(texts) for path, texts in parts.items()} == FILES


def test_entropy_of_nothing(make_files):
    assert chunks.file_entropy(make_files({"p": {"a.js": LONG}}).limit(0)).collect() == []


def test_chunk_has_a_size(make_files):
    with pytest.raises(ValueError):
        chunks.cut(make_files({"p": {}}), 0)
