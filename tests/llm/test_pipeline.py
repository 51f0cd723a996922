"""The pipeline, stage by stage, against plain Python."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcelwatch.llm import common, quality_rules
from tests.llm.test_duplicates import _components, _repeats, _simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.documents(spark, SF), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SF))
        out.append((before.collect(), docs.collect(), docs.columns))
    return out


def test_columns_stay(stages):
    assert all(columns == COLUMNS for _, _, columns in stages[:-1])


def test_rules(spark, stages):
    before, after, _ = stages[0]
    verdicts = quality_rules.measure(common.documents(spark, SF)).collect()
    expected = {r["doc_id"]: r["cleaned"] for r in verdicts if r["kept"]}
    assert {r["doc_id"]: r["text"] for r in after} == expected and 0 < len(after) < len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_exact(stages):
    before, after, _ = stages[1]
    last = {}
    for r in before:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())


def test_near(stages):
    before, after, _ = stages[2]
    before = sorted(before, key=lambda r: r["doc_id"])
    roots = _components([_simhash(r["text"], 3) for r in before], 3)
    assert sorted(r["doc_id"] for r in after) == sorted({before[i]["doc_id"] for i in roots})


def test_repeats(stages):
    before, after, _ = stages[3]
    cut = _repeats([(r["doc_id"], r["text"]) for r in before], 200)
    expected = sorted((eval(c)[0], eval(c)[5]) for c in cut)
    assert sorted((r["doc_id"], r["text"]) for r in after) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_packed(spark, stages):
    before, after, _ = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    found = {}
    for r in after:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == tokens
    run = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, run)) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after)


def test_odd_tables(spark, odd_rows):
    """Null and repeated ids, repeated rows and clashing columns go through; so does nothing."""
    prose = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:7] for i in range(80))
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in odd_rows + [(None, prose), (None, prose), (7, prose), (7, prose)]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, ""))
            assert docs.columns == [*COLUMNS, "row"]
        if some:
            assert [r["doc_id"] for r in docs.collect() if r["text"] == prose] == [7]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert (packed.count() > 0) == bool(some)
