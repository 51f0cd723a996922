"""BPE, packing and token counts against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from parcelwatch.llm import bpe, packing, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return bpe.loaded(BYTE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_character(encoder, library):
    points = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000)]
    texts = [f"a{c} {c}b 1{c}{c}  {c}'s" for c in points]
    for found, expected in zip(encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert found.tolist() == expected.ids


def test_endings_blanks_and_specials(encoder, library):
    rng = np.random.default_rng(1)
    parts = list(" \n\t,.'\"aB1é漢🙂") + ["'s", "'ll", "'re", "'d", "  ", "　", "\x1c", "\x85", "<|endoftext|>", "<|end", "x" * 80]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(6000)]
    for text, found in zip(texts, encoder.encode(texts)):
        assert found.tolist() == _ids(library, text), repr(text)
        assert encoder.decode(found.tolist()) == text


def test_words_of_every_length(encoder, library):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("etaoins"), n)) for n in range(1, 140) for _ in range(4)] + ["e" * 3000]
    assert [f.tolist() for f in encoder.encode(texts)] == [_ids(library, t) for t in texts]


def test_long_texts_are_cut_between_words(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "_CUT", 50)
    text = "some words, it's  here\n and 'there' " * 40
    assert len(list(encoder._blocks(text))) > 5
    assert encoder.encode([text])[0].tolist() == _ids(library, text)


def test_a_full_cache_starts_again(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 5)
    texts = [f"word{i} number{i * 7}" for i in range(40)]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == _ids(library, text)


def test_kinds_follow_the_pattern(encoder):
    assert encoder.kinds[ord("é")] == 1 and encoder.kinds[ord("7")] == 2 and encoder.kinds[0x3000] == 3
    assert regex.fullmatch(r"\p{L}", "é")


def test_round_trip_of_a_table(odd, odd_rows, library, outcome):
    found = outcome(bpe.encode_documents(odd, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    expected = []
    for i, text in odd_rows:
        ids, sha = _ids(library, text), lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append(repr((i, len(ids), sha(",".join(map(str, ids))), text or "", sha(text or ""))))
    assert found == sorted(expected)


def _check_packs(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc, pieces in by_doc.items():
        ids = ids_of[doc]
        copies = sum(p["start"] == 0 for p in pieces)
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert (zlib.crc32(part), len(ids)) == (p["ids_crc32"], p["doc_tokens"])
    return len(by_sequence)


def test_packing(odd, odd_rows, library):
    named = [(i, t) for i, t in odd_rows if i is not None]
    ids = {i: _ids(library, t) + [0] for i, t in named}
    for capacity in (1024, 64):
        rows = packing.pack_documents(odd.where("doc_id IS NOT NULL"), BYTE, capacity).collect()
        used = _check_packs(rows, ids, capacity)
        total = sum(len(ids[i]) for i, _ in named)
        assert used <= 1.1 * total / capacity + 2


def test_packing_keeps_null_ids_and_ids_of_tokens(odd, odd_rows, library):
    rows = packing.pack_documents(odd, BYTE, 256, keep_ids=True).where("doc_id IS NULL").collect()
    total = sum(len(_ids(library, t)) + 1 for i, t in odd_rows if i is None)
    assert sum(r["length"] for r in rows) == total == sum(len(r["ids"]) for r in rows)


@pytest.mark.parametrize("counts", [{1: 5000}, {512: 7}, {1024: 3, 700: 5, 300: 9, 1: 2}, {341: 10, 342: 10}, {}])
def test_patterns_hold_every_length_once(counts):
    patterns = packing.pack_histogram(dict(counts), 1024)
    held = {}
    for lengths, number in patterns:
        assert number > 0 and sum(lengths) <= 1024
        for length in lengths:
            held[length] = held.get(length, 0) + number
    assert held == counts


def test_patterns_stay_few_and_full():
    rng = np.random.default_rng(3)
    counts = {n: int(c) for n, c in enumerate(rng.integers(1, 100_000, 1024), 1)}
    patterns = packing.pack_histogram(dict(counts), 1024)
    tokens = sum(n * c for n, c in counts.items())
    assert sum(n for _, n in patterns) <= 1.01 * tokens / 1024 + 1
    assert len(packing.pattern_slots(patterns)) < 10_000


def test_token_counts(odd, odd_rows, outcome):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    expected = []
    for i, text in odd_rows:
        n = len(model.encode(text or ""))
        expected.append(repr((i, len((text or "").encode()), n, n > 100)))
    for size in (0, 3, 16384):
        found = token_counts.count_tokens(odd, PIECE, table_size=size, limit=100)
        assert outcome(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected)


def test_pre_tokens_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = np.random.default_rng(4)
    parts = list(" \n\tab▁é漢🙂.\0") + ["  ", "   ", "<s>", "</s>", "<unk>", "the", "▁▁"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 15)))
        found = token_counts.pre_tokens(text)
        assert sum(map(len, model.encode(found))) + found.count("") == len(model.encode(text)), repr(text)


def test_a_full_word_cache_starts_again(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(token_counts, "_CACHE", 4)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = token_counts.count_tokens(odd, PIECE, table_size=2).selectExpr("sum(n_tokens)").first()[0]
    assert found == sum(len(model.encode(t or "")) for _, t in odd_rows)


def test_empty_tables(none):
    assert bpe.encode_documents(none, BYTE).count() == 0
    assert packing.pack_documents(none, BYTE).count() == 0
    assert token_counts.count_tokens(none, PIECE).count() == 0
