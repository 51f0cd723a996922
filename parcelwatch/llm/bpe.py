"""Byte-level BPE: texts to ids and back.

Pre-tokens are merged in contiguous arrays: one row per short word holds its parts, another the
ranks of adjacent parts.  Every step scans each row for its minimum (the leftmost one on ties),
writes the merged part, deletes the boundary behind it and refreshes the two neighbouring ranks.
All words of a batch take their steps together, so a step is a few array operations.  Words above
``SHORT`` bytes, for which scanning again and again would be quadratic, use a heap over a linked
list and give the same parts.

A batch is cut into words by the kinds of its characters, as the pattern of the vocabulary
``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks`` would cut it.  Each distinct word is
merged once per task; the cache is of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from parcelwatch.llm.common import own_columns

SHORT = 64
_WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, SHORT)
_ROWS = 8192
_CACHE = 500_000
# The endings of the pattern.
_ENDINGS = ((1, "s"), (1, "t"), (2, "re"), (2, "ve"), (1, "m"), (2, "ll"), (1, "d"))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CUT = 1 << 20
_NEVER = np.int32(2**31 - 1)
_SLOT_BITS, _SPREAD, _MASK = 20, 0x2545F4914F6CDD1D, (1 << 63) - 1


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kinds(library: Tokenizer) -> np.ndarray:
    """1 for letters, 2 for numbers, 3 for white space, 0 for the rest, by code point.

    Versions of Unicode differ in characters that are new: where the two at hand disagree, the
    library that reads the vocabulary is asked.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, table = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    index = np.array(points)
    for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(name, every):
            table[index[m.start() : m.end()]] = kind
    known = {"L": 1, "N": 2}
    for c in points:
        kind = known.get(unicodedata.category(chr(c))[0], 0)
        if kind != table[c] and table[c] != 3:
            # With another of its kind a character makes one word.
            words = (library.pre_tokenizer.pre_tokenize_str(other + chr(c)) for other in "!a1")
            table[c] = next((k for k, found in enumerate(words) if len(found) == 1), 3)
    return table


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` with ``count`` numbers each, one after the other."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)


class ByteBpe:
    """Vocabulary and merges of a ``tokenizers`` file; encodes with a cache of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.kinds = _kinds(Tokenizer.from_file(path))
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in chars.items():
            self.byte_ids[byte] = vocab[char]

    def __getstate__(self) -> dict:
        left_out = ("by_pair", "special", "slots", "slot_ranks", "known")
        return {k: v for k, v in vars(self).items() if k not in left_out}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.special = self._special()
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.slot_ranks = np.full(1 << _SLOT_BITS, _NEVER, np.int32)
        at = self._slot(self.keys)
        self.slots[at], self.slot_ranks[at] = self.keys, self.ranks
        self._forget()

    def _forget(self) -> None:
        """Start an empty cache: hashes in order, words in full, and where their ids are."""
        self.known = (np.zeros(0, np.uint64), np.zeros((0, 4), np.uint64), np.zeros(0, np.int64),
                      np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _special(self) -> re.Pattern | None:
        names = sorted(self.added, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, names))) if names else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) & _MASK) >> (63 - _SLOT_BITS)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        held, ranks = self.slots[at], self.slot_ranks[at]
        other = np.flatnonzero(held != key)
        ranks[other] = _NEVER
        # A slot that another pair holds does not tell; those few are searched for.
        other = other[held[other] >= 0]
        if len(other):
            wanted = key[other]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ranks[other] = np.where(self.keys[at] == wanted, self.ranks[at], _NEVER)
        return ranks

    def _merge_rows(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``size.max()`` bytes, one after the other, and their numbers.

        ``raw`` has the bytes of all words, ``size`` the length of each.
        """
        n, width = len(size), int(size.max())
        column = np.arange(width, dtype=np.int32)
        parts = np.full((n, width), -1, np.int32)
        parts[column < size[:, None]] = self.byte_ids[raw]
        ranks = np.full((n, width), _NEVER, np.int32)
        pair = column[1:] < size[:, None]
        ranks[:, :-1][pair] = self._rank(parts[:, :-1][pair], parts[:, 1:][pair])
        final, count = np.empty((n, width), np.int32), size.copy()
        row, size = np.arange(n), size.astype(np.int32)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            done = best == _NEVER
            if done.any():
                final[row[done], : parts.shape[1]] = parts[done]
                count[row[done]] = size[done]
                left = ~done
                row, parts, ranks, size = row[left], parts[left], ranks[left], size[left]
                at, best, here = at[left], best[left], np.arange(len(row))
                if not len(row):
                    break
            parts[here, at] = self.merged[best]
            # Delete the boundary: rows lose one part and one rank.
            shape = (len(row), parts.shape[1] - 1)
            keep = np.ones(parts.shape, bool)
            keep[here, at + 1] = False
            parts = parts[keep].reshape(shape)
            keep[here, at + 1] = True
            keep[here, at] = False
            ranks = ranks[keep].reshape(shape)
            size -= 1
            after = np.flatnonzero(at + 1 < size)
            k = at[after]
            ranks[after, k] = self._rank(parts[after, k], parts[after, k + 1])
            before = np.flatnonzero(at > 0)
            k = at[before] - 1
            ranks[before, k] = self._rank(parts[before, k], parts[before, k + 1])
        return final[column < count[:, None]], count

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        if not hasattr(self, "by_pair"):
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        ids = self.byte_ids[word].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.by_pair.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([i for i in ids if i >= 0], np.int32)

    def _merge(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple:
        """Ids of all words, one after the other, and the number of ids of each word."""
        count = np.empty(len(begin), np.int64)
        found = []
        for low, width in zip((0, *_WIDTHS), _WIDTHS):
            rows = np.flatnonzero((length > low) & (length <= width))
            for at in range(0, len(rows), _ROWS):
                some = rows[at : at + _ROWS]
                ids, count[some] = self._merge_rows(raw[_ranges(begin[some], length[some])], length[some])
                found.append((some, ids))
        for i in np.flatnonzero(length > SHORT).tolist():
            ids = self._merge_long(raw[begin[i] : begin[i] + length[i]])
            count[i] = len(ids)
            found.append((np.array([i]), ids))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, ids in found:
            out[_ranges(start[rows], count[rows])] = ids
        return out, count

    def _starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the pattern starts a new word; ``begins`` are the first points of the segments."""
        n = len(points)
        kind = self.kinds[points]
        first = np.zeros(n + 3, bool)
        first[begins] = True
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last blank of a run before a word is on its own, or leads the word if it is a space.
        turn = np.flatnonzero((kind[1:] != 3) & (kind[:-1] == 3) & ~first[1:n])
        start[turn] = True
        start[turn[points[turn] == 32] + 1] = False
        # A lone apostrophe takes an ending; after a space it doesn't.
        quote = np.flatnonzero(points == 39)
        if len(quote):
            quote = quote[start[quote]]
            padded = np.concatenate((points, np.zeros(3, points.dtype)))
            one, two = padded[quote + 1], padded[quote + 2]
            here = ~first[quote + 1]
            for length, ending in _ENDINGS:
                hit = here & (one == ord(ending[0]))
                if length == 2:
                    hit &= (two == ord(ending[1])) & ~first[quote + 2]
                at = quote[hit]
                start[at + 1] = False
                behind = at + 1 + length
                start[behind[behind < n]] = True
        return np.flatnonzero(start)

    def _lookup(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple:
        """For words of at most 32 bytes: where their ids start in the cache, and how many.

        ``raw`` has the bytes of all words, with 32 spare ones at the end.  Words are found by
        hash and compared in full; the same hash for two words would only cost the cache.
        """
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        full, hashed = np.zeros((len(start), 4), np.uint64), size.astype(np.uint64)
        for i in range(4):
            rows = np.flatnonzero(size > 8 * i) if i else slice(None)
            part = eight[start[rows] + 8 * i]
            unused = 64 - 8 * np.minimum(size[rows] - 8 * i, 8)
            part = part << unused.astype(np.uint64) >> unused.astype(np.uint64)
            full[rows, i] = part
            mixed = (hashed[rows] ^ part) * _MIX
            hashed[rows] = mixed ^ mixed >> np.uint64(29)
        unique, one, which = np.unique(hashed, return_index=True, return_inverse=True)
        if not np.array_equal(full[one][which], full):
            return self._fresh(raw, start, size)
        if len(self.known[0]) > _CACHE:
            self._forget()
        hashes, words, begin, count, ids = self.known
        at = np.minimum(np.searchsorted(hashes, unique), max(len(hashes) - 1, 0))
        old = hashes[at] == unique if len(hashes) else np.zeros(len(unique), bool)
        if not np.array_equal(words[at[old]], full[one[old]]):
            return self._fresh(raw, start, size)
        new = one[~old]
        if len(new):
            fresh, more = self._merge(raw, start[new], size[new])
            begins = len(ids) + np.cumsum(more) - more
            hashes = np.concatenate((hashes, hashed[new]))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            words = np.concatenate((words, full[new]))[order]
            begin = np.concatenate((begin, begins))[order]
            count = np.concatenate((count, more))[order]
            self.known = hashes, words, begin, count, np.concatenate((ids, fresh))
            at = np.searchsorted(hashes, unique)
        place = at[which]
        return self.known[4], self.known[2][place], self.known[3][place]

    def _fresh(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple:
        ids, count = self._merge(raw, start, size)
        return ids, np.cumsum(count) - count, count

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, and where each segment's ids end."""
        text = "".join(segments)
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(length)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(segments), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        start = self._starts(points, (ends - length)[length > 0])
        words_end = np.searchsorted(start, ends)
        raw = text.encode()
        if len(raw) > len(points):
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            start = (np.cumsum(width) - width)[start]
        size = np.diff(np.append(start, len(raw)))
        raw = np.frombuffer(raw + bytes(40), np.uint8)
        count, parts = np.zeros(len(start), np.int64), []
        short = size <= 32
        for rows, find in ((np.flatnonzero(short), self._lookup), (np.flatnonzero(~short), self._fresh)):
            if len(rows):
                ids, begin, count[rows] = find(raw, start[rows], size[rows])
                parts.append((rows, ids, begin))
        token_end = np.cumsum(count)
        if len(parts) == 1:
            ids = parts[0][1][_ranges(parts[0][2], count)]
        else:
            ids = np.empty(token_end[-1], np.int32)
            for rows, found, begin in parts:
                to = _ranges(token_end[rows] - count[rows], count[rows])
                ids[to] = found[_ranges(begin, count[rows])]
        return ids, np.append(0, token_end)[words_end]

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts of a long text; each but the first starts with a space behind a word."""
        start = 0
        while len(text) - start > _CUT:
            end = text.find(" ", start + _CUT // 2)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[start:end]
            start = end
        yield text[start:] if start else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids, as unsigned little-endian 32-bit numbers."""
        segments, last, inserted = [], [], {}
        for text in texts:
            if self.special and any(name in text for name in self.added):
                at = 0
                for m in self.special.finditer(text):
                    segments += self._blocks(text[at : m.start()])
                    inserted[len(segments)] = self.added[m[0]]
                    segments.append("")
                    at = m.end()
                text = text[at:]
            segments += self._blocks(text)
            last.append(len(segments))
        ids, ends = self._segments(segments)
        ids = ids.astype("<u4")
        if inserted:
            at = ends[np.array(list(inserted))]
            ids = np.insert(ids, at, list(inserted.values()))
            more = np.zeros(len(segments), np.int64)
            more[list(inserted)] = 1
            ends = ends + np.cumsum(more)
        bounds = ends[np.array(last, np.int64) - 1].tolist()
        return [ids[a:b] for a, b in zip([0, *bounds], bounds)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def loaded(path: str) -> ByteBpe:
    bpe = ByteBpe(path)
    bpe.__setstate__(bpe.__getstate__())
    return bpe


def batched(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """Consecutive runs of texts with about ``most`` characters, so that working memory is bounded."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256`` of every text.

    ``ids`` is an array, ``decoded`` the text the ids give back; both are left out with
    ``keep_ids=False``, so that only digests leave the workers.  A null text counts as empty and
    has no ids; a null ``doc_id`` and repeated rows are kept as they are; other columns are not
    read.  Strings of special tokens inside a text become those tokens.  Long texts are encoded in
    parts cut between words; an empty table gives no rows.
    """
    bpe = loaded(vocabulary)
    fields = [("doc_id", docs.schema[id_col].dataType.simpleString()), ("n_tokens", "bigint")]
    fields += [("ids", "array<int>"), ("decoded", "string")] if keep_ids else []
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(map(str, range(len(bpe.token_bytes))))
        for batch in batches:
            ids, out = batch.column(0), {name: [] for name, _ in fields[1:]}
            for texts in batched(batch.column(1).to_pylist()):
                for found in bpe.encode(texts):
                    numbers = found.tolist()
                    decoded = bpe.decode(numbers)
                    out["n_tokens"].append(len(numbers))
                    listed = ",".join(map(names.__getitem__, numbers))
                    out["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        out["ids"].append(numbers)
                        out["decoded"].append(decoded)
            kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            columns = [pa.array(out[name], kinds[kind]) for name, kind in fields[1:]]
            yield pa.RecordBatch.from_arrays([ids, *columns], [name for name, _ in fields])

    schema = ", ".join(f"{name} {kind}" for name, kind in fields)
    return own_columns(docs, id_col, text_col).mapInArrow(run, schema)
