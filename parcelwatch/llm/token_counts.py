"""Token counts of whole texts with a sentence-piece vocabulary, without a shuffle of pre-tokens.

A pre-token is a run of spaces with the text up to the next space.  No piece of the vocabulary
crosses from other text into a space, so counts of pre-tokens add up.  Two tiers answer them: a
table of the corpus's most frequent pre-tokens, of bounded size and sent to every task, and a cache
of bounded size in each task, filled by encoding what the table lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.bpe import batched
from parcelwatch.llm.common import own_columns

_CACHE = 500_000
_COUNTED = 200_000
_LONG = 256
_SPACE = "▁"
_RUNS = re.compile(" +[^ ]*")


def _load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    processor = sentencepiece.SentencePieceProcessor()
    processor.load_from_serialized_proto(model)
    for i in range(processor.get_piece_size()):
        if _SPACE in processor.id_to_piece(i).lstrip(_SPACE):
            raise ValueError("a piece of this vocabulary crosses words")
    return processor


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space (which the encoder adds by itself)."""
    if _SPACE in text:
        text = text.replace(_SPACE, " ")
    if not text:
        return []
    words = text.split(" ")
    if "" in words:  # spaces at an end, or more than one
        words = [run[1:] for run in _RUNS.findall(" " + text)]
    return words


def frequent_pre_tokens(docs: DataFrame, size: int = 16_384, per_task: int = 1024) -> DataFrame:
    """``pre_token, n``: the pre-tokens that lead over all texts, at most ``size`` of them.

    Each task counts all its texts in a bounded table, which sheds its rarest entries when full, and
    passes on ``per_task`` leaders; only those are summed up.  It is a choice of what to keep at
    hand: no result depends on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for texts in batched(batch.column(0).to_pylist()):
                counts.update(chain.from_iterable(map(pre_tokens, texts)))
                if len(counts) > _COUNTED:
                    counts = Counter(dict(counts.most_common(_COUNTED // 8)))
        lead = [(w, n) for w, n in counts.most_common(per_task) if len(w) <= _LONG]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in lead], pa.string()), pa.array([n for _, n in lead], pa.int64())],
            ["pre_token", "n"],
        )

    counted = docs.select("text").mapInArrow(run, "pre_token string, n bigint")
    total = counted.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "pre_token").limit(size)


def count_tokens(
    docs: DataFrame, model_path: str, table_size: int = 16_384, limit: int = 4096,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text.

    A null text counts as empty: no bytes, no tokens.  A null ``doc_id`` and repeated rows are kept;
    other columns are not read.  A long text is counted whole by the task that reads it; an empty table
    gives no rows.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    texts = own_columns(docs, id_col, text_col)
    lead = [r["pre_token"] for r in frequent_pre_tokens(texts, table_size).collect()]
    first = _load(model)
    table = dict(zip(lead, map(len, first.encode(lead, num_threads=1)))) if lead else {}
    table[""] = len(first.encode("a ")) - len(first.encode("a"))  # one space at the end of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _load(model)
        known = dict(table)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for some in batched(batch.column(1).to_pylist()):
                words = list(map(pre_tokens, some))
                missing = list(set(chain.from_iterable(words)).difference(known))
                if len(known) + len(missing) > _CACHE:
                    known = dict(table)
                    missing = list(set(chain.from_iterable(words)).difference(known))
                known.update(zip(missing, map(len, processor.encode(missing, num_threads=1))))
                for text, found in zip(some, words):
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(sum(map(known.__getitem__, found)))
                for word in missing:
                    if len(word) > _LONG:
                        del known[word]
            counts = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            over = pa.array([n > limit for n in n_tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return texts.mapInArrow(run, schema)
