"""Texts too large for one task: cut into chunks that are rows of their own, then put together again.

A chunk is measured where it lies and leaves a summary that does not depend on the cut, so the size of
the chunks changes the work of a task and never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import text as tx
from . import lines
from .automata import Automaton, effect, entries, states_at

#: Code points of a chunk.
CHUNK = 1 << 16

_KEY = ["pkg", "version", "path"]
_COUNTS = T.ArrayType(
    T.StructType([T.StructField("point", T.IntegerType()), T.StructField("n", T.LongType())])
)


def cut(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """``files(pkg, version, path, content)`` to ``..., chunk, content`` of at most ``size`` code points.

    Chunks are numbered from 0, gapless, and joined in order they are the text; an empty text is one
    empty chunk, a null has none.  A text is walked through once.  Rows of one file are dealt to all
    tasks, so a file with a third of all bytes is no task's share.
    """
    if size < 1:
        raise ValueError("a chunk has at least one code point")
    parts = F.when(F.col("content") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    )
    pieces = files.filter("content IS NOT NULL").select(
        *_KEY, F.posexplode(parts).alias("chunk", "content")
    )
    return pieces.repartition(*_KEY, "chunk")


def _counts(text: str) -> list[dict]:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    found, n = np.unique(points, return_counts=True)
    return [{"point": int(p), "n": int(k)} for p, k in zip(found, n)]


@F.pandas_udf(_COUNTS)
def _histogram(texts: pd.Series) -> pd.Series:
    return texts.map(_counts)


def histograms(chunks: DataFrame) -> DataFrame:
    """``pkg, version, path, point, n``: how often each code point occurs in the whole text.

    A chunk leaves at most one row per distinct code point; these are added up in each task and then
    across tasks.
    """
    counted = chunks.select(*_KEY, F.inline(_histogram("content")))
    return counted.groupBy(*_KEY, "point").agg(F.sum("n").alias("n"))


def file_entropy(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """Entropy of every code file of at least 256 UTF-16 units, from chunks: ``pkg, version, path, entropy``.

    Bits per UTF-16 unit, as :func:`obfuscation.file_entropy` gives them for texts that fit a task, up to
    the order of additions.
    """
    code = files.filter(tx.is_code_file(F.col("path"))).select(*_KEY, "content")
    n = F.col("n")
    sums = histograms(cut(code, size)).groupBy(*_KEY).agg(
        F.sum(n).alias("points"),
        F.sum(F.when(F.col("point") >= 0x10000, 2 * n).otherwise(n)).alias("units"),
        F.sum(n * F.log2(n)).alias("weighted"),
    )
    entropy = (F.col("points") * F.log2("units") - F.col("weighted")) / F.col("units")
    return sums.filter(F.col("units") >= rules.ENTROPY_MIN_LENGTH).select(*_KEY, entropy.alias("entropy"))


def _outside(slash: bool, after: bool) -> int:
    return 2 * slash + after


# Reading for comment marks.  States 0 to 3: outside, and whether the last character is a slash and
# whether what precedes it, closed comments left out, ends in one.  4 to 7: in a comment opened on this
# line, without and with a star as last character, either remembering that slash.  8: the line opens a
# comment whatever follows.  9 to 11: the line began inside; no star, a star as last character, closed.
_OPEN, _STAR, _OPENS, _IN, _IN_STAR, _CLOSED = 4, 6, 8, 9, 10, 11
_MARKS = Automaton(
    "/*\n",
    (
        *(
            (
                _outside(True, bool(slash or after)),
                _OPEN + after if slash else _OPENS if after else 0,
                0,
                0,
            )
            for slash in (0, 1)
            for after in (0, 1)
        ),
        *((_OPEN + after, _STAR + after, _IN, _OPEN + after) for after in (0, 1)),
        *((_outside(False, bool(after)), _STAR + after, _IN, _OPEN + after) for after in (0, 1)),
        (_OPENS, _OPENS, _IN, _OPENS),
        (_IN, _IN_STAR, _IN, _IN),
        (_CLOSED, _IN_STAR, _IN, _IN),
        (_CLOSED, _CLOSED, 0, _CLOSED),
    ),
)


def comment_lines(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """Lines that start inside a block comment: ``pkg, version, path, line, text``, from chunks.

    The same rows as :func:`lines.block_comment_lines` at any size.  Files of one chunk are read as they
    are.  Of others every chunk leaves what it does to the state of a reader; these are followed in order,
    and each chunk then marks its own lines.  Only the first and last line of a chunk meet their other
    parts in a shuffle.  A path stands for one file of its release; empty texts and nulls have no rows.
    """
    marked = files.filter(F.col("content").contains("/*"))
    fits = F.octet_length("content") <= size
    short, chunks = marked.filter(fits), cut(marked.filter(~fits), size)

    content, place = F.col("content"), [*_KEY, "chunk"]
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    effects = chunks.select(*place, effect(_MARKS, content).alias("effect"), breaks.alias("n"))
    started = chunks.join(entries(effects, _KEY, "chunk"), place).withColumn(
        "states", states_at(_MARKS, "\n", content, F.col("entry"))
    )
    texts = lines.split_lines(content)
    numbered = started.select(
        *place,
        "before",
        F.length("states").alias("last"),
        F.posexplode(
            # The first part of a chunk goes on with a line, or begins the file outside any comment.
            F.arrays_zip(texts.alias("text"), F.split(F.concat(F.lit("A"), "states"), "").alias("state"))
        ).alias("at", "l"),
    ).select(
        *place,
        (F.col("before") + F.col("at") + 1).cast("int").alias("line"),
        F.col("l.text").alias("text"),
        (F.col("l.state") != "A").alias("inside"),
        ((F.col("at") > 0) & (F.col("at") < F.col("last"))).alias("whole"),
    )
    columns = [*_KEY, "line", "text"]
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    joined = (
        numbered.filter(~F.col("whole"))
        .groupBy(*_KEY, "line")
        .agg(F.bool_or("inside").alias("inside"), parts.alias("parts"))
        .filter("inside")
        .select(*_KEY, "line", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )
    return (
        lines.block_comment_lines(short)
        .select(*columns)
        .union(numbered.filter("whole AND inside").select(*columns))
        .union(joined)
    )
