"""Files to numbered lines, with the block-comment state each line starts in.

A file is one row, so both steps stay inside the row: no shuffle, no sort, and the work is spread
like the files are, however unevenly packages are sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INLINE_COMMENT = r"(?s)/\*.*?\*/"


def split_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def _line_effect(line: Column) -> Column:
    """What a line does to the comment state: 0 nothing, 1 opens, 2 closes, 3 either.

    A line that both closes and opens closes when read inside a comment and opens when read
    outside: text behind the closing mark is not looked at.
    """
    opens = F.when(
        line.contains("/*"), F.regexp_replace(line, _INLINE_COMMENT, "").contains("/*")
    ).otherwise(False)
    return F.concat(
        F.when(opens & line.contains("*/"), "3")
        .when(opens, "1")
        .when(line.contains("*/"), "2")
        .otherwise("0")
    )


def _comment_states(effects: Column) -> Column:
    """One character per line to an array: '1' where the line starts inside a block comment."""
    # Alternating runs: outside up to and including an opener, then inside up to the closer.
    run = F.lit(r"([02]*+[13]?)([01]*+[23]?)")
    states = F.zip_with(
        F.regexp_extract_all(effects, run, 1),
        F.regexp_extract_all(effects, run, 2),
        lambda outside, inside: F.concat(
            F.regexp_replace(outside, ".", "0"), F.regexp_replace(inside, ".", "1")
        ),
    )
    return F.split(F.array_join(states, ""), "")


def explode_lines(
    files: DataFrame, keep: list[str], with_comments: bool = True
) -> DataFrame:
    """``files(content, *keep)`` to one row per line: ``*keep, line, text, in_comment``."""
    # The exploded array is an expression, not a column: from a column Spark would infer a
    # non-empty filter, push it down and split every text twice.
    if not with_comments:
        exploded = files.select(
            *keep, F.posexplode(split_lines(F.col("content"))).alias("_pos", "text")
        )
        inside = F.lit(False)
    else:
        split = files.select(
            *keep,
            split_lines(F.col("content")).alias("text"),
            F.col("content").contains("/*").alias("_commented"),
        ).withColumn(
            "_effects",
            F.when(
                F.col("_commented"), F.array_join(F.transform("text", _line_effect), "")
            ),
        )
        states = F.when(F.col("_commented"), _comment_states(F.col("_effects"))).otherwise(
            F.array().cast("array<string>")
        )
        exploded = split.select(
            *keep, F.posexplode(F.arrays_zip("text", states.alias("state"))).alias("_pos", "_l")
        ).select(*keep, "_pos", "_l.*")
        inside = F.coalesce(F.col("state") == "1", F.lit(False))
    return exploded.select(
        *keep, (F.col("_pos") + 1).alias("line"), "text", inside.alias("in_comment")
    )


def block_comment_lines(files: DataFrame) -> DataFrame:
    """Lines that start inside a block comment."""
    keep = ["pkg", "version", "path"]
    marked = files.filter(F.col("content").contains("/*"))
    return explode_lines(marked, keep).filter("in_comment").drop("in_comment")
