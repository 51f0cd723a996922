"""The small pieces all scanners share: the hit struct and the findings layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..schemas import FINDING_COLUMNS


#: An occurrence of a network indicator, carried by hits of the ioc scanner.  ``fragment`` orders the
#: pieces of a line that were looked at; those of a line read in parts count on from part to part.
SIGHTING = "struct<step: int, method: string, fragment: bigint, type: string, raw: string, nth: int>"


def _col(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def hit(
    scanner: str,
    rule_id: str | Column,
    severity: str | Column,
    message: str | Column,
    line: Column | None = None,
    evidence: str | Column | None = None,
    shows_line: bool = False,
    sighting: Column | None = None,
) -> Column:
    """One hit; ``shows_line`` asks for the line itself as evidence."""
    return F.struct(
        F.lit(scanner).alias("scanner"),
        _col(rule_id).alias("rule_id"),
        _col(severity).alias("severity"),
        _col(message).alias("message"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        (F.lit(None) if evidence is None else _col(evidence)).cast("string").alias("evidence"),
        F.lit(shows_line).alias("shows_line"),
        F.lit(False).alias("quoted"),
        (F.lit(None) if sighting is None else sighting).cast(SIGHTING).alias("sighting"),
    )


def settle(hits: DataFrame, head: Column | None = None) -> DataFrame:
    """Finish exploded hits that still carry their line as ``text``, or its ``head``.

    Matches inside a string literal or comment (``quoted``) drop to info, and the evidence is cut
    from the line here, once per hit instead of once per line looked at.
    """
    quoted = F.col("quoted")
    # The shortened line is a column of its own, so trimming runs once per hit.
    short = F.when(F.col("shows_line"), tx.line_head(F.col("text")) if head is None else head)
    return hits.withColumn("_head", short).withColumns(
        {
            "severity": F.when(quoted, rules.INFO).otherwise(F.col("severity")),
            "message": F.when(
                quoted, F.concat(F.col("message"), F.lit(rules.CONTEXT_SUFFIX))
            ).otherwise(F.col("message")),
            "evidence": F.when(F.col("shows_line"), tx.evidence(F.col("_head"))).otherwise(
                F.col("evidence")
            ),
        }
    )


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def as_findings(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Project to the shared findings layout; absent columns become null, ``carry`` stays."""
    absent = {"file": "string", "line": "int", "evidence": "string"}
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(absent[c]).alias(c)
            for c in FINDING_COLUMNS
        ],
        *carry,
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    first, *rest = [as_findings(f) for f in frames]
    for frame in rest:
        first = first.unionByName(frame)
    return first
