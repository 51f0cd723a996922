"""Package names within two edits of a popular name.

The similarity join runs as an equi-join on keys that any two names within two edits share, then
checks the distance, so neither side is broadcast by force or compared pairwise.  Short names share
a string left after up to two deletions.  For long popular names (where those strings grow with the
square of the length) the key is one of three pieces: two edits leave a piece intact, moved by at
most two places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.urls import bare_name
from .hits import as_findings

SCANNER = "typosquatting"

_EDITS = rules.TYPO_WARNING
_LONG = 30  # popular names longer than this are matched by pieces


def _deletions(name: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.transform(
        places,
        lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)),
    )


def _deletion_keys(name: Column) -> Column:
    once = _deletions(name)
    twice = F.flatten(F.transform(once, _deletions))
    return F.array_distinct(F.concat(F.array(name), once, twice))


def _piece_bounds(length: Column, piece: Column) -> tuple[Column, Column]:
    """Offset and size of a third of a name."""
    pieces = _EDITS + 1
    start = F.floor(length * piece / pieces)
    return start, F.floor(length * (piece + 1) / pieces) - start


def _piece_key(length: Column, piece: Column, text: Column) -> Column:
    return F.concat_ws("\x01", F.lit(""), length.cast("string"), piece.cast("string"), text)


def _pieces() -> Column:
    return F.array(*[F.lit(k) for k in range(_EDITS + 1)])


def _popular_keys(name: Column) -> Column:
    def piece_key(k: Column) -> Column:
        start, size = _piece_bounds(F.length(name), k)
        return _piece_key(F.length(name), k, F.substr(name, start.cast("int") + 1, size.cast("int")))

    return F.when(F.length(name) <= _LONG, _deletion_keys(name)).otherwise(
        F.transform(_pieces(), piece_key)
    )


def _candidate_keys(name: Column) -> Column:
    size = F.length(name)

    def probes(other: Column) -> Column:
        def at_piece(k: Column) -> Column:
            start, width = _piece_bounds(other, k)
            shifts = F.array(*[F.lit(d) for d in range(-_EDITS, _EDITS + 1)])
            reachable = F.filter(
                shifts, lambda d: (start + d >= 0) & (start + d + width <= size)
            )
            return F.transform(
                reachable,
                lambda d: _piece_key(
                    other, k, F.substr(name, (start + d).cast("int") + 1, width.cast("int"))
                ),
            )

        return F.flatten(F.transform(_pieces(), at_piece))

    lengths = F.sequence(F.greatest(F.lit(_LONG + 1), size - _EDITS), size + _EDITS)
    by_piece = F.when(
        size + _EDITS > _LONG, F.flatten(F.transform(lengths, probes))
    ).otherwise(F.array().cast("array<string>"))
    by_deletion = F.when(size - _EDITS <= _LONG, _deletion_keys(name)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_distinct(F.concat(by_deletion, by_piece))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``(bare, popular_bare, distance)`` within two edits; both inputs have ``bare``."""
    probes = left.select("bare").distinct()
    probes = probes.select("bare", F.explode(_candidate_keys(F.col("bare"))).alias("key"))
    targets = right.select(F.col("bare").alias("popular_bare")).distinct()
    targets = targets.select(
        "popular_bare", F.explode(_popular_keys(F.col("popular_bare"))).alias("key")
    )
    distance = F.levenshtein("bare", "popular_bare", _EDITS)
    return (
        probes.join(targets, "key")
        .select("bare", "popular_bare")
        .distinct()
        .withColumn("distance", distance)
        .filter(F.col("distance") >= 0)
    )


def similar_names(names: DataFrame, popular: DataFrame) -> DataFrame:
    """``names(name)`` against ``popular(name, ord)``: ``name, popular_name, ord, distance``.

    A name that *is* popular (scope and case aside) has no similar names.
    """
    listed = popular.select(
        F.col("name").alias("popular_name"), "ord", bare_name(F.col("name")).alias("popular_bare")
    )
    known = listed.select(F.col("popular_bare").alias("bare"))
    asked = names.select("name").distinct().withColumn("bare", bare_name(F.col("name")))
    unknown = asked.join(known.distinct(), "bare", "left_anti")
    pairs = near_pairs(unknown, known)
    return (
        unknown.join(pairs, "bare")
        .join(listed, "popular_bare")
        .select("name", "popular_name", "ord", "distance")
    )


def scan_typosquatting(releases: DataFrame, popular: DataFrame) -> DataFrame:
    """Findings for ``releases(pkg, version, name)``."""
    near = similar_names(releases, popular)
    distance = F.col("distance")
    return as_findings(
        releases.select("pkg", "version", "name")
        .join(near, "name")
        .select(
            "pkg",
            "version",
            F.lit(SCANNER).alias("scanner"),
            F.when(distance <= rules.TYPO_CRITICAL, rules.CRITICAL)
            .otherwise(rules.WARNING)
            .alias("severity"),
            F.col("popular_name").alias("rule_id"),
            F.concat(
                F.lit('Package name "'), F.col("name"), F.lit('" is '), distance.cast("string"),
                F.lit(' edit(s) from popular package "'), F.col("popular_name"), F.lit('"'),
            ).alias("message"),
            F.concat(F.lit("Levenshtein distance: "), distance.cast("string")).alias("evidence"),
        )
    )


def summarize(names: DataFrame, popular: DataFrame) -> DataFrame:
    """``name, passed, summary`` for every distinct name."""
    asked = names.select("name").distinct().withColumn("bare", bare_name(F.col("name")))
    known = popular.select(bare_name(F.col("name")).alias("bare"), F.lit(True).alias("known"))
    # The list per name is at most the popular names around it.
    entry = F.struct("distance", "ord", "popular_name")
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.concat(
                F.lit('"'), e["popular_name"], F.lit('" (dist '), e["distance"].cast("string"), F.lit(")")
            ),
        ),
        ", ",
    )
    near = similar_names(names, popular).groupBy("name").agg(listed.alias("near"))
    is_known, is_near = F.col("known").isNotNull(), F.col("near").isNotNull()
    listed_any = popular.limit(1).agg(F.count("*")).scalar() > 0
    return (
        asked.join(known.distinct(), "bare", "left")
        .join(near, "name", "left")
        .select(
            "name",
            (~is_near).alias("passed"),
            F.when(~listed_any, "Popular packages list unavailable — skipped")
            .when(
                is_known, F.concat(F.lit('"'), F.col("name"), F.lit('" is a known popular package'))
            )
            .when(is_near, F.concat(F.lit("Similar to: "), F.col("near")))
            .otherwise("No similar popular package names")
            .alias("summary"),
        )
    )
