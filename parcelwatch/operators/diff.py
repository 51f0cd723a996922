"""Published files against the repository they claim to come from.

Published files, source files and what compiled sources would produce meet in one grouping by path,
on hashes instead of contents, so the comparison is a single shuffle of short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx

_PATH_KEY = ["pkg", "version", "path"]


def is_compared(path: Column) -> Column:
    """Outside hidden and vendored directories; hidden files themselves count."""
    return ~path.rlike(r"(?:\A|/)(?:\.[^/]*|node_modules)/")


def fingerprints(files: DataFrame, single_root: bool = False) -> DataFrame:
    """``pkg, version, path, sha256`` of the files that take part.

    ``single_root`` drops the one top directory that source archives come in.  Files that come with
    a ``sha256`` of their bytes keep it: decoded text is lossy for binaries.  Other contents are
    hashed where they are read and go no further.
    """
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    hashed = files.select(
        "pkg", "version", path.alias("path"), digest.alias("sha256")
    )
    if single_root:
        hashed = strip_single_root(hashed)
    return hashed.filter(is_compared(F.col("path")))


def strip_single_root(files: DataFrame) -> DataFrame:
    """Drop the one top directory of a source archive; several tops are left as they are.

    Files beside a single top directory are no part of the source.

    Give it paths or fingerprints, not contents: rows are shuffled.
    """
    path = F.col("path")
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1))
    roots = files.groupBy("pkg", "version").agg(F.min(top).alias("_a"), F.max(top).alias("_b"))
    single = roots.filter(F.col("_a") == F.col("_b")).select(
        "pkg", "version", F.col("_a").alias("_root")
    )
    root = F.col("_root")
    return (
        files.join(single, ["pkg", "version"], "left")
        .filter(root.isNull() | path.startswith(F.concat(root, F.lit("/"))))
        .withColumn(
            "path", F.when(root.isNull(), path).otherwise(F.substr(path, F.length(root) + 2))
        )
        .drop("_root")
    )


def _compiled_paths(path: Column) -> Column:
    """Published paths a TypeScript source accounts for."""
    base = F.regexp_extract(path, r"(?s)\A(.*)\.(?:ts|tsx|mts|cts)\z", 1)
    bases = F.when(
        path.rlike(r"\Asrc/.*\.tsx?\z"), F.array(base, F.substr(base, F.lit(5)))
    ).otherwise(F.array(base))
    return F.flatten(
        F.transform(
            bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in (".js", ".mjs", ".cjs")])
        )
    )


def _is_build_file(path: Column) -> Column:
    return (
        tx.any_of([path.startswith(p) for p in rules.BUILD_PREFIXES])
        | tx.any_of([path.endswith(s) for s in rules.GENERATED_SUFFIXES])
        | tx.basename(path).isin(*rules.GENERATED_NAMES)
    )


def _number(sha256: Column) -> Column:
    """The first 120 bits of a hash as one number.

    One value, so that the rows of a path listed twice never mix; a number, as the maximum of a text
    cannot be hash-aggregated and would sort.
    """
    high, low = (F.conv(F.substring(sha256, i, 15), 16, 10).cast("decimal(19,0)") for i in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def match(published: DataFrame, source: DataFrame) -> DataFrame:
    """``pkg, version, path, ours, theirs, class`` of all paths on either side.

    Both inputs are :func:`fingerprints`; ``ours`` and ``theirs`` tell which side has the path.
    ``class`` is ``same``, ``modified``, ``expected_build`` or ``unexpected`` for published files
    and null for paths only the source has.
    """
    none = F.lit(None).cast("decimal(38,0)")
    number = _number(F.col("sha256"))
    ours = published.select(
        *_PATH_KEY, number.alias("ours_hash"), none.alias("theirs_hash"), F.lit(False).alias("twin")
    )
    # A source file and the files it compiles to leave one read together.
    path = F.col("path")
    compiles = path.rlike(r"\.(?:tsx?|mts|cts)\z")
    own = F.struct(path.alias("path"), number.alias("theirs_hash"), F.lit(False).alias("twin"))
    twins = F.transform(
        _compiled_paths(path),
        lambda p: F.struct(p.alias("path"), none.alias("theirs_hash"), F.lit(True).alias("twin")),
    )
    every = F.when(compiles, F.concat(F.array(own), twins)).otherwise(F.array(own))
    theirs = source.select("pkg", "version", F.inline(every)).select(
        *_PATH_KEY, none.alias("ours_hash"), "theirs_hash", "twin"
    )
    met = (
        ours.unionByName(theirs)
        .groupBy(*_PATH_KEY)
        .agg(*[F.max(c).alias(c) for c in ("ours_hash", "theirs_hash", "twin")])
        .withColumns(
            {
                "ours": F.col("ours_hash").isNotNull(),
                "theirs": F.col("theirs_hash").isNotNull(),
                "equal": F.col("ours_hash") == F.col("theirs_hash"),
            }
        )
    )
    path, theirs = F.col("path"), F.col("theirs")
    exempt = path.isin(*rules.CONTENT_EXEMPT)
    return met.select(
        *_PATH_KEY,
        "ours",
        "theirs",
        F.when(~F.col("ours"), None)
        .when(theirs & (exempt | F.col("equal")), "same")
        .when(theirs, "modified")
        .when(_is_build_file(path) | F.col("twin"), "expected_build")
        .otherwise("unexpected")
        .alias("class"),
    )


def classes(matched: DataFrame) -> DataFrame:
    """The published files that differ from the source in some way.

    Releases without a source were not compared and list nothing.
    """
    compared = matched.filter("theirs").select("pkg", "version").distinct()
    differing = matched.filter(F.col("class") != "same").select(*_PATH_KEY, "class")
    return differing.join(compared, ["pkg", "version"], "left_semi")


def rollup(matched: DataFrame) -> DataFrame:
    """Counts per published release; ``performed`` is false where there is no source to compare."""
    cls = F.col("class")
    return (
        matched.groupBy("pkg", "version")
        .agg(
            F.max("theirs").alias("performed"),
            F.max("ours").alias("_published"),
            F.count_if(cls == "unexpected").alias("n_unexpected"),
            F.count_if(cls == "expected_build").alias("n_expected_build"),
            F.count_if(cls == "modified").alias("n_modified"),
        )
        .filter("_published")
        .drop("_published")
    )


def score_rollup(rolled: DataFrame) -> DataFrame:
    """Add ``diff_points``; a comparison that did not take place earns none."""
    points = F.when(F.col("performed"), diff_points(F.col("n_unexpected"))).otherwise(0.0)
    return rolled.withColumn("diff_points", points)


def diff_points(n_unexpected: Column) -> Column:
    """Points of a comparison that took place."""
    lost = F.least(F.lit(rules.DIFF_CAP), rules.DIFF_BASE * (1 + F.ln(n_unexpected)))
    return F.when(n_unexpected > 0, F.greatest(F.lit(0.0), rules.DIFF_POINTS - lost)).otherwise(
        rules.DIFF_POINTS
    )
