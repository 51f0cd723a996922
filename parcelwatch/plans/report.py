"""The report: a JSON header per release, and a JSON object per scanner and file.

The layout does not depend on how much was found.  A release has one ``header`` (package, scanner
summaries, repository, comparison, score); the findings of one scanner in one file are one object, as large as
that file's findings; every file that differs from the source is one.  ``section`` and ``key`` name an object
for good, so that two reports can be joined, and no task assembles a whole release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import FINDING_COLUMNS

_KEY = ["pkg", "version"]
HEADER, DIFF = "header", "diff"
_FINDING = ("line", "severity", "rule_id", "message", "evidence")


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def headers(
    results: DataFrame,
    scores: DataFrame,
    metadata: DataFrame | None = None,
    repositories: DataFrame | None = None,
    compared: DataFrame | None = None,
) -> DataFrame:
    """``pkg, version, section, key, body`` with one header per release; arguments as for :func:`report_rows`.

    The parts are stacked and reduced by one grouping: a release has at most one scanner row each.
    """
    risk = ["score", "grade", "verdict", "exit_code"]
    scanner = [F.col("scanner").alias("name"), "passed", "summary", "n_critical", "n_warning", "n_info"]
    parts = {"scanner": results.select(*_KEY, F.struct(*scanner).alias("scanner"))}
    parts["risk"] = scores.select(*_KEY, F.struct(*risk).alias("risk"))
    for name, frame in (("meta", metadata), ("repository", repositories), ("compared", compared)):
        if frame is not None:
            fields = [c for c in frame.columns if c not in _KEY]
            parts[name] = frame.select(*_KEY, F.struct(*fields).alias(name))
    kinds = {name: frame.schema[name].dataType for name, frame in parts.items()}
    stacked = None
    for name, frame in parts.items():
        row = frame.select(*_KEY, *[F.col(n) if n == name else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
        stacked = row if stacked is None else stacked.unionByName(row)
    whole = stacked.groupBy(*_KEY).agg(
        F.array_sort(F.collect_list("scanner")).alias("scanners"),
        *[F.first(n, ignorenulls=True).alias(n) for n in kinds if n != "scanner"],
    )
    package = [F.col("pkg").alias("name"), F.col("version")]
    if metadata is not None:
        package += [F.col(f"meta.{f.name}") for f in kinds["meta"].fields]
    body = [F.struct(*package).alias("package"), F.col("scanners")]
    if repositories is not None:
        body.append(F.col("repository"))
    if compared is not None:
        body.append(_comparison(repositories is not None).alias("diff"))
    body += [F.col(f"risk.{c}").alias(c) for c in risk]
    return whole.select(*_KEY, F.lit(HEADER).alias("section"), F.lit("").alias("key"), _json(*body).alias("body"))


def _comparison(with_repository: bool) -> Column:
    """Whether the comparison took place, why not, and its counts."""
    found = F.coalesce("repository.found", F.lit(False)) if with_repository else F.lit(True)
    there = F.coalesce("compared.performed", F.lit(False))
    error = F.when(~found, "no repository found").when(~there, "no source files")
    counts = [
        F.when(found & there, F.col(f"compared.{c}")).otherwise(F.lit(0).cast("bigint")).alias(c)
        for c in ("n_unexpected", "n_expected_build", "n_modified")
    ]
    return F.struct((found & there).alias("performed"), error.alias("error"), *counts)


def finding_sections(findings: DataFrame) -> DataFrame:
    """One object for the findings of a scanner in a file; ``key`` is the file, empty if there is none."""
    entry = F.struct(*_FINDING)
    listed = findings.groupBy(*_KEY, "scanner", "file").agg(F.array_sort(F.collect_list(entry)).alias("findings"))
    body = _json(F.col("scanner"), F.col("file"), F.col("findings"))
    return listed.select(*_KEY, F.col("scanner").alias("section"), F.coalesce("file", F.lit("")).alias("key"), body.alias("body"))


def difference_sections(differences: DataFrame) -> DataFrame:
    """One object for each file that differs from the source."""
    body = _json(F.col("path"), F.col("class"))
    return differences.select(*_KEY, F.lit(DIFF).alias("section"), F.col("path").alias("key"), body.alias("body"))


def report_rows(
    results: DataFrame,
    findings: DataFrame,
    scores: DataFrame,
    metadata: DataFrame | None = None,
    repositories: DataFrame | None = None,
    compared: DataFrame | None = None,
    differences: DataFrame | None = None,
) -> DataFrame:
    """``pkg, version, section, key, body``.

    ``results`` from ``scanner_results`` and ``scores`` from ``score``.  Optional, with one row per
    release each: ``metadata`` (package), ``repositories`` (``found`` and more) and ``compared``
    (:func:`diff.rollup`); ``differences(pkg, version, path, class)`` lists the files that differ.
    """
    rows = headers(results, scores, metadata, repositories, compared).unionByName(finding_sections(findings))
    return rows if differences is None else rows.unionByName(difference_sections(differences))


_HEADER_LAYOUT = (
    "scanners array<struct<name: string, passed: boolean, summary: string>>, repository struct<found: boolean>, "
    "diff struct<performed: boolean, error: string, n_unexpected: bigint, n_expected_build: bigint, n_modified: bigint>, "
    "score double, grade string, verdict string, exit_code int"
)
_SECTION_LAYOUT = (
    "scanner string, file string, findings array<struct<line: int, severity: string, rule_id: string, "
    "message: string, evidence: string>>"
)


def read_headers(rows: DataFrame) -> DataFrame:
    """The headers of a report as typed columns, read from their text."""
    parsed = rows.filter(F.col("section") == HEADER).select(*_KEY, F.from_json("body", _HEADER_LAYOUT).alias("r"))
    return parsed.select(*_KEY, "r.*")


def read_findings(rows: DataFrame) -> DataFrame:
    """The findings of a report in the shared layout, read from its text."""
    sections = rows.filter(~F.col("section").isin(HEADER, DIFF))
    parsed = sections.select(*_KEY, F.from_json("body", _SECTION_LAYOUT).alias("r"))
    listed = parsed.select(*_KEY, "r.scanner", "r.file", F.explode("r.findings").alias("f"))
    return listed.select(*_KEY, "scanner", "file", "f.*").select(*FINDING_COLUMNS)


def read_differences(rows: DataFrame) -> DataFrame:
    """``pkg, version, path, class`` of the files that differ, read from the text of a report."""
    parsed = rows.filter(F.col("section") == DIFF).select(*_KEY, F.from_json("body", "path string, class string").alias("r"))
    return parsed.select(*_KEY, "r.*")


def describe(versions: DataFrame) -> DataFrame:
    """Metadata section for the report, with the size in readable form."""
    return versions.select(
        *_KEY, "description", "license", "publisher", "published_at", "repository_url",
        "homepage", "file_count", "unpacked_size",
        tx.size_label(F.col("unpacked_size")).alias("size_label"),
    )


def write_reports(rows: DataFrame, path: str) -> None:
    """Write one JSON object per line, grouped in directories by section."""
    rows.select("section", "body").write.partitionBy("section").mode("overwrite").text(path)
