"""Severity counts, category points, the total score and the gate.

Everything a score needs is additive per release, so findings, scanner runs, flags and extra points
are stacked and reduced by one grouping with map-side combine.  A release with a third of all
findings sends one row per task, and no join is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.sql import quote
from .static_rules import relax_for_cli_tools

_SEVERITIES = (rules.CRITICAL, rules.WARNING, rules.INFO)


def severity_counts(findings: DataFrame) -> DataFrame:
    """``pkg, version, scanner, n_critical, n_warning, n_info``."""
    return findings.groupBy("pkg", "version", "scanner").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in _SEVERITIES]
    )


Weights = dict[str, tuple[float, float, float, float]]


def _category_points(weight: tuple[float, ...], counts: list[str]) -> str:
    """Maximum points less ``base * (1 + ln n)`` per severity, at least zero."""
    most, *bases = weight
    lost = [
        f" - CASE WHEN {n} > 0 THEN {base}D * (1 + ln({n})) ELSE 0D END"
        for base, n in zip(bases, counts)
        if base
    ]
    return f"greatest(0D, {most}D{''.join(lost)})"


def grade(score: Column) -> Column:
    letter = F.when(score >= rules.GRADES[0][1], rules.GRADES[0][0])
    for name, least in rules.GRADES[1:]:
        letter = letter.when(score >= least, name)
    return letter.otherwise("F")


def _by_grade(letter: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[letter]


def judge(scored: DataFrame) -> DataFrame:
    """Add grade, verdict and exit code to a ``score`` column."""
    return scored.withColumn("grade", grade(F.col("score"))).withColumns(
        {
            "verdict": _by_grade(F.col("grade"), rules.VERDICTS),
            "exit_code": _by_grade(F.col("grade"), rules.EXIT_CODES),
        }
    )


def scan_runs(releases: DataFrame, scanners: tuple[str, ...] = rules.SCANNERS) -> DataFrame:
    """Which scanners ran: a clean result earns full points, an absent one earns none."""
    return releases.select(
        "pkg", "version", F.explode(F.array(*[F.lit(s) for s in scanners])).alias("scanner")
    )


#: Scanners that earn points.
WEIGHTED = tuple(rules.CATEGORY_WEIGHTS)

_CLI_EXPECTED = tuple(r.rule_id for r in rules.STATIC_RULES if r.cli_expected)


def _layout() -> dict[str, Column]:
    """Columns of a stacked row and what they hold where a source has nothing to say."""
    return {
        "scanner": F.lit(None).cast("string"),
        "severity": F.lit(None).cast("string"),
        "relaxed": F.lit(False),
        "n": F.lit(1).cast("bigint"),
        "ran": F.lit(False),
        "is_cli": F.lit(False),
        "found": F.lit(False),
        "repository_points": F.lit(0.0),
        "diff_points": F.lit(0.0),
    }


def _rows(df: DataFrame, carry: Sequence[str] = (), **given: Column) -> DataFrame:
    columns = [given.get(name, value).alias(name) for name, value in _layout().items()]
    return df.select("pkg", "version", *carry, *columns)


def finding_rows(
    findings: DataFrame,
    weights: Weights = rules.CATEGORY_WEIGHTS,
    carry: Sequence[str] = (),
) -> DataFrame:
    relaxed = (F.col("scanner") == "static") & F.col("rule_id").isin(*_CLI_EXPECTED)
    return _rows(
        findings.filter(F.col("scanner").isin(*weights)),
        carry,
        scanner=F.col("scanner"),
        severity=F.col("severity"),
        relaxed=relaxed,
        **({"n": F.col("n")} if "n" in findings.columns else {}),
    )


def counted(findings: DataFrame) -> DataFrame:
    """Findings as counts ``n`` per release, scanner, rule and severity; :func:`score` takes either.

    Findings of a scan of contents that is stacked with others waits for every shuffle behind those;
    counted by itself it starts at once, beside them.
    """
    return findings.groupBy("pkg", "version", "scanner", "rule_id", "severity").agg(F.count("*").alias("n"))


def run_rows(runs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return _rows(runs, carry, scanner=F.col("scanner"), ran=F.lit(True))


def total_columns(weights: Weights = rules.CATEGORY_WEIGHTS, by_count: bool = False) -> list[Column]:
    """The additive facts of a release, over stacked rows; ``by_count`` where these are :func:`counted`."""

    def count(condition: str) -> str:
        return f"coalesce(sum(n) FILTER (WHERE {condition}), 0)" if by_count else f"count_if({condition})"

    columns = [
        "max(is_cli) AS is_cli",
        "max(found) AS found",
        "sum(repository_points) AS repository_points",
        "sum(diff_points) AS diff_points",
        "max(ran) AS any_run",
    ]
    for name in weights:
        mine = f"scanner = {quote(name)}"
        columns.append(f"coalesce(max({mine} AND ran), false) AS `ran_{name}`")
        columns += [
            f"{count(f"{mine} AND severity = '{s}'")} AS `{name}_{s}`" for s in _SEVERITIES
        ]
    columns += [
        f"{count(f"relaxed AND severity = '{s}'")} AS relaxed_{s}"
        for s in (rules.CRITICAL, rules.WARNING)
    ]
    return [F.expr(c) for c in columns]


def score_totals(totals: DataFrame, weights: Weights = rules.CATEGORY_WEIGHTS) -> DataFrame:
    """Category points, score, grade, verdict and exit code from ``total_columns``.

    Points of a partial run add up to no grade: where a weighted scanner did not run, grade, verdict
    and exit code are null.
    """

    def count(name: str, s: str) -> str:
        n = f"`{name}_{s}`"
        if name != "static":
            return n
        moved = "relaxed_critical + relaxed_warning"
        change = f"+ ({moved})" if s == rules.INFO else f"- relaxed_{s}"
        return f"CASE WHEN is_cli THEN {n} {change} ELSE {n} END"

    earned = []
    for name, weight in weights.items():
        points = _category_points(weight, [f"({count(name, s)})" for s in _SEVERITIES])
        earned.append(F.expr(f"CASE WHEN `ran_{name}` THEN {points} ELSE 0D END AS `{name}_points`"))
    by_category = totals.filter("any_run").select(
        "pkg", "version", *earned, "repository_points", "diff_points",
        F.expr(" AND ".join(f"`ran_{name}`" for name in weights)).alias("_complete"),
    )
    points = [f"`{name}_points`" for name in weights] + ["repository_points", "diff_points"]
    total = F.expr(" + ".join(points))
    judged = judge(
        by_category.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    )
    whole = {c: F.when(F.col("_complete"), F.col(c)) for c in ("grade", "verdict", "exit_code")}
    return judged.withColumns(whole).drop("_complete")


def merge_totals(*parts: DataFrame) -> DataFrame:
    """Totals of the same releases from different runs, added up."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    kinds = {name: kind for name, kind in stacked.dtypes if name not in ("pkg", "version")}
    return stacked.groupBy("pkg", "version").agg(
        *[(F.max if kind == "boolean" else F.sum)(name).alias(name) for name, kind in kinds.items()]
    )


def totals(
    findings: DataFrame,
    runs: DataFrame,
    flags: DataFrame | None = None,
    repositories: DataFrame | None = None,
    compared: DataFrame | None = None,
    weights: Weights = rules.CATEGORY_WEIGHTS,
) -> DataFrame:
    """The additive facts of every release, from one grouping; arguments as for :func:`score`."""
    stacked = finding_rows(findings, weights).unionByName(run_rows(runs))
    if flags is not None:
        stacked = stacked.unionByName(_rows(flags, is_cli=F.col("is_cli")))
    if repositories is not None:
        stacked = stacked.unionByName(
            _rows(
                repositories,
                found=F.col("found"),
                repository_points=F.col("repository_points"),
            )
        )
    if compared is not None:
        stacked = stacked.unionByName(_rows(compared, diff_points=F.col("diff_points")))
    return stacked.groupBy("pkg", "version").agg(*total_columns(weights, "n" in findings.columns))


def only_found(summed: DataFrame) -> DataFrame:
    """A comparison only counts where a repository was found."""
    return summed.withColumn("diff_points", F.when(F.col("found"), F.col("diff_points")).otherwise(0.0))


def score(
    findings: DataFrame,
    runs: DataFrame,
    flags: DataFrame | None = None,
    repositories: DataFrame | None = None,
    compared: DataFrame | None = None,
    weights: Weights = rules.CATEGORY_WEIGHTS,
) -> DataFrame:
    """Score every release that appears in ``runs``.

    ``findings`` may come straight from ``scan_contents``, or :func:`counted`: with ``flags(pkg, version, is_cli)`` the
    allowance for command-line tools is made here, on counts.  ``repositories(pkg, version, found,
    repository_points)`` and ``compared(pkg, version, diff_points)`` add what those checks earned;
    a comparison only counts where a repository was found.  A scanner of one's own takes part once
    ``weights`` names it; findings of scanners without a weight are free.
    """
    summed = totals(findings, runs, flags, repositories, compared, weights)
    return score_totals(summed if repositories is None else only_found(summed), weights)


def with_failures(scores: DataFrame, failures: DataFrame) -> DataFrame:
    """``scores`` where a release that could not be read has no points, an ``error`` and the failing exit code.

    ``failures(pkg, version, error)`` has the releases that were not read to their end.  Whatever was found
    in them before is no basis for a score; releases that have no score at all come out as failed too.
    """
    key = ["pkg", "version"]
    failed = failures.groupBy(*key).agg(F.min("error").alias("error"))
    told = scores.join(failed, key, "full")
    gone = F.col("error").isNotNull()
    points = [c for c in scores.columns if c not in (*key, "exit_code")]
    return told.select(
        *key,
        *[F.when(~gone, F.col(c)).alias(c) for c in points],
        F.when(gone, F.lit(rules.EXIT_FAILED)).otherwise(F.col("exit_code")).alias("exit_code"),
        "error",
    )


def relaxed_counts(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """Severity counts of static findings after the allowance for command-line tools.

    Findings shrink to one row per release, rule and severity before they meet the flags.
    """
    per_rule = findings.groupBy("pkg", "version", "scanner", "rule_id", "severity").count()
    relaxed = relax_for_cli_tools(per_rule, flags)
    n = F.col("count")
    return relaxed.groupBy("pkg", "version", "scanner").agg(
        *[
            F.sum(F.when(F.col("severity") == s, n).otherwise(0)).alias(f"n_{s}")
            for s in _SEVERITIES
        ]
    )
