"""Scores worked out by hand from the weights."""

from datetime import datetime
from math import log

import pytest
from pyspark.sql import functions as F

from parcelwatch import rules
from parcelwatch.operators import diff, repository, scoring

SCANNERS = tuple(rules.CATEGORY_WEIGHTS)
NOW = datetime(2026, 3, 15)

# name -> (findings as scanner/severity/count, repository, unexpected files or None)
GOOD = {"stars": 500, "archived": False, "created_at": datetime(2020, 1, 1), "publisher": "own"}
CASES = {
    "good": ([], GOOD, None, 90, "A"),
    "one-critical": ([("static", "critical", 1)], GOOD, None, 75, "C"),
    "no-repository": ([], None, None, 75, "C"),
    "archived": ([], {**GOOD, "archived": True}, None, 80, "B"),
    "zero-stars": ([], {**GOOD, "stars": 0}, None, 85, "B"),
    "mismatch-popular": ([], {**GOOD, "publisher": "ci"}, None, 87, "B"),
    "mismatch": ([], {**GOOD, "publisher": "ci", "stars": 50}, None, 80, "B"),
    "provenance": ([], {**GOOD, "publisher": "ci", "stars": 50, "provenance": "oidc"}, None, 90, "A"),
    "young": ([], {**GOOD, "created_at": datetime(2026, 3, 14)}, None, 85, "B"),
    "case-blind": ([], {**GOOD, "publisher": "OWN"}, None, 90, "A"),
    "compared": ([], GOOD, 0, 100, "A"),
    "one-unexpected": ([], GOOD, 1, 97, "A"),
    "two-unexpected": ([], GOOD, 2, 100 - 3 * (1 + log(2)), "A"),
    "capped": ([], GOOD, 500, 92, "A"),
    "not-compared-without-repository": ([], None, 0, 75, "C"),
    "one-warning": ([("static", "warning", 1)], GOOD, None, 85, "B"),
    "three-criticals": ([("static", "critical", 3)], GOOD, None, 65, "D"),
    "two-warnings": ([("static", "warning", 2)], GOOD, None, 90 - 5 * (1 + log(2)), "B"),
    "report": ([("static", "warning", 1), ("obfuscation", "critical", 1), ("obfuscation", "warning", 2),
                ("obfuscation", "info", 8), ("secrets", "critical", 1)], None, None, 50, "F"),
    "ioc-is-free": ([("ioc", "warning", 9)], GOOD, None, 90, "A"),
}


@pytest.fixture(scope="module")
def scored(spark):
    findings, links, health, compared = [], [], [], []
    for name, (found, repo, unexpected, *_) in CASES.items():
        findings += [(name, "1", s, v, "r") for s, v, n in found for _ in range(n)]
        url = f"https://github.com/own/{name}" if repo else "https://gitlab.com/own/x"
        links.append((name, "1", url, (repo or {}).get("publisher", ""), (repo or {}).get("provenance")))
        if repo:
            health.append((f"Own/{name}", repo["stars"], repo["archived"], repo["created_at"]))
        if unexpected is not None:
            compared.append((name, "1", unexpected))
    frame = spark.createDataFrame
    releases = frame([(n, "1") for n in CASES], "pkg string, version string")
    scored_links = repository.score_links(
        frame(links, "pkg string, version string, repository_url string, publisher string, provenance_id string"),
        frame(health, "full_name string, stars long, archived boolean, created_at timestamp"),
        F.lit(NOW),
    )
    points = frame(compared, "pkg string, version string, n long").select(
        "pkg", "version", diff.diff_points(F.col("n")).alias("diff_points")
    )
    rows = scoring.score(
        frame(findings, "pkg string, version string, scanner string, severity string, rule_id string"),
        scoring.scan_runs(releases),
        None,
        scored_links,
        points,
    ).collect()
    return {r["pkg"]: r for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_score(scored, name):
    *_, score, grade = CASES[name]
    assert scored[name]["score"] == pytest.approx(score)
    assert scored[name]["grade"] == grade
    assert scored[name]["exit_code"] == rules.EXIT_CODES[grade]
    assert scored[name]["verdict"] == rules.VERDICTS[grade]


def test_weights_add_up():
    most = sum(w[0] for w in rules.CATEGORY_WEIGHTS.values())
    assert most + rules.REPOSITORY_POINTS + rules.DIFF_POINTS == 100


def test_scanner_that_did_not_run_earns_nothing(spark):
    releases = spark.createDataFrame([("a", "1")], "pkg string, version string")
    none = spark.createDataFrame([], "pkg string, version string, scanner string, severity string, rule_id string")
    row = scoring.score(none, scoring.scan_runs(releases, ("static", "hooks"))).first()
    assert row["score"] == 35 and row["obfuscation_points"] == 0


def test_allowance_for_tools_is_made_on_counts(spark):
    frame = spark.createDataFrame
    releases = frame([("tool", "1"), ("lib", "1")], "pkg string, version string")
    found = frame(
        [(p, "1", "static", "critical", r) for p in ("tool", "lib") for r in ("spawn", "eval")],
        "pkg string, version string, scanner string, severity string, rule_id string",
    )
    flags = frame([("tool", "1", True)], "pkg string, version string, is_cli boolean")
    rows = scoring.score(found, scoring.scan_runs(releases, ("static",)), flags).collect()
    points = {r["pkg"]: r["static_points"] for r in rows}
    assert points["tool"] == pytest.approx(10)
    assert points["lib"] == pytest.approx(max(0, 25 - 15 * (1 + log(2))))
    counts = {r["pkg"]: (r["n_critical"], r["n_info"]) for r in scoring.relaxed_counts(found, flags).collect()}
    assert counts == {"tool": (1, 1), "lib": (2, 0)}


def test_own_scanner_takes_part_once_it_has_a_weight(spark):
    frame = spark.createDataFrame
    releases = frame([("a", "1")], "pkg string, version string")
    found = frame([("a", "1", "licenses", "warning", "x")],
                  "pkg string, version string, scanner string, severity string, rule_id string")
    runs = scoring.scan_runs(releases, ("static", "licenses"))
    assert scoring.score(found, runs).first()["score"] == 25
    weights = {**rules.CATEGORY_WEIGHTS, "licenses": (20.0, 10.0, 4.0, 1.0)}
    row = scoring.score(found, runs, weights=weights).first()
    assert (row["licenses_points"], row["score"]) == (16, 41)
