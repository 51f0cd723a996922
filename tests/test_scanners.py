import json

import pytest
from pyspark.sql import functions as F

from parcelwatch import rules
from parcelwatch.plans import report, results, scanners
from parcelwatch.sources import registry


def _todo(files, _):
    return files.filter(F.col("content").contains("TODO")).select(
        "pkg", "version", F.lit(rules.WARNING).alias("severity"), F.lit("todo").alias("rule_id"),
        F.lit("Unfinished").alias("message"), F.col("path").alias("file"),
    )


@pytest.fixture(scope="module")
def corpus(spark, make_files):
    files = make_files({"lodahs": {"a.js": "eval(x) // TODO", "b.js": "TODO", "x.node": ""}, "clean": {"a.js": "1"}})
    bodies = [
        {"name": "lodahs", "version": "1.0.0", "scripts": {"postinstall": "curl x"}, "dependencies": {"a": "*"}},
        {"name": "clean", "version": "1.0.0"},
    ]
    manifests = registry.manifest_versions(spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string"))
    popular = spark.createDataFrame([("lodash", 1)], "name string, ord bigint")
    return files, manifests, popular


def test_all_built_in_scanners(corpus):
    files, manifests, popular = corpus
    run = scanners.builtin(popular)
    assert set(run.names) == set(rules.SCANNERS) and run.weights == rules.CATEGORY_WEIGHTS
    found = {(r["pkg"], r["scanner"]) for r in run.findings(files, manifests).collect()}
    assert found == {("lodahs", s) for s in ("static", "hooks", "binaries", "dependencies", "typosquatting")}


def test_added_scanner_is_everywhere(spark, corpus):
    files, manifests, popular = corpus
    plain = scanners.builtin(popular)
    run = plain.add("todo", _todo, (4.0, 4.0, 1.0, 0.0))
    assert "todo" not in plain.names
    found = run.findings(files, manifests)
    assert found.filter("scanner = 'todo'").count() == 2
    releases = manifests.select("pkg", "version")
    scored = run.score(found, releases)
    points = {r["pkg"]: r["todo_points"] for r in scored.collect()}
    assert points["clean"] == 4.0 and points["lodahs"] == pytest.approx(4 - 1.6931471805599454)
    facts = results.with_facts(
        files, releases.withColumn("is_cli", F.lit(False)),
        releases.withColumns({"n_direct": F.lit(0), "n_optional": F.lit(0)}), releases.limit(0),
        releases.withColumn("name", F.col("pkg")),
        spark.createDataFrame([], "name string, summary string"), releases,
    )
    told = results.scanner_results(found, run.runs(releases), facts)
    mine = {r["pkg"]: (r["passed"], r["summary"]) for r in told.filter("scanner = 'todo'").collect()}
    assert mine == {"lodahs": (False, "Findings: 2 warning"), "clean": (True, "No findings")}
    rows = report.report_rows(told, found, scored)
    assert {r["file"] for r in report.read_findings(rows).filter("scanner = 'todo'").collect()} == {"a.js", "b.js"}
    assert "todo" in {s["name"] for s in report.read_headers(rows).first()["scanners"]}


def test_weights_of_a_table(spark, corpus):
    files, manifests, popular = corpus
    layout = "scanner string, most double, critical double, warning double, info double"
    table = spark.createDataFrame([("todo", 50.0, 1.0, 2.0, 3.0), ("hooks", 10.0, 10.0, 5.0, 0.0), ("other", 1.0, 1.0, 1.0, 1.0)], layout)
    run = scanners.builtin(popular).add("todo", _todo).weighted(table)
    assert run.weights == {"todo": (50.0, 1.0, 2.0, 3.0), "hooks": (10.0, 10.0, 5.0, 0.0)}
    scored = run.score(run.findings(files, manifests), manifests.select("pkg", "version"))
    assert {r["pkg"]: round(r["score"], 4) for r in scored.collect()}["clean"] == 60.0
    with pytest.raises(ValueError):
        run.weighted(table.union(table))
    with pytest.raises(ValueError):
        run.weighted(table.limit(0))


def test_names_are_unique(corpus):
    with pytest.raises(ValueError):
        scanners.builtin(corpus[2]).add("static", _todo)
