import json

import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import fleet, scoring
from parcelwatch.operators.hits import as_findings
from parcelwatch.plans import report, results
from parcelwatch.plans.scan import scan_static
from parcelwatch.streaming import feed

CONFIGS = {
    "pinned": {"mcpServers": {"a": {"command": "npx", "args": ["-y", "@s/n@1.2.3"]}}},
    "exe": {"mcpServers": {"a": {"command": "npx.exe", "args": ["srv"]}}},
    "flag-value": {"mcpServers": {"a": {"command": "bunx", "args": ["-p", "pkg", "--x", "bin@latest"]}}},
    "node": {"mcpServers": {"a": {"command": "node", "args": ["s.js"]}}},
    "no-args": {"mcpServers": {"a": {"command": "npx"}}},
    "only-flags": {"mcpServers": {"a": {"command": "npx", "args": ["-y", "--package"]}}},
    "odd": {"mcpServers": {"a": 5, "b": None, "c": {"args": "x"}}},
    "other": {"servers": {}},
    "range": {"mcpServers": {"a": {"command": "npx", "args": ["srv@^2.0.0"]}}},
}


def test_tool_servers(spark):
    rows = [(k, json.dumps(v)) for k, v in CONFIGS.items()] + [("broken", "{"), ("number", "5")]
    found = fleet.tool_servers(spark.createDataFrame(rows, "config_file string, body string"))
    got = {(r["config_file"], r["name"]): (r["npm_package"], r["version_pinned"]) for r in found.collect()}
    assert got == {
        ("pinned", "a"): ("@s/n@1.2.3", True), ("exe", "a"): ("srv", False),
        ("flag-value", "a"): ("bin@latest", False), ("node", "a"): (None, False),
        ("no-args", "a"): (None, False), ("only-flags", "a"): (None, False), ("odd", "c"): (None, False),
        ("range", "a"): ("srv@^2.0.0", True),
    }


def test_gate(spark):
    frame = spark.createDataFrame
    servers = frame(
        [("c1", "s", "a@1", True), ("c2", "s", "a", False), ("c3", "s", "gone@1", True), ("c4", "s", None, False)],
        "config_file string, name string, npm_package string, version_pinned boolean",
    )
    scores = frame(
        [("a", "1", 95.0, "A", "CLEAN", 0), ("a", "2", 72.0, "C", "CAUTION", 1)],
        "pkg string, version string, score double, grade string, verdict string, exit_code int",
    )
    latest = frame([("a", "2")], "pkg string, version string")
    gated = fleet.gate_servers(servers, scores, latest)
    got = {r["config_file"]: (r["version"], r["exit_code"]) for r in gated.collect()}
    assert got == {"c1": ("1", 0), "c2": ("2", 1), "c3": (None, 2)}
    assert tuple(fleet.fleet_gate(gated).first()) == (3, 1, 1, 2)
    assert fleet.fleet_gate(gated.limit(0)).first()["worst_exit"] == 0


@pytest.fixture(scope="module")
def corpus(make_files):
    packages = {
        f"p{i}": {f"f{j}.js": "ok\n" * j + ["eval(x)", "fetch(u)", "const a = 1;"][j % 3] for j in range(i + 1)}
        | ({"x.node": ""} if i % 2 else {})
        for i in range(6)
    }
    packages["big"] = {f"f{j}.js": "spawn(x)\n" * 20 for j in range(10)}
    return make_files(packages)


def test_report_holds_everything_once(spark, corpus):
    flags = spark.createDataFrame([("p1", "1.0.0", True)], "pkg string, version string, is_cli boolean")
    findings = scan_static(corpus, flags).cache()
    releases = corpus.select("pkg", "version").distinct()
    runs = scoring.scan_runs(releases, ("static", "hooks"))
    facts = releases.select(
        "pkg", "version", F.lit(1).alias("n_code_files"), F.col("pkg").isin("p1").alias("is_cli"),
        F.lit(0).alias("n_direct"), F.lit(0).alias("n_optional"), F.lit(True).alias("has_manifest"),
        F.lit(False).alias("has_scripts"), F.lit(False).alias("known_name"),
        F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("similar"),
    )
    sections = results.scanner_results(findings, runs, facts)
    scores = scoring.score(findings, runs)
    meta = releases.withColumn("license", F.lit("MIT"))
    health = releases.select("pkg", "version", (F.col("pkg") != "p3").alias("found"))
    differing = corpus.select("pkg", "version", "path", F.lit("unexpected").alias("class")).filter("pkg = 'p2'")
    compared = releases.select(
        "pkg", "version", F.col("pkg").isin("p2", "p3").alias("performed"), F.lit(3).cast("bigint").alias("n_unexpected"),
        F.lit(0).cast("bigint").alias("n_expected_build"), F.lit(0).cast("bigint").alias("n_modified"),
    )
    rows = report.report_rows(sections, findings, scores, meta, health, compared, differing).cache()
    # Keys are unique and the findings in the text are those that went in.
    assert rows.groupBy("pkg", "version", "section", "key").count().filter("count > 1").count() == 0
    back = report.read_findings(rows)
    assert back.count() == findings.count() == back.intersectAll(findings.select(*back.columns)).count()
    assert report.read_differences(rows).exceptAll(differing).count() == 0
    heads = {r["pkg"]: json.loads(r["body"]) for r in rows.filter("section = 'header'").collect()}
    assert set(heads) == {"big", *(f"p{i}" for i in range(6))}
    head = heads["big"]
    # Two scanners of eight ran: points, but no grade.
    assert head["package"] == {"name": "big", "version": "1.0.0", "license": "MIT"}
    assert head["grade"] is None and head["score"] > 0
    assert {s["name"]: s["summary"] for s in head["scanners"]} == {
        "static": "Found 200 critical pattern(s) across 1 files", "hooks": "No scripts defined",
    }
    none = {"n_unexpected": 0, "n_expected_build": 0, "n_modified": 0}
    assert head["diff"] == {"performed": False, "error": "no source files", **none}
    assert heads["p3"]["diff"] == {"performed": False, "error": "no repository found", **none}
    assert heads["p2"]["diff"] == {"performed": True, "error": None, **none, "n_unexpected": 3}
    tool = {s["name"]: s["summary"] for s in heads["p1"]["scanners"]}
    assert tool["static"].endswith("(CLI tool — shell execution expected)")
    only = report.report_rows(sections, findings.limit(0), scores)
    assert only.count() == 7 and all("diff" not in json.loads(r["body"]) for r in only.collect())


def test_report_is_written_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1", "header", "", '{"a":"x\\ny"}')], "pkg string, version string, section string, key string, body string")
    report.write_reports(rows, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()["value"]
    assert json.loads(line) == {"a": "x\ny"}


@pytest.fixture(scope="module")
def landed(spark, corpus, tmp_path_factory):
    """The corpus as many files, so that packages arrive over several batches."""
    path = str(tmp_path_factory.mktemp("landing") / "files")
    corpus.repartition(7, "path").write.parquet(path)
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return path, stream


def test_stream_findings_equal_batch(spark, corpus, landed, tmp_path):
    flags = spark.createDataFrame([("p1", "1.0.0", True)], "pkg string, version string, is_cli boolean")
    query = feed.write_findings(
        landed[1], flags, str(tmp_path / "out"), str(tmp_path / "progress"), availableNow=True
    )
    query.awaitTermination()
    from parcelwatch.operators.static_rules import relax_for_cli_tools

    batch = as_findings(relax_for_cli_tools(feed.file_findings(corpus), flags))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0
    assert len(query.recentProgress) > 1


@pytest.mark.parametrize("max_delay", [None, "2 days"])
def test_stream_scores_wait_for_the_last_file(spark, corpus, landed, tmp_path, max_delay):
    counts = corpus.groupBy("pkg", "version").agg(F.count("*").alias("file_count"))
    late = F.when(F.col("pkg") == "p3", F.col("file_count") + 1).otherwise(F.col("file_count"))
    releases = counts.select("pkg", "version", late.alias("file_count"), (F.col("pkg") == "p1").alias("is_cli"))
    arriving = landed[1].withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    feed.write_scores(
        arriving, releases, str(tmp_path / "out"), str(tmp_path / "progress"), max_delay,
        availableNow=True,
    ).awaitTermination()
    runs = scoring.scan_runs(corpus.select("pkg", "version").distinct(), feed.FILE_SCANNERS)
    flags = releases.select("pkg", "version", "is_cli")
    batch = scoring.score(feed.file_findings(corpus), runs, flags)
    expected = {r["pkg"]: round(r["score"], 9) for r in batch.collect() if r["pkg"] != "p3"}
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(expected)
    assert {r["pkg"]: round(r["score"], 9) for r in rows} == expected


def test_stream_forgets_old_releases(spark, make_files, tmp_path):
    """Only releases near the latest publication are kept between batches."""
    days = [make_files({f"d{d}": {"a.js": "eval(x)"}}).withColumn(
        "published_at", F.lit(f"2026-01-{d:02d}").cast("timestamp")) for d in range(1, 10)]
    for day in days:
        day.coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    stream = spark.readStream.schema(days[0].schema).option("maxFilesPerTrigger", 1)
    releases = spark.createDataFrame(
        [(f"d{d}", "1.0.0", 1, False) for d in range(1, 10)],
        "pkg string, version string, file_count long, is_cli boolean",
    )
    query = feed.write_scores(
        stream.parquet(str(tmp_path / "landing")), releases, str(tmp_path / "out"),
        str(tmp_path / "progress"), "1 day", availableNow=True,
    )
    query.awaitTermination()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
