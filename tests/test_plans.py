"""What the physical plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import diff, ioc, repository, scoring
from parcelwatch.operators.static_rules import relax_for_cli_tools
from parcelwatch.plans.results import release_facts
from parcelwatch.plans.scan import scan_contents, scan_hits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    df.collect()
    text = plan_of(df)
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, make_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "files")
    make_files({"p": {f"f{i}.js": "eval(x)\nhttps://evil.cc/" for i in range(50)}}).write.parquet(path)
    return spark.read.parquet(path)


def test_content_scan_does_not_shuffle(stored):
    assert "Exchange" not in plan_of(scan_hits(stored))


def test_entropy_runs_once(stored):
    assert plan_of(scan_contents(stored)).count("ArrowEvalPython [") == 1


def test_costly_patterns_are_not_repeated(stored):
    plan = scan_contents(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instanceof)") == 1
    assert plan.count("{51}") <= 3  # the test itself and the two windows


def test_counting_files_reads_paths_only(stored):
    assert "content" not in plan_of(release_facts(stored)).split("ReadSchema")[1]


def test_contents_do_not_enter_the_comparison_shuffle(stored):
    prints = diff.fingerprints(stored)
    text = plan_of(diff.match(prints, prints))
    assert "SortAggregate" not in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_scores_need_one_shuffle_with_map_side_combine(stored):
    findings = scan_contents(stored)
    releases = stored.select("pkg", "version")
    text = plan_of(scoring.score(findings, scoring.scan_runs(releases)))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    below = text.split("Exchange hashpartitioning")[1]
    assert "partial_count_if" in below or "partial_count" in below


def test_indicator_limit_is_applied_before_the_shuffle(stored):
    lines = plan_of(ioc.locations(ioc.sightings(scan_hits(stored, ("ioc",))))).splitlines()
    shuffle = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    limits = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x]
    assert min(limits) < shuffle < max(limits)


@pytest.fixture
def small_skew(spark):
    """Thresholds low enough for a test-sized hot key to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def hot(spark, n=60_000):
    """One release owns a third of the rows."""
    i = F.col("id")
    pkg = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (i % 997).cast("string")))
    return spark.range(0, n, 1, 8).select(pkg.alias("pkg"), F.lit("1").alias("version"), i)


def test_flag_join_splits_a_hot_release(spark, small_skew):
    findings = hot(spark).select(
        "pkg", "version", F.lit("static").alias("scanner"), F.lit("spawn").alias("rule_id"),
        F.lit("critical").alias("severity"), F.sha2(F.col("id").cast("string"), 256).alias("message"),
    )
    flags = findings.select("pkg", "version").distinct().withColumn("is_cli", F.lit(True))
    relaxed = relax_for_cli_tools(findings, flags)
    assert "skew=true" in final_plan_of(relaxed)
    assert relaxed.filter("severity = 'info'").count() == 60_000


def test_repository_join_splits_a_hot_repository_and_sets_unlinked_aside(spark, small_skew):
    rows = hot(spark).select(
        F.col("id").cast("string").alias("pkg"), "version",
        F.concat(F.lit("https://github.com/o/"), F.col("pkg")).alias("repository_url"),
        F.sha2(F.col("id").cast("string"), 256).alias("publisher"),
    )
    nowhere = rows.withColumn("repository_url", F.lit(""))
    health = rows.select(F.substring("repository_url", 20, 99).alias("full_name")).distinct()
    joined = repository.link_health(rows.unionByName(nowhere), health)
    assert "skew=true" in final_plan_of(joined)
    assert joined.filter("found").count() == 60_000 and joined.count() == 120_000
