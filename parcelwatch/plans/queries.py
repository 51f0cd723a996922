"""Named queries: every operator, run over relations derived from the test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions import urls
from ..operators import (
    binaries,
    chunks,
    diff,
    fleet,
    ioc,
    lines,
    manifest,
    obfuscation,
    repository,
    scoring,
    typosquat,
)
from ..operators.hits import as_findings, union_findings
from ..operators.static_rules import relax_for_cli_tools
from ..sources import archives, changes, corpus, files, registry
from ..sources.corpus import table, view
from ..streaming import admission, feed, indicators
from ..streaming.log import by_keys
from . import report, results, scan, scanners
from .scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- code rules -----------------------------------------------------------------------------


@query
def static_findings(spark, sf):
    return scan.scan_static(view(spark, sf, "package_files"), view(spark, sf, "pkg_flags"))


@query
def static_summary(spark, sf):
    found = scan.scan_contents(view(spark, sf, "package_files"), ("static",))
    return scoring.relaxed_counts(found, view(spark, sf, "pkg_flags"))


@query
def block_comment_lines(spark, sf):
    files = view(spark, sf, "package_files").filter(tx.is_code_file(F.col("path")))
    return lines.block_comment_lines(files)


@query
def chunked_comment_lines(spark, sf):
    """Lines that start in a block comment, from files cut into chunks of 1,000 characters."""
    files = view(spark, sf, "package_files").filter(tx.is_code_file(F.col("path")))
    return chunks.comment_lines(files, 1000)


@query
def entropy(spark, sf):
    return _round(obfuscation.file_entropy(view(spark, sf, "package_files")), "entropy")


@query
def chunked_entropy(spark, sf):
    """Entropy of files that are cut into chunks of 1,000 characters, dealt to all tasks."""
    return _round(chunks.file_entropy(view(spark, sf, "package_files"), 1000), "entropy")


@query
def obfuscation_findings(spark, sf):
    return scan.scan_obfuscation(view(spark, sf, "package_files"))


@query
def secret_findings(spark, sf):
    return scan.scan_secrets(view(spark, sf, "package_files"))


@query
def long_line_findings(spark, sf):
    """Static and obfuscation findings, lines of over 200 bytes read in parts."""
    hits = scan.scan_hits(view(spark, sf, "package_files"), ("static", "obfuscation"), longest=200)
    return relax_for_cli_tools(scan.findings_of(hits), view(spark, sf, "pkg_flags"))


# --- network indicators ---------------------------------------------------------------------


def _sightings(spark, sf):
    return ioc.sightings(scan.scan_hits(view(spark, sf, "package_files"), ("ioc",)))


@query
def ioc_findings(spark, sf):
    return scan.scan_ioc(view(spark, sf, "package_files"))


@query
def ioc_locations(spark, sf):
    return ioc.locations(_sightings(spark, sf))


@query
def long_line_locations(spark, sf):
    """Locations of indicators, lines of over 200 bytes read in parts."""
    hits = scan.scan_hits(view(spark, sf, "package_files"), ("ioc",), longest=200)
    return ioc.locations(ioc.sightings(hits))


@query
def ioc_own_list(spark, sf):
    """Indicators less those on hosts of a table of domains."""
    seen = ioc.without_hosts(_sightings(spark, sf), view(spark, sf, "own_domain"))
    return ioc.findings(ioc.indicators(seen))


@query
def ioc_counts(spark, sf):
    return ioc.distinct_counts(_sightings(spark, sf))


# --- manifests ------------------------------------------------------------------------------


@query
def hook_findings(spark, sf):
    return manifest.scan_hooks(view(spark, sf, "script"))


@query
def hook_summary(spark, sf):
    return manifest.summarize_hooks(manifest.scan_hooks(view(spark, sf, "script")))


@query
def dependency_counts(spark, sf):
    return manifest.dependency_counts(view(spark, sf, "dependency"))


@query
def dependency_findings(spark, sf):
    return manifest.scan_dependencies(view(spark, sf, "dependency"))


@query
def binary_findings(spark, sf):
    return binaries.scan_binaries(view(spark, sf, "package_files"))


@query
def binary_summary(spark, sf):
    return binaries.summarize(binaries.scan_binaries(view(spark, sf, "package_files")))


# --- names ----------------------------------------------------------------------------------


@query
def popular_list(spark, sf):
    """Popular names in the form they are published in, one JSON array, and read back.

    The array is one row, gathered and read by one task: a curated list, in all below the 2 GB of a cell.
    """
    entries = F.array_sort(F.collect_list(F.struct("ord", "name")))
    body = view(spark, sf, "popular").agg(
        F.to_json(F.transform(entries, lambda e: e["name"])).alias("value")
    )
    path = f"{scratch_dir(spark)}/popular"
    body.write.text(path)
    return files.read_popular(spark, path)


@query
def typosquat_pairs(spark, sf):
    return typosquat.similar_names(view(spark, sf, "candidate_names"), view(spark, sf, "popular"))


@query
def typosquat_summary(spark, sf):
    return typosquat.summarize(view(spark, sf, "candidate_names"), view(spark, sf, "popular"))


@query
def typosquat_findings(spark, sf):
    return typosquat.scan_typosquatting(
        view(spark, sf, "release_name"), view(spark, sf, "popular")
    )


# --- source comparison ----------------------------------------------------------------------


def _matched(spark, sf, given=None):
    if given and "matched" in given:
        return given["matched"]
    return diff.match(
        diff.fingerprints(view(spark, sf, "package_files", given)),
        diff.fingerprints(view(spark, sf, "source_files")),
    )


@query
def diff_classes(spark, sf):
    return diff.classes(_matched(spark, sf))


@query
def diff_rollup(spark, sf):
    return _round(diff.score_rollup(diff.rollup(_matched(spark, sf))), "diff_points")


# --- repositories and specifiers ------------------------------------------------------------


@query
def repo_parse(spark, sf):
    return repository.parse_links(view(spark, sf, "repo_link")).select(
        "pkg", "version", "owner", "repo"
    )


def _as_of(spark, sf) -> F.Column:
    """Date of the assessment: the latest order."""
    return table(spark, sf, "orders").agg(F.max("o_orderdate")).scalar().cast("timestamp_ntz")


@query
def repo_points(spark, sf):
    scored = repository.score_links(
        view(spark, sf, "repo_link"), view(spark, sf, "repo_health"), _as_of(spark, sf)
    )
    return scored.select("pkg", "version", "found", "publisher_matches", "repository_points")


@query
def spec_parse(spark, sf):
    target = F.col("target")
    name, version = urls.split_specifier(target)
    local = urls.is_local_archive(target)
    return view(spark, sf, "specifier").select(
        "id",
        F.when(local, target).otherwise(name).alias("name"),
        F.when(~local, version).alias("version"),
        local.alias("is_local"),
        urls.is_pinned(target).alias("is_pinned"),
    )


# --- scores ---------------------------------------------------------------------------------

_POINTS = [f"{s}_points" for s in rules.CATEGORY_WEIGHTS] + ["repository_points", "diff_points"]


@query
def content_points(spark, sf):
    """Points of the content scanners alone: a partial run, so no grade."""
    files = view(spark, sf, "package_files")
    flags = view(spark, sf, "pkg_flags")
    runs = scoring.scan_runs(flags, scan.CONTENT_SCANNERS)
    scored = scoring.score(scan.scan_contents(files), runs, flags)
    points = [f"{s}_points" for s in scan.CONTENT_SCANNERS]
    return _round(scored, *points).select("pkg", "version", *points, "grade")


def _written(spark, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _once(spark, sf, linked=False, compared=False) -> dict[str, DataFrame]:
    """What several parts of a score or report read, written once: paths with hashes, releases, dependencies.

    Contents are read for it one time, and nothing of it is as wide as they are.  ``linked`` adds the links
    of releases: a filter on what is parsed from them would move below the join with the releases and parse
    those of all owners.  ``compared`` adds the links, the repositories and the comparison with the source,
    for which contents are read once more.
    """
    base, given = scratch_dir(spark), {}

    def keep(name: str, df: DataFrame) -> None:
        given[name] = _written(spark, df, f"{base}/{name}")

    hashed = F.sha2("content", 256).alias("sha256")
    keep("package_files", view(spark, sf, "package_files").select("pkg", "version", "path", hashed))
    for name in ("pkg_flags", "release", "release_dependency", *(["release_link"] if linked or compared else [])):
        keep(name, view(spark, sf, name, given))
    if compared:
        keep("matched", _matched(spark, sf, given))
        columns = ("pkg", "version", "found", "publisher_matches", "repository_points")
        keep("linked", _release_links(spark, sf, given).select(*columns))
    return given


def _release_links(spark, sf, given=None):
    if given and "linked" in given:
        return given["linked"]
    return repository.score_links(
        view(spark, sf, "release_link", given), view(spark, sf, "repo_health"), _as_of(spark, sf)
    )


def _manifest_findings(spark, sf, given=None):
    """Findings that do not depend on file contents."""
    return union_findings(
        manifest.scan_hooks(view(spark, sf, "release_script", given)),
        binaries.scan_binaries(view(spark, sf, "package_files", given)),
        manifest.scan_dependencies(view(spark, sf, "release_dependency", given)),
        typosquat.scan_typosquatting(
            view(spark, sf, "release_name", given), view(spark, sf, "popular")
        ),
    )


def _final_scores(spark, sf, findings, flags=None, given=None):
    """All categories, repository health and source comparison."""
    compared = diff.score_rollup(diff.rollup(_matched(spark, sf, given)))
    releases = view(spark, sf, "pkg_flags", given)
    return scoring.score(
        findings, scoring.scan_runs(releases), flags, _release_links(spark, sf, given), compared
    )


def _scored(spark, sf):
    """The full score of every release: all weighted scanners, health and comparison."""
    given = _once(spark, sf, linked=True)
    contents = scoring.counted(scan.scan_contents(view(spark, sf, "package_files")))
    findings = contents.unionByName(scoring.counted(_manifest_findings(spark, sf, given)))
    return _final_scores(spark, sf, findings, given["pkg_flags"], given)


@query
def final_scores(spark, sf):
    return _round(_scored(spark, sf), *_POINTS, "score")


@query
def package_scores(spark, sf):
    """Score, grade, verdict and exit code of every release."""
    columns = ("pkg", "version", "score", "grade", "verdict", "exit_code")
    return _round(_scored(spark, sf), "score").select(*columns)


def _all_findings(spark, sf, given):
    """Findings of all scanners.

    The hits of the one pass over contents are written out, as plain findings and indicators are
    both derived from them.
    """
    path = f"{scratch_dir(spark)}/hits"
    scan.scan_hits(view(spark, sf, "package_files")).write.parquet(path)
    hits = spark.read.parquet(path)
    return union_findings(
        relax_for_cli_tools(scan.findings_of(hits), given["pkg_flags"]),
        _manifest_findings(spark, sf, given),
        ioc.findings(scan.indicators_of(hits)),
    )


def _scanner_results(spark, sf, findings, given):
    flags = given["pkg_flags"]
    names = view(spark, sf, "release_name", given)
    dependencies = given["release_dependency"]
    facts = results.with_facts(
        view(spark, sf, "package_files"),
        flags,
        manifest.dependency_counts(dependencies),
        view(spark, sf, "release_script", given),
        names,
        typosquat.summarize(names, view(spark, sf, "popular")),
        names.select("pkg", "version"),
    )
    return results.scanner_results(findings, scoring.scan_runs(flags), facts)


@query
def severity_counts(spark, sf):
    return scoring.severity_counts(_all_findings(spark, sf, _once(spark, sf)))


@query
def scanner_results(spark, sf):
    given = _once(spark, sf)
    return _scanner_results(spark, sf, _all_findings(spark, sf, given), given)


def _reported_differences(matched, links):
    """Files that differ, of releases whose repository was found."""
    found = links.filter("found").select("pkg", "version").distinct()
    return diff.classes(matched).join(found, ["pkg", "version"], "left_semi")


def _report(spark, sf):
    # Findings feed sections, summaries and scores: written once.
    path, given = f"{scratch_dir(spark)}/findings", _once(spark, sf, compared=True)
    _all_findings(spark, sf, given).write.parquet(path)
    findings = spark.read.parquet(path)
    links, matched = _release_links(spark, sf, given), _matched(spark, sf, given)
    # Points to two places: the digits beyond depend on who prints them.
    scores = _final_scores(spark, sf, findings, given=given).withColumn("score", F.round("score", 2))
    return report.report_rows(
        _scanner_results(spark, sf, findings, given),
        findings,
        scores,
        repositories=links.select("pkg", "version", "found", "publisher_matches"),
        compared=diff.rollup(matched),
        differences=_reported_differences(matched, links),
    )


@query
def report_json(spark, sf):
    """Headers and sections as JSON text."""
    return _report(spark, sf)


@query
def report_findings(spark, sf):
    """The findings of all scanners, read back from the text of the report."""
    return report.read_findings(_report(spark, sf))


@query
def report_index(spark, sf):
    """What the JSON reports hold, read back from their text."""
    path = f"{scratch_dir(spark)}/report"
    _report(spark, sf).write.parquet(path)
    rows, key = spark.read.parquet(path), ["pkg", "version"]
    head = report.read_headers(rows)
    found = report.read_findings(rows).groupBy(*key).agg(F.count("*").alias("n_findings"))
    kinds = ("unexpected", "expected_build", "modified")
    differ = report.read_differences(rows).groupBy(*key).agg(
        *[F.count_if(F.col("class") == kind).alias(f"n_{kind}") for kind in kinds]
    )
    none = F.lit(0).cast("bigint")
    return head.join(found, key, "left").join(differ, key, "left").select(
        *key,
        *[F.coalesce(n, none).alias(n) for n in ("n_findings", *(f"n_{kind}" for kind in kinds))],
        F.coalesce("repository.found", F.lit(False)).alias("found"),
        "score", "grade", "exit_code", F.size("scanners").alias("n_scanners"),
    )


# --- registry documents ---------------------------------------------------------------------


@query
def package_metadata(spark, sf):
    versions = registry.package_versions(view(spark, sf, "registry_doc"))
    people = F.transform("maintainers", lambda p: p["name"])
    return versions.withColumn("maintainers", F.array_join(people, ",")).drop("manifest")


@query
def registry_dependencies(spark, sf):
    return registry.dependencies(registry.package_versions(view(spark, sf, "registry_doc")))


@query
def registry_scripts(spark, sf):
    return registry.scripts(registry.package_versions(view(spark, sf, "registry_doc")))


@query
def manifest_metadata(spark, sf):
    return registry.manifest_versions(view(spark, sf, "manifest_doc")).select(
        "pkg", "version", "license", "publisher", "repository_url", "is_cli"
    )


@query
def version_resolution(spark, sf):
    index = registry.index_documents(view(spark, sf, "registry_doc"))
    return registry.resolve_targets(view(spark, sf, "target"), index)


@query
def registry_snapshot(spark, sf):
    """The registry after a change feed in three deltas, out of order and with changes sent again."""
    feed_rows, path = view(spark, sf, "registry_change"), f"{scratch_dir(spark)}/registry"
    delta = F.pmod(F.xxhash64("id", "seq"), F.lit(3))
    for number in range(3):
        sent = feed_rows.filter((delta == number) | (F.pmod(F.col("seq"), F.lit(10)) == number))
        snapshot = changes.write_version(spark, path, sent, number + 1)
    docs = registry.index_documents(changes.current(snapshot))
    kept = snapshot.select("id", "seq", "deleted")
    return kept.join(docs.select(F.col("name").alias("id"), "latest"), "id", "left")


@query
def health_records(spark, sf):
    fields = files.HEALTH_FIELDS
    raw = view(spark, sf, "health_doc").select(F.from_json("body", fields).alias("r")).select("r.*")
    return files.health_records(raw).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).drop("last_push")


@query
def size_labels(spark, sf):
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 8)).cast("bigint")
    sized = table(spark, sf, "orders").select("o_orderkey", n.alias("n_bytes"))
    return sized.withColumn("label", tx.size_label(F.col("n_bytes")))


# --- archives and source trees --------------------------------------------------------------


@query
def archive_files(spark, sf):
    packed = corpus.pack_archives(view(spark, sf, "package_files"))
    return archives.expand_archives(packed).select(
        "pkg", "version", "path", F.sha2("content", 256).alias("sha256")
    )


@query
def archive_failures(spark, sf):
    """Archives cut short, as a broken download leaves them."""
    packed = corpus.pack_archives(view(spark, sf, "package_files"))
    number = F.regexp_extract("path", "([0-9]+)", 1).try_cast("bigint")
    cut = F.when(number % 9 == 4, F.substring("content", 1, 60)).otherwise(F.col("content"))
    return archives.damaged_archives(packed.withColumn("content", cut))


@query
def archive_scores(spark, sf):
    """Scores of releases read from archives; those of broken downloads are failed, not scored."""
    packed = corpus.pack_releases(view(spark, sf, "package_files"))
    number = F.substr("pkg", F.lit(5)).cast("bigint")
    size = F.octet_length("content")
    cut = F.when(number % 9 == 4, F.substr("content", F.lit(1), (size / 2).cast("int"))).otherwise(F.col("content"))
    path = f"{scratch_dir(spark)}/unpacked"
    archives.read_archives(packed.withColumn("content", cut)).write.parquet(path)
    rows = spark.read.parquet(path)
    package_files, failed = archives.files_of(rows), archives.failures_of(rows)
    given = _once(spark, sf, linked=True)
    findings = union_findings(
        scan.scan_contents(package_files), binaries.scan_binaries(package_files),
        _manifest_findings(spark, sf, given).filter(F.col("scanner") != binaries.SCANNER),
    )
    scored = _final_scores(spark, sf, findings, given["pkg_flags"], given)
    columns = ("pkg", "version", "score", "grade", "verdict", "exit_code")
    return scoring.with_failures(_round(scored, "score").select(*columns), failed)


@query
def source_roots(spark, sf):
    return diff.strip_single_root(
        view(spark, sf, "archived_source").select("pkg", "version", "path")
    )


# --- tool servers ---------------------------------------------------------------------------


@query
def tool_servers(spark, sf):
    found = fleet.tool_servers(view(spark, sf, "tool_config"))
    return found.withColumn("args", F.array_join("args", " "))


def _gated(spark, sf):
    # The latest version is what the registry says, not the largest text.
    index = registry.index_documents(view(spark, sf, "package_doc"))
    latest = index.select(F.col("name").alias("pkg"), F.col("latest").alias("version"))
    servers = fleet.tool_servers(view(spark, sf, "fleet_config"))
    return fleet.gate_servers(servers, _scored(spark, sf), latest)


@query
def server_scores(spark, sf):
    return _round(_gated(spark, sf), "score")


@query
def fleet_gate(spark, sf):
    return fleet.fleet_gate(_gated(spark, sf))


# --- own rules ------------------------------------------------------------------------------

USER_RULES = (
    rules.LineRule("debugger", rules.WARNING, "debugger statement",
                   rf"{rules.WB}debugger{rules.WE}", code_only=True),
    rules.LineRule("atob", rules.CRITICAL, "atob() — decoded text",
                   rf"{rules.WB}atob{rules.WS}*\(", cli_expected=True, code_only=True),
    rules.LineRule("const", rules.INFO, "const declaration", rf"{rules.WB}const{rules.WE}"),
)


@query
def user_rule_findings(spark, sf):
    return scan.scan_user_rules(
        view(spark, sf, "package_files"), USER_RULES, view(spark, sf, "pkg_flags")
    )


def _declarations(package_files: DataFrame, _: DataFrame | None) -> DataFrame:
    """A scanner as a user would add one: type declarations, a warning each."""
    return package_files.filter(F.col("path").endswith(".d.ts")).select(
        "pkg", "version", F.lit(rules.WARNING).alias("severity"), F.lit("declares").alias("rule_id"),
        F.lit("Type declarations").alias("message"), F.col("path").alias("file"),
    )


@query
def own_scanner_points(spark, sf):
    """Points of the content scanners and of one more that was added by name."""
    package_files, flags = view(spark, sf, "package_files"), view(spark, sf, "pkg_flags")
    run = scanners.Scanners([scanners.content_scanners()]).add("declarations", _declarations, (5.0, 5.0, 1.0, 0.0))
    scored = run.score(run.findings(package_files), flags, flags)
    points = [f"{name}_points" for name in run.names]
    return _round(scored, *points, "score").select("pkg", "version", *points, "score")


# --- streams --------------------------------------------------------------------------------


def _file_stream(spark, sf):
    """The corpus as a stream: documents read incrementally, signals planted on the way."""
    flags = view(spark, sf, "pkg_flags")
    documents = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(
        f"{sf}/document[s].parquet"  # a glob: one file or a folder of them
    )
    return corpus.planted(spark, "package_files", {"documents": documents}), flags


@query
def stream_findings(spark, sf):
    arriving, flags = _file_stream(spark, sf)
    base = scratch_dir(spark)
    feed.write_findings(
        arriving, flags, f"{base}/findings", f"{base}/progress", availableNow=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/findings")


@query
def stream_scores(spark, sf):
    counts = view(spark, sf, "package_files").groupBy("pkg", "version").agg(
        F.count("*").alias("file_count")
    )
    arriving, flags = _file_stream(spark, sf)
    base, given = scratch_dir(spark), _once(spark, sf, linked=True)
    # What needs no files is summed up once and joined to each batch of complete releases.
    resting = tuple(s for s in rules.CATEGORY_WEIGHTS if s not in feed.FILE_SCANNERS)
    findings = _manifest_findings(spark, sf, given).filter(F.col("scanner").isin(*resting))
    compared = diff.score_rollup(diff.rollup(_matched(spark, sf, given)))
    scoring.totals(
        findings, scoring.scan_runs(flags, resting), flags, _release_links(spark, sf, given), compared
    ).write.parquet(f"{base}/others")
    feed.write_scores(
        arriving,
        counts.join(flags, ["pkg", "version"]),
        f"{base}/scores",
        f"{base}/progress",
        others=spark.read.parquet(f"{base}/others"),
        availableNow=True,
    ).awaitTermination()
    return _round(spark.read.parquet(f"{base}/scores").drop("batch"), *_POINTS, "score")


#: Files that arrive, and of these in a batch: a file is written by one task, and read by few.
_N_LANDED = 24


def _sent(rows: DataFrame, again: F.Column) -> DataFrame:
    """``rows``, those of ``again`` twice, from one read."""
    times = F.array_repeat(F.lit(0), F.when(again, 2).otherwise(1))
    return rows.select("*", F.explode(times).alias("_time")).drop("_time")


def _landed(rows: DataFrame, path: str, n: int) -> None:
    """``rows`` as ``n`` more files in shuffled order."""
    rows.repartition(n, F.xxhash64(F.lit(11), *rows.columns[:2], "path")).write.mode("append").parquet(path)


def _arriving(spark, rows: DataFrame, path: str, per_batch: int) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query
def stream_ioc(spark, sf):
    """Indicators of files that arrive shuffled, in several batches, some of them twice."""
    package_files, base = view(spark, sf, "package_files"), scratch_dir(spark)
    again = F.pmod(F.xxhash64("path"), F.lit(10)) == 3
    _landed(_sent(package_files, again), f"{base}/landing", _N_LANDED)
    stream = _arriving(spark, package_files, f"{base}/landing", _N_LANDED // 3)
    indicators.write_indicators(
        stream, f"{base}/log", f"{base}/progress", every=2, availableNow=True
    ).awaitTermination()
    return indicators.indicator_findings(spark, indicators.sighting_log(f"{base}/log", every=2))


def _manifests(spark, sf, given=None) -> DataFrame:
    """``pkg, version, manifest`` of the planted releases."""
    key = ["pkg", "version"]

    def listed(name: str, *columns: str) -> DataFrame:
        return view(spark, sf, f"release_{name}", given).groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias(name))

    rows = view(spark, sf, "package_files", given).groupBy(*key).agg(F.collect_list("path").alias("paths"))
    rows = rows.join(by_keys(view(spark, sf, "pkg_flags", given)), key)
    rows = rows.join(by_keys(view(spark, sf, "release_name", given)), key, "left")
    rows = rows.join(listed("script", "name", "command"), key, "left")
    rows = rows.join(listed("dependency", "name", "spec", "kind"), key, "left")
    fields = F.struct("name", "is_cli", "paths", F.col("script").alias("scripts"), F.col("dependency").alias("dependencies"))
    return rows.select(*key, fields.alias("manifest"))


@functools.lru_cache(maxsize=8)
def _admitted(spark, sf) -> admission.Admission:
    """Files and manifests shuffled, every tenth file twice; some files and manifests never come."""
    base, when, given = scratch_dir(spark), F.to_timestamp(F.lit("2026-01-01")), _once(spark, sf, linked=True)
    number = F.regexp_extract("path", "([0-9]+)", 1).try_cast("bigint")
    files_there = view(spark, sf, "package_files").filter(F.coalesce(number % 45 != 7, F.lit(True)))
    # One after the other, so that the driver sends the table of releases to a single join at a time.
    for name in ("release_script", "release_name"):
        given[name] = _written(spark, view(spark, sf, name, given), f"{base}/{name}")
    announced = _manifests(spark, sf, given).filter(F.substr("pkg", F.lit(5)).cast("bigint") % 25 != 3)
    # Gathering dependencies is as much work as reading contents: done once, for both landings.
    announced = _written(spark, announced, f"{base}/manifests")
    rows = admission.arrivals(
        files_there.withColumn("published_at", when), announced.withColumn("published_at", when)
    )
    _landed(_sent(rows, F.pmod(F.xxhash64("pkg", "path"), F.lit(10)) == 3), f"{base}/landing", _N_LANDED)
    # A much later publication moves the watermark past all others.
    _landed(
        rows.filter("manifest IS NOT NULL").limit(1).withColumns(
            {"pkg": F.lit("later"), "published_at": F.to_timestamp(F.lit("2026-03-01"))}
        ),
        f"{base}/landing", 1,
    )
    compared = diff.score_rollup(diff.rollup(_matched(spark, sf, given)))
    links = _release_links(spark, sf, given)
    nothing = scoring.scan_runs(given["pkg_flags"], ())
    scoring.totals(
        as_findings(given["package_files"].limit(0).select("pkg", "version", *[
            F.lit("").alias(c) for c in ("scanner", "severity", "rule_id", "message")])),
        nothing, None, links, compared,
    ).write.parquet(f"{base}/others")
    own = admission.Admission(
        spark, f"{base}/state", view(spark, sf, "popular"), "7 days", spark.read.parquet(f"{base}/others"), every=2
    )
    stream = _arriving(spark, rows, f"{base}/landing", _N_LANDED // 2)
    admission.admit(stream, own, f"{base}/progress", availableNow=True).awaitTermination()
    return own


@query
def stream_admission(spark, sf):
    """Score of every complete release, and why the others have none."""
    own = _admitted(spark, sf)
    scored = own.scores().select("pkg", "version", F.lit("scored").alias("outcome"), F.lit(None).cast("bigint").alias("n_files"), "score", "grade")
    failed = own.failed().select(
        "pkg", "version", F.col("error").alias("outcome"), "n_files", F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("grade"),
    )
    return _round(scored.unionByName(failed), "score")


@query
def stream_all_findings(spark, sf):
    """Findings of all eight scanners of the releases that were scored."""
    own = _admitted(spark, sf)
    return own.findings().join(by_keys(own.scores().select("pkg", "version")), ["pkg", "version"], "left_semi")
