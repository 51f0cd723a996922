"""State of a stream stays narrow, and its joins keep it out of the driver's memory."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from parcelwatch.plans import queries
from parcelwatch.streaming import admission

N_FILES = 150  # more than two words of receipts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sent_unmeasured(plan):
    """What a plan broadcasts by the size of its files, without a shuffle that measures the rows."""
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.splitlines()]
    found = []
    for at, (depth, text) in enumerate(lines):
        if "BroadcastExchange" in text:
            below = next((i for i, (d, _) in enumerate(lines[at + 1 :], at + 1) if d <= depth), len(lines))
            parts = [x for _, x in lines[at + 1 : below]]
            if any("FileScan" in x for x in parts) and not any(" Exchange " in x for x in parts):
                found.append("\n".join(parts))
    return found


@pytest.fixture(scope="module")
def admitted(spark, tmp_path_factory):
    """Two releases in three batches, most files more than once; the plans of all that was written."""
    paths = {"p": [f"src/f{i:03d}.js" for i in range(N_FILES)], "q": ["a.js"]}
    files = spark.createDataFrame(
        [(pkg, "1", path, "eval(x)" if i % 50 == 0 else "const a = 1;") for pkg, names in paths.items() for i, path in enumerate(names)],
        "pkg string, version string, path string, content string",
    ).withColumn("published_at", F.to_timestamp(F.lit("2026-01-01")))
    manifests = spark.createDataFrame(
        [(pkg, "1", (pkg, False, names, [], [])) for pkg, names in paths.items()],
        f"pkg string, version string, manifest {admission.MANIFEST}",
    ).withColumn("published_at", F.to_timestamp(F.lit("2026-01-01")))
    base = str(tmp_path_factory.mktemp("admitted"))
    spark.createDataFrame([("lodash", 1)], "name string, ord int").write.parquet(f"{base}/popular")
    own = admission.Admission(spark, f"{base}/state", spark.read.parquet(f"{base}/popular"), every=2)
    number = F.regexp_extract("path", "([0-9]+)", 1).try_cast("int")
    announced, plans, write = manifests.filter("pkg = 'p'"), [], DataFrameWriter.parquet

    def noted(self, *args, **kw):
        plans.append(_plan(self._df))
        return write(self, *args, **kw)

    batches = [
        admission.arrivals(files.filter(number < 100), announced),
        admission.arrivals(files.filter((number >= 64) | number.isNull()), manifests),  # some again
        admission.arrivals(files, manifests.limit(0)),  # all again
    ]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", noted)
        for i, batch in enumerate(batches):
            own.add(batch, i)
    return own, plans


def test_files_sent_again_count_once_in_any_word_of_receipts(spark, admitted):
    own, _ = admitted
    counted = own.counted.rows(spark).groupBy("pkg").count().collect()
    assert {tuple(r) for r in counted} == {("p", N_FILES), ("q", 1)}
    assert sorted(r["pkg"] for r in own.scores().collect()) == ["p", "q"]
    lines = own.findings().filter("scanner = 'static'").select("pkg", "file").collect()
    assert sorted(map(tuple, lines)) == [("p", f"src/f{i:03d}.js") for i in (0, 50, 100)] + [("q", "a.js")]


def test_receipts_are_as_narrow_as_the_files_of_a_release(spark, admitted):
    own, _ = admitted
    rows = own.receipts.before(spark, 3).collect()
    wide = [len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray, str))]
    assert max(wide) < 100  # of a release with one file as of one with many
    assert len(rows) == 3 + 1  # 64 files a row
    assert sum(bin(r["bits"] & (2**64 - 1)).count("1") for r in rows) == N_FILES + 1


def test_no_state_is_sent_to_all_tasks_by_the_size_of_its_files(admitted):
    _, plans = admitted
    assert len(plans) > 40 and any("/expected/" in p for p in plans)
    assert [x for p in plans for x in _sent_unmeasured(p) if "/state/" in x] == []


def test_manifests_are_gathered_by_keys(spark, tmp_path):
    base, key = str(tmp_path), "pkg string, version string"
    tables = {
        "package_files": spark.createDataFrame([("pkg-2", "1", "b"), ("pkg-2", "1", "a")], f"{key}, path string"),
        "pkg_flags": spark.createDataFrame([("pkg-2", "1", True)], f"{key}, is_cli boolean"),
        "release_name": spark.createDataFrame([("pkg-2", "1", "left-pad")], f"{key}, name string"),
        "release_script": spark.createDataFrame([("pkg-2", "1", "postinstall", "wget x")], f"{key}, name string, command string"),
        "release_dependency": spark.createDataFrame([("pkg-2", "1", "d", "*", "direct")], f"{key}, name string, spec string, kind string"),
    }
    given = {name: queries._written(spark, df, f"{base}/{name}") for name, df in tables.items()}
    found = queries._manifests(spark, base, given)
    assert _sent_unmeasured(_plan(found)) == []
    [(pkg, version, m)] = found.collect()
    assert (pkg, version, m["name"], m["is_cli"], sorted(m["paths"])) == ("pkg-2", "1", "left-pad", True, ["a", "b"])
    assert [tuple(x) for x in m["scripts"]] == [("postinstall", "wget x")]
    assert [tuple(x) for x in m["dependencies"]] == [("d", "*", "direct")]


def test_findings_of_scored_releases_are_joined_by_keys(spark, admitted, monkeypatch):
    own, _ = admitted
    assert [x for x in _sent_unmeasured(_plan(own.findings())) if "/state/" in x] == []
    monkeypatch.setattr(queries, "_admitted", lambda spark, sf: own)
    found = queries.stream_all_findings(spark, "/nowhere")
    assert [x for x in _sent_unmeasured(_plan(found)) if "/state/" in x] == []
    want = {(r["pkg"], r["scanner"], r["file"]) for r in own.findings().collect()}
    assert {(r["pkg"], r["scanner"], r["file"]) for r in found.collect()} == want
