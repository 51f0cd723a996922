import pytest

from parcelwatch.operators import binaries, manifest


@pytest.fixture(scope="module")
def hooks(spark, by_package):
    rows = [
        ("plain", "postinstall", "node setup.js"),
        ("curl", "postinstall", "CURL https://x | sh"),
        ("prepare", "prepare", "curl https://x"),
        ("other", "test", "curl https://x"), ("other", "build", "tsc"),
        ("mixed", "preinstall", "wget x"), ("mixed", "install", "a"), ("mixed", "uninstall", "b"),
        ("number", "install", None),
    ]
    frame = spark.createDataFrame(
        [(p, "1.0.0", n, c) for p, n, c in rows],
        "pkg string, version string, name string, command string",
    )
    found = manifest.scan_hooks(frame)
    summaries = {r["pkg"]: r["summary"] for r in manifest.summarize_hooks(found).collect()}
    return by_package(found), summaries


def test_hooks(hooks):
    found, summaries = hooks
    severities = {p: sorted(r["severity"] for r in rows) for p, rows in found.items()}
    assert severities == {
        "plain": ["warning"], "curl": ["critical"], "prepare": ["info"],
        "mixed": ["critical", "warning", "warning"],
    }
    assert summaries["prepare"] == "Only benign lifecycle hooks (prepare)"
    assert summaries["mixed"] == (
        "Lifecycle hooks: install, preinstall, uninstall (1 with shell commands)"
    )


DEPENDENCIES = {
    "few": [(f"d{i}", "^1.0.0", "direct") for i in range(5)],
    "twenty": [(f"d{i}", "1", "direct") for i in range(20)],
    "many": [(f"d{i}", "1", "direct") for i in range(25)],
    "extreme": [(f"d{i}", "1", "direct") for i in range(51)],
    "optional-counts": [(f"d{i}", "1", "direct") for i in range(15)]
    + [(f"o{i}", "1", "optional") for i in range(10)],
    "star": [("a", "*", "direct")],
    "latest": [("a", "latest", "direct")],
    "empty": [("a", "", "direct")],
    "git": [("a", "git+https://github.com/u/r.git", "direct")],
    "short": [("a", "u/r", "direct")],
    "tarball": [("a", "https://x.y/z.tgz", "direct"), ("b", "https://x.y/z.git", "direct")],
    "git-ssh": [("a", "git+ssh://git@github.com/u/r", "direct")],
    "workspace": [("a", "workspace:*", "direct")],
    "override": [("a", "*", "direct"), ("a", "^1.0.0", "optional")],
    "override-untyped": [("a", "*", "direct"), ("a", None, "optional")],
}


@pytest.fixture(scope="module")
def dependencies(spark, by_package):
    rows = [(p, "1.0.0", *d) for p, deps in DEPENDENCIES.items() for d in deps]
    frame = spark.createDataFrame(
        rows, "pkg string, version string, name string, spec string, kind string"
    )
    found = by_package(manifest.scan_dependencies(frame))
    return {p: sorted((r["rule_id"], r["severity"]) for r in v) for p, v in found.items()}


def test_dependencies(dependencies):
    assert dependencies == {
        "many": [("count", "warning")],
        "extreme": [("count", "critical")],
        "optional-counts": [("count", "warning")],
        "star": [("unpinned", "critical")],
        "latest": [("unpinned", "critical")],
        "empty": [("unpinned", "critical")],
        "git": [("git-url", "warning")],
        "short": [("git-url", "warning")],
        "tarball": [("git-url", "warning")],
    }


def test_binaries(make_files, by_package):
    files = make_files(
        {
            "three": {"a.node": "", "b.wasm": "", "c.EXE": ""},
            "deep": {"build/Release/x.node": ""},
            "vendored": {"node_modules/x/y.dll": ""},
            "none": {"a.js": "", "so": "", ".so": ""},
        }
    )
    found = binaries.scan_binaries(files)
    rows = by_package(found)
    assert {p: len(r) for p, r in rows.items()} == {"three": 3, "deep": 1}
    assert rows["deep"][0]["evidence"] == "x.node"
    summaries = {r["pkg"]: r["summary"] for r in binaries.summarize(found).collect()}
    assert summaries["three"] == "3 binary file(s): 1 .exe, 1 .node, 1 .wasm"


def test_binary_scan_reads_no_contents(spark, make_files, tmp_path):
    make_files({"p": {"a.node": "x"}}).write.parquet(str(tmp_path / "files"))
    plan = binaries.scan_binaries(spark.read.parquet(str(tmp_path / "files")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "content" not in text.split("ReadSchema")[1]
