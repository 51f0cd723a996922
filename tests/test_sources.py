import io
import json
import random
import tarfile

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from parcelwatch.functions import text as tx
from parcelwatch.functions import urls
from parcelwatch.operators import diff, scoring
from parcelwatch.plans import report
from parcelwatch.sources import archives, corpus, files, registry


def test_package_tree(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, body in {
        "left/1.0.0/src/a.js": b"eval(x)",
        "@s/n/2.0.0/index.js": b"ok",
        "left/1.0.0/bad.js": b"a\xffb",
        "left/1.0.0/with space+plus.js": b"x",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    rows = files.read_package_tree(spark, str(root)).collect()
    assert {(r["pkg"], r["version"], r["path"], r["content"]) for r in rows} == {
        ("left", "1.0.0", "src/a.js", "eval(x)"),
        ("@s/n", "2.0.0", "index.js", "ok"),
        ("left", "1.0.0", "bad.js", "a�b"),
        ("left", "1.0.0", "with space+plus.js", "x"),
    }


def _archive(entries):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, body in entries:
            entry = tarfile.TarInfo(name)
            if body is None:
                entry.type = tarfile.DIRTYPE
                tar.addfile(entry)
            else:
                entry.size = len(body)
                tar.addfile(entry, io.BytesIO(body))
    return buffer.getvalue()


def test_archives(spark):
    good = _archive([("package", None), ("package/a.js", b"x"), ("./package/d/b.js", b"y"), ("other/c", b"z")])
    noise = bytes(range(256)) * 400
    damaged = _archive([("package/first.js", b"x"), ("package/second.bin", noise)])[:700]
    frame = spark.createDataFrame(
        [("p", "1", good), ("q", "1", b"not an archive"), ("r", "1", damaged)],
        "pkg string, version string, content binary",
    )
    rows = archives.expand_archives(frame).collect()
    found = {(r["pkg"], r["path"], r["content"]) for r in rows}
    assert found >= {("p", "a.js", "x"), ("p", "d/b.js", "y")}
    assert not {r for r in found if r[0] == "q"}
    everything = archives.expand_archives(frame.filter("pkg = 'p'"), root=None).collect()
    assert {r["path"] for r in everything} == {"package/a.js", "package/d/b.js", "other/c"}


def _packed(sizes):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for i, size in enumerate(sizes):
            entry = tarfile.TarInfo(f"package/f{i}.js")
            entry.size = size
            tar.addfile(entry, io.BytesIO(random.Random(i).randbytes(size)))
    return buffer.getvalue()


def test_archives_end_with_their_outcome(spark):
    whole = _packed([10, 70_000, 0, 5])
    cases = {"whole": whole, "cut": whole[:-3000], "junk": b"no archive", "empty": b"", "none": _packed([])}
    frame = spark.createDataFrame([(k, "1", v) for k, v in cases.items()] + [("null", "1", None)], "pkg string, version string, content binary")
    rows = archives.read_archives(frame).cache()
    outcomes = {r["pkg"]: (r["n_files"], r["error"]) for r in rows.collect() if r["path"] is None}
    damaged = "damaged archive"
    assert outcomes.pop("cut") == (1, damaged)
    assert outcomes == {"whole": (4, None), "junk": (0, damaged), "empty": (0, damaged), "null": (0, damaged), "none": (0, None)}
    n_files = {r["pkg"]: r["count"] for r in archives.files_of(rows).groupBy("pkg").count().collect()}
    assert n_files == {"whole": 4, "cut": 1}
    scores = spark.createDataFrame(
        [("whole", "1", 95.0, "A", 0), ("cut", "1", 95.0, "A", 0)], "pkg string, version string, score double, grade string, exit_code int"
    )
    told = {r["pkg"]: tuple(r)[2:] for r in scoring.with_failures(scores, archives.failures_of(rows)).collect()}
    assert told["whole"] == (95.0, "A", 0, None)
    assert all(told[k] == (None, None, 2, damaged) for k in ("cut", "junk", "empty", "null"))


def test_popular_list(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps(["lodash", "@types/node"], indent=1))
    rows = files.read_popular(spark, str(tmp_path / "names.json")).collect()
    assert [tuple(r) for r in rows] == [("lodash", 0), ("@types/node", 1)]


def test_health_records(spark, tmp_path):
    lines = [
        {"full_name": "a/b", "stargazers_count": 3, "license": {"spdx_id": "MIT"},
         "created_at": "2020-01-02T03:04:05Z", "archived": True},
        {"full_name": "c/d", "created_at": "soon", "license": None},
        {"message": "Not Found"},
    ]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, lines)))
    rows = {r["full_name"]: r for r in files.read_health(spark, str(tmp_path / "h.json")).collect()}
    assert set(rows) == {"a/b", "c/d"}
    assert (rows["a/b"]["stars"], rows["a/b"]["license"], rows["a/b"]["archived"]) == (3, "MIT", True)
    assert rows["a/b"]["created_at"].year == 2020
    assert rows["c/d"]["created_at"] is None and rows["c/d"]["stars"] == 0


DOCUMENT = {
    "name": "p", "dist-tags": {"latest": "2.0.0"}, "time": {"2.0.0": "2020"}, "maintainers": [{"name": "m"}],
    "versions": {
        "1.0.0": {"repository": "r", "license": {"type": "ISC"}, "bin": {"p": "c.js"}},
        "2.0.0": {"name": "p", "repository": {"url": "git+https://github.com/o/r.git"}, "license": "MIT",
                  "_npmUser": {"name": "u", "trustedPublisher": {"id": "oidc"}},
                  "dist": {"fileCount": 7, "unpackedSize": 11469}, "bin": None,
                  "dependencies": {"a": "1", "b": 2}, "optionalDependencies": {"c": "*"},
                  "scripts": {"install": "x", "test": 1}},
    },
}


def test_registry_document(spark):
    docs = spark.createDataFrame([(json.dumps(DOCUMENT),), ("broken",), ("{}",)], "body string")
    versions = registry.package_versions(docs)
    rows = {r["version"]: r for r in versions.drop("manifest").collect()}
    assert set(rows) == {"1.0.0", "2.0.0"}
    one, two = rows["1.0.0"], rows["2.0.0"]
    assert (one["repository_url"], one["license"], one["is_cli"], one["is_latest"]) == ("r", "ISC", True, False)
    assert (two["repository_url"], two["publisher"], two["provenance_id"]) == ("https://github.com/o/r", "u", "oidc")
    assert (two["file_count"], two["is_cli"], two["is_latest"], two["published_at"]) == (7, False, True, "2020")
    assert two["maintainers"][0]["name"] == "m"
    deps = {(r["name"], r["spec"], r["kind"]) for r in registry.dependencies(versions).collect()}
    assert deps == {("a", "1", "direct"), ("b", None, "direct"), ("c", "*", "optional")}
    commands = {(r["name"], r["command"]) for r in registry.scripts(versions).collect()}
    assert commands == {("install", "x"), ("test", None)}


def test_documents_from_files_and_report_metadata(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(DOCUMENT, indent=2))
    (tmp_path / "bad.json").write_text("{")
    docs = files.read_documents(spark, str(tmp_path))
    assert docs.count() == 2
    described = report.describe(registry.package_versions(docs)).filter("version = '2.0.0'").first()
    assert (described["size_label"], described["license"]) == ("11.2 KB", "MIT")


def test_manifests(spark):
    bodies = [
        {"name": "p", "version": "1", "author": "Ann", "bin": "", "scripts": {"install": "x"}},
        {"author": {"name": "Bob"}, "license": {"type": "ISC"}, "bin": None},
    ]
    frame = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("no",)], "body string")
    versions = registry.manifest_versions(frame)
    rows = {r["pkg"]: r for r in versions.drop("manifest").collect()}
    assert set(rows) == {"p", "unknown"}
    assert (rows["p"]["publisher"], rows["p"]["is_cli"]) == ("Ann", True)
    other = rows["unknown"]
    assert (other["publisher"], other["license"], other["version"], other["is_cli"]) == ("Bob", "ISC", "0.0.0", False)
    assert registry.scripts(versions).first()["command"] == "x"


def test_resolution(spark):
    docs = spark.createDataFrame([(json.dumps(DOCUMENT),), ('{"name":"bare"}',)], "body string")
    targets = ["p", "p@1.0.0", "p@^1.0.0", "p@latest", "p@", "q", "bare", "bare@1", "./x.tgz"]
    frame = spark.createDataFrame(list(enumerate(targets)), "id int, target string")
    rows = registry.resolve_targets(frame, registry.index_documents(docs)).collect()
    found = {targets[r["id"]]: (r["version"], r["error"]) for r in rows}
    assert found == {
        "p": ("2.0.0", None), "p@": ("2.0.0", None), "p@1.0.0": ("1.0.0", None),
        "p@^1.0.0": (None, "Version ^1.0.0 not found for p. Recent versions: 1.0.0, 2.0.0"),
        "p@latest": (None, "Version latest not found for p. Recent versions: 1.0.0, 2.0.0"),
        "q": (None, "Package not found: q"),
        "bare": (None, "Cannot determine version for bare: no dist-tags.latest found"),
        "bare@1": (None, "No versions found in packument for bare"),
    }


def test_repository_links(spark):
    links = {
        "https://github.com/o/r": ("o", "r"), "https://github.com/o/r.git": ("o", "r"),
        "git+https://github.com/o/r.git": ("o", "r"), "git://github.com/o/r.git": ("o", "r"),
        "git+ssh://git@github.com/o/r.git": ("o", "r"), "github:o/r": ("o", "r"),
        " https://github.com/o/r/tree/main// ": ("o", "r"), "https://github.com/o": (None, None),
        "https://gitlab.com/o/r": (None, None), "git@github.com:o/r.git": (None, None),
        "https://evil.com/github.com/o/r": (None, None), "": (None, None), "github:o": (None, None),
    }
    frame = spark.createDataFrame([(u,) for u in links], "u string")
    owner, repo = urls.github_repository(F.col("u"))
    assert {r[0]: (r[1], r[2]) for r in frame.select("u", owner, repo).collect()} == links


def test_specifiers(spark):
    cases = {
        "a": ("a", None, False), "a@1": ("a", "1", True), "a@latest": ("a", "latest", False),
        "@s/n": ("@s/n", None, False), "@s/n@1.2.3": ("@s/n", "1.2.3", True), "a@": ("a", "", False),
        "a@^2.0.0": ("a", "^2.0.0", True), "@s/n@next": ("@s/n", "next", False),
    }
    frame = spark.createDataFrame([(c,) for c in cases], "s string")
    name, version = urls.split_specifier(F.col("s"))
    rows = frame.select("s", name, version, urls.is_pinned(F.col("s"))).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == cases


def test_size_labels(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 11469: "11.2 KB", 5 << 20: "5.0 MB", 3 << 40: "3072.0 GB"}
    frame = spark.createDataFrame([(c,) for c in cases], "n long")
    assert {r[0]: r[1] for r in frame.select("n", tx.size_label(F.col("n"))).collect()} == cases


def test_diff(make_files, by_package):
    published = make_files(
        {
            "p": {
                "same.js": "a", "changed.js": "a", "package.json": "1", "dist/x.js": "a", "twin.js": "a",
                "deep/twin2.mjs": "a", "types.d.ts": "a", "a.js.map": "a", "CHANGELOG.md": "a", "evil.js": "a",
                ".hidden/x.js": "a", "node_modules/y.js": "a", ".npmrc": "a", "not_node_modules/z.js": "a",
                "src/only-src.js": "a",
            }
        }
    )
    source = make_files(
        {"p": {"same.js": "a", "changed.js": "b", "package.json": "2", "twin.ts": "a", "src/deep/twin2.ts": "a",
               "only-src.ts": "a"}}
    )
    compared = diff.match(diff.fingerprints(published), diff.fingerprints(source))
    found = {r["path"]: r["class"] for r in compared.collect() if r["ours"]}
    assert found == {
        "same.js": "same", "changed.js": "modified", "package.json": "same", "dist/x.js": "expected_build",
        "twin.js": "expected_build", "deep/twin2.mjs": "expected_build", "types.d.ts": "expected_build",
        "a.js.map": "expected_build", "CHANGELOG.md": "expected_build", "evil.js": "unexpected",
        ".npmrc": "unexpected", "not_node_modules/z.js": "unexpected", "src/only-src.js": "unexpected",
    }
    row = diff.rollup(compared).first()
    assert (row["n_unexpected"], row["n_expected_build"], row["n_modified"]) == (4, 6, 1)
    alone = diff.match(diff.fingerprints(published), diff.fingerprints(source.limit(0)))
    row = diff.score_rollup(diff.rollup(alone)).first()
    assert (row["performed"], row["diff_points"]) == (False, 0.0)


def test_source_archive_root_is_dropped_before_the_filter(make_files):
    tree = make_files({"one": {".repo-1/a.js": "x", ".repo-1/.git/b": "x"}})
    assert [r["path"] for r in diff.fingerprints(tree, single_root=True).collect()] == ["a.js"]


def test_source_roots(make_files):
    trees = make_files({"one": {"r-1/a.js": "", "r-1/b/c.js": "", "top.txt": ""}, "two": {"a/x": "", "b/y": ""}})
    rows = diff.strip_single_root(trees).collect()
    assert {(r["pkg"], r["path"]) for r in rows} == {
        ("one", "a.js"), ("one", "b/c.js"), ("two", "a/x"), ("two", "b/y"),
    }


def test_a_comparison_without_a_source_lists_nothing(make_files):
    published = diff.fingerprints(make_files({"p": {"a.js": "1", "b.js": "2"}, "q": {"a.js": "1", "b.js": "2"}}))
    matched = diff.match(published, diff.fingerprints(make_files({"p": {"a.js": "1"}})))
    assert [(r["pkg"], r["path"], r["class"]) for r in diff.classes(matched).collect()] == [("p", "b.js", "unexpected")]
    performed = {r["pkg"]: r["performed"] for r in diff.rollup(matched).collect()}
    assert performed == {"p": True, "q": False}


def test_a_path_listed_twice_keeps_one_whole_hash(spark):
    rows = [("p", "1", "a.js", f"{i:064x}"[::-1]) for i in (7, 0xABCDEF, 1 << 200)]
    both = spark.createDataFrame(rows, "pkg string, version string, path string, sha256 string")
    for one in rows:
        source = spark.createDataFrame([one], both.schema)
        found = diff.match(both, source).collect()
        assert len(found) == 1 and found[0]["class"] in ("same", "modified")
    same = [diff.match(both, spark.createDataFrame([r], both.schema)).first()["class"] for r in rows]
    assert sorted(same) == ["modified", "modified", "same"]


def test_health_answers_to_the_name_it_was_asked_under(spark):
    from parcelwatch.operators import repository

    links = spark.createDataFrame(
        [("p", "1", "https://github.com/Old/Name", "old"), ("q", "1", "https://github.com/a/b", "a")],
        "pkg string, version string, repository_url string, publisher string",
    )
    health = spark.createDataFrame(
        [("new/name", "old/name", 5), ("A/b", None, 3), ("a/B", "a/b", 3)], "full_name string, requested string, stars long"
    )
    found = {r["pkg"]: (r["found"], r["full_name"].lower(), r["stars"]) for r in repository.link_health(links, health).collect()}
    assert found == {"p": (True, "new/name", 5), "q": (True, "a/b", 3)}
    assert repository.link_health(links, health).count() == 2


def test_damaged_archives_are_named(spark):
    import io
    import tarfile

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        entry = tarfile.TarInfo("package/a.js")
        entry.size = 100_000
        tar.addfile(entry, io.BytesIO(bytes(range(250)) * 400))
    whole = buffer.getvalue()
    rows = [("good", "1", whole), ("cut", "1", whole[: len(whole) // 2]), ("none", "1", b""), ("junk", "1", b"x" * 600)]
    frame = spark.createDataFrame([(p, v, bytearray(c)) for p, v, c in rows], "pkg string, version string, content binary")
    assert {r["pkg"] for r in archives.damaged_archives(frame).collect()} == {"cut", "none", "junk"}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from parcelwatch.plans.scratch import scratch_dir

    def session(master, folder):
        conf = SimpleNamespace(get=lambda name, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert scratch_dir(session("spark://host:1", "hdfs://x/shared")).startswith("hdfs://x/shared/")
    with pytest.raises(ValueError):
        scratch_dir(session("spark://host:1", None))


def test_binaries_are_compared_by_their_bytes(spark):
    def packed(data):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            entry = tarfile.TarInfo("package/lib.node")
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
        frame = [("p", "1", bytearray(buffer.getvalue()))]
        return archives.expand_archives(spark.createDataFrame(frame, "pkg string, version string, content binary"))

    ours, theirs = packed(b"\xff\xfe\xfd"), packed(b"\xff\xfe\xfc")
    assert ours.first()["content"] == theirs.first()["content"]
    found = diff.match(diff.fingerprints(ours), diff.fingerprints(theirs)).first()
    assert found["class"] == "modified"


def test_batches_of_archives_end_at_a_number_of_bytes(spark):
    """However many rows a frame has, Python holds one batch of limited bytes on top of it."""
    layout = pa.schema([("pkg", pa.string()), ("content", pa.binary())])
    rows = [(f"p{i}", b"x" * 1000) for i in range(500)] + [("none", None)]
    batches = list(archives.bounded(rows, layout, limit=20_000))
    assert max(b.nbytes for b in batches) < 30_000 and len(batches) > 20
    assert list(archives.values(batches)) == rows
    assert list(archives.bounded([], layout)) == []


def test_releases_are_packed_from_a_stream_of_their_files(spark):
    rows = [(f"p{i % 7}", "1.0.0" if i % 2 else None, f"f{i:03d}", "x" * i) for i in range(300)]
    rows += [("p1", "1.0.0", "f001", "again")]  # a path that comes twice
    frame = spark.createDataFrame(rows, "pkg string, version string, path string, content string").repartition(5)
    packed = corpus.pack_releases(frame)
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().toString()  # no task holds a release
    assert packed.count() == packed.select("pkg", "version").distinct().count() == 14
    got = archives.expand_archives(packed).select("pkg", "version", "path", "content").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r["path"] for r in got if (r["pkg"], r["version"]) == key]
        assert mine == sorted(mine)
