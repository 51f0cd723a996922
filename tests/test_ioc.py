import base64

import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import ioc
from parcelwatch.plans.scan import scan_hits, scan_ioc

URL = "https://drop.nightdock.xyz/parcel?k=2"


def _escape(text, form):
    return "".join(form.format(ord(c)) for c in text)


CASES = {
    "url": {"a.js": f'const u = "{URL}";'},
    "path-dots": {"a.js": "get('https://cdn.greycrate.cc/v9/tool.exe')"},
    "ftp": {"a.txt": "ftp://files.bad.net/x."},
    "ip": {"a.js": "const ip = '46.17.40.9';"},
    "ignored-ips": {"a.js": "127.0.0.1 0.0.0.0 10.0.0.1 192.168.0.1 255.255.255.255"},
    "ignored": {"a.js": "https://github.com/x https://api.github.com/y http://localhost:80/z"},
    "lookalike": {"a.js": "https://notgithub.com/x"},
    "twice": {"a.js": f"'{URL}'", "b.js": f"'{URL.upper().replace('HTTPS', 'https')}'"},
    "many": {"a.js": "\n".join([f"'{URL}'"] * 9)},
    "hex": {"a.js": '"' + _escape("https://q7.stowage.cc/a", "\\x{:02x}") + '"'},
    "unicode": {"a.js": '"' + _escape("https://q7.stowage.cc/a", "\\u{:04x}") + '"'},
    "charcode": {
        "a.js": "string.FROMCHARCODE( " + ", ".join(str(ord(c)) for c in "http://q7.stowage.cc") + ")"
    },
    "base64": {"a.js": 'atob("' + base64.b64encode(b"https://q7.stowage.cc/load").decode() + '")'},
    "binary-base64": {"a.js": '"' + base64.b64encode(bytes(range(128, 170))).decode() + '"'},
    "bad-codes": {"a.js": "String.fromCharCode(104,116,,116,112)"},
    "surrogate": {"a.js": r'"\ud83d' + _escape("1.2.3.4", "\\u{:04x}") + '"'},
    "plain-first": {"a.js": "'https://q7.stowage.cc/a'\n'" + _escape("https://q7.stowage.cc/a", "\\x{:02x}") + "'"},
    "decoded-first": {"a.js": "'" + _escape("https://q7.stowage.cc/a", "\\x{:02x}") + "'\n'https://q7.stowage.cc/a'"},
    "five-parts": {"a.js": "1.2.3.4.5 256.1.1.1 v1.2.3"},
    "credentials": {"a.js": "https://user:pw@github.com/x https://github.com@stowage.cc/x"},
    "wrong-type": {"a.png": f"'{URL}'", "node_modules/a.js": f"'{URL}'"},
    "upper-ext": {"README.MD": URL},
    "test-file": {"test/a.test.js": f"'{URL}'"},
}


@pytest.fixture(scope="module")
def found(make_files, by_package):
    return by_package(scan_ioc(make_files(CASES)))


def one(found, pkg):
    assert len(found[pkg]) == 1, found.get(pkg)
    return found[pkg][0]


def test_plain(found):
    row = one(found, "url")
    assert row["message"] == "External URL: hxxps[://]drop[.]nightdock[.]xyz/parcel?k=2"
    assert (row["severity"], row["file"], row["line"], row["evidence"]) == ("info", "a.js", 1, None)
    assert one(found, "path-dots")["message"].endswith("cdn[.]greycrate[.]cc/v9/tool.exe")
    assert one(found, "ftp")["message"] == "External URL: fxp[://]files[.]bad[.]net/x"
    assert one(found, "ip")["message"] == "External IP: 46[.]17[.]40[.]9"


def test_ignored(found):
    for pkg in ("ignored", "ignored-ips", "wrong-type", "binary-base64", "bad-codes"):
        assert pkg not in found, pkg
    assert one(found, "lookalike")
    assert one(found, "credentials")["message"].endswith("github[.]com@stowage[.]cc/x")


def test_file_types(found):
    assert one(found, "upper-ext") and one(found, "test-file")


def test_distinct_and_capped(found):
    row = one(found, "twice")
    assert row["evidence"] == "Found in 2 location(s)" and row["file"] == "a.js"
    assert one(found, "many")["evidence"] == "Found in 5 location(s)"


@pytest.mark.parametrize("method", ["hex", "unicode", "charcode", "base64"])
def test_decoded(found, method):
    row = one(found, method)
    assert row["severity"] == "warning"
    assert row["message"].startswith(f"URL ({method}-decoded): hxxp")
    assert row["evidence"] == f"Decoded from {method} obfuscation"


def test_first_sighting_decides(found):
    assert one(found, "plain-first")["severity"] == "info"
    assert one(found, "decoded-first")["severity"] == "warning"


def test_addresses(found):
    assert [r["message"] for r in found["five-parts"]] == ["External IP: 1[.]2[.]3[.]4"]
    assert one(found, "surrogate")["message"] == "IP (unicode-decoded): 1[.]2[.]3[.]4"


def test_rank_limit_applies_before_the_shuffle(make_files):
    plan = ioc.locations(ioc.sightings(scan_hits(make_files(CASES), ("ioc",))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_counts(make_files):
    rows = ioc.distinct_counts(ioc.sightings(scan_hits(make_files(CASES), ("ioc",)))).filter(F.col("pkg") == "many")
    assert [(r["n_urls"], r["n_ips"]) for r in rows.collect()] == [(1, 0)]


def _hosts_left(spark, make_files, domains):
    files = make_files({"p": {"a.js": "\n".join(
        f"'https://{h}/x'" for h in ("a.bad.cc", "bad.cc", "notbad.cc", "u:p@x.y.bad.cc:8080", "BAD.cc", "ok.io")
    ) + "\n'46.17.40.9'"}})
    seen = ioc.sightings(scan_hits(files, ("ioc",)))
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    left = ioc.without_hosts(seen, listed)
    assert left.columns == seen.columns
    return sorted(r["raw"] for r in left.collect()), seen.count()


def test_own_list_of_domains(spark, make_files):
    left, _ = _hosts_left(spark, make_files, ["Bad.cc", "bad.cc", "", None, "cc.", "io.ok"])
    assert left == ["46.17.40.9", "https://notbad.cc/x", "https://ok.io/x"]


@pytest.mark.parametrize("domains", [[], ["", None]])
def test_empty_list_of_domains(spark, make_files, domains):
    left, n = _hosts_left(spark, make_files, domains)
    assert len(left) == n == 7


def test_long_list_is_not_broadcast(spark, make_files):
    """Without broadcasts the same rows come out."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, _ = _hosts_left(spark, make_files, ["bad.cc"] + [f"d{i}.example" for i in range(2000)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == ["46.17.40.9", "https://notbad.cc/x", "https://ok.io/x"]
