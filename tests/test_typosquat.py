import random

import pytest
from pyspark.sql import functions as F

from parcelwatch.operators import typosquat

POPULAR = ["lodash", "express", "react", "chalk", "@types/node", "vue", "ms"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def popular(spark):
    return spark.createDataFrame(list(zip(POPULAR, range(len(POPULAR)))), "name string, ord int")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_similar(spark, popular):
    asked = names(spark, "chalk", "chalkk", "@evil/react", "lodahs", "Chalkk", "unrelated-thing")
    rows = typosquat.similar_names(asked, popular).collect()
    found = {(r["name"], r["popular_name"], r["distance"]) for r in rows}
    assert found == {("chalkk", "chalk", 1), ("Chalkk", "chalk", 1), ("lodahs", "lodash", 2)}


def test_summaries(spark, popular):
    asked = names(spark, "chalk", "mss", "far-away-name")
    told = {r["name"]: (r["passed"], r["summary"]) for r in typosquat.summarize(asked, popular).collect()}
    assert told["chalk"] == (True, '"chalk" is a known popular package')
    assert told["mss"] == (False, 'Similar to: "ms" (dist 1)')
    assert told["far-away-name"] == (True, "No similar popular package names")
    empty = popular.limit(0)
    assert typosquat.summarize(asked, empty).first()["summary"].startswith("Popular packages list")


def test_findings(spark, popular):
    releases = spark.createDataFrame(
        [("p", "1", "expres"), ("p", "2", "expres"), ("q", "1", "expressyy")],
        "pkg string, version string, name string",
    )
    rows = typosquat.scan_typosquatting(releases, popular).orderBy("pkg", "version").collect()
    assert [r["severity"] for r in rows] == ["critical", "critical", "warning"]


@pytest.mark.parametrize("length", [(0, 7), (26, 36)])
def test_pairs_match_brute_force(spark, length):
    """Both key schemes and the lengths where they meet, against all-pairs edit distance."""
    rng = random.Random(length[0])

    def word():
        return "".join(rng.choice("abc") for _ in range(rng.randint(*length)))

    def vary(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        return "".join(w)

    known = sorted({word() for _ in range(60)})
    asked = sorted({vary(rng.choice(known)) for _ in range(150)} | {word() for _ in range(30)})
    expected = {(a, b, edits(a, b)) for a in asked for b in known if edits(a, b) <= 2}
    left = spark.createDataFrame([(a,) for a in asked], "bare string")
    right = spark.createDataFrame([(b,) for b in known], "bare string")
    rows = typosquat.near_pairs(left, right).collect()
    assert {tuple(r) for r in rows} == expected
    assert len(rows) == len(expected)


def test_keys_stay_few_for_long_names(spark):
    long_names = names(spark, "a" * 100, "ab" * 107)
    sizes = long_names.select(
        F.size(typosquat._popular_keys(F.col("name"))), F.size(typosquat._candidate_keys(F.col("name")))
    ).collect()
    assert all(p == 3 and c <= 75 for p, c in sizes)
