"""What streams and reports are built from is read and derived once."""

import pytest
from pyspark.sql import functions as F

from parcelwatch.plans import queries
from parcelwatch.sources import corpus

TABLES = {
    "documents": """SELECT id AS doc_id, 'eval(x);' AS text, 'en' AS lang, 's' AS source, 8 AS n_chars FROM range(32)""",
    "customer": """SELECT id AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, 0D AS c_acctbal, 'm' AS c_mktsegment FROM range(40)""",
    "part": """SELECT id AS p_partkey, concat('left pad ', id % 3) AS p_name FROM range(40)""",
    # Orders of owners with and without a release, of nobody, and two of one owner for the same part.
    "orders": """SELECT id AS o_orderkey, CASE WHEN id % 10 <> 9 THEN id % 40 END AS o_custkey,
 TIMESTAMP '2020-01-01 00:00:00' AS o_orderdate FROM range(200)""",
    "lineitem": """SELECT id % 201 AS l_orderkey, CASE WHEN id % 7 <> 6 THEN id % 97 END AS l_partkey,
 CAST(id % 4 AS INT) AS l_linenumber FROM range(2000)""",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    for name, text in TABLES.items():
        spark.sql(text).write.parquet(f"{base}/{name}.parquet")
    return base


def test_only_orders_of_owners_go_into_the_dependencies_of_releases(spark, tables):
    orders = corpus._bases(spark, tables, "release_dependency")["orders"]
    assert {r["o_custkey"] for r in orders.collect()} == {0, 1, 2, 3}  # of 40 owners, four have releases
    every = {n: corpus.table(spark, tables, n) for n in ("documents", "orders", "lineitem")}
    want = sorted(map(repr, corpus.planted(spark, "release_dependency", every).collect()))
    assert want and sorted(map(repr, corpus.view(spark, tables, "release_dependency").collect())) == want
    release = corpus.view(spark, tables, "release")
    found = corpus.view(spark, tables, "release_dependency", {"release": release.filter("version = '1.9.0'")})
    assert sorted(map(repr, found.collect())) == [r for r in want if "1.9.0" in r]
    assert corpus.view(spark, tables, "release_dependency", {"release": release.limit(0)}).isEmpty()


def test_a_score_derives_dependencies_and_links_once(spark, tables):
    scored = queries.package_scores(spark, tables)
    read = " ".join(scored.inputFiles())
    assert "/lineitem.parquet/" not in read and "/release_dependency/" in read and "/release_link/" in read
    assert scored.count() == 8


def test_rows_sent_again_come_from_one_read(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(50).selectExpr("concat('p', id % 5) AS pkg", "'1' AS version", "concat('f', id) AS path").write.parquet(path)
    rows = spark.read.parquet(path)
    sent = queries._sent(rows, F.col("pkg") == "p3")
    assert sent._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = rows.unionByName(rows.filter("pkg = 'p3'"))
    assert sent.columns == rows.columns and sorted(sent.collect()) == sorted(want.collect())
    queries._landed(sent, str(tmp_path / "landing"), queries._N_LANDED)
    landed = spark.read.parquet(str(tmp_path / "landing"))
    assert sorted(landed.collect()) == sorted(want.collect())
    assert len(landed.inputFiles()) > 6  # as many tasks read a batch


def test_comparison_of_a_report_is_read_where_it_was_written(spark, tmp_path):
    frame = spark.createDataFrame([("p", "1")], "pkg string, version string")
    kept = queries._written(spark, frame, str(tmp_path / "kept"))
    given = {"matched": kept, "linked": kept}
    assert queries._matched(spark, "/nowhere", given) is kept
    assert queries._release_links(spark, "/nowhere", given) is kept
    assert kept.schema == frame.schema and kept.collect() == frame.collect()
