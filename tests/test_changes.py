import itertools

from pyspark.sql import functions as F

from parcelwatch.sources import changes

CHANGES = [
    ("a", 1, False, "a1"), ("a", 4, False, "a4"), ("a", 3, True, None),
    ("b", 2, False, "b2"), ("b", 5, True, None),
    ("c", 6, True, None), ("c", 7, False, "c7"),
    ("d", 8, None, "d8"), ("e", 9, True, "left over"),
]
LAST = {("a", 4, False, "a4"), ("b", 5, True, None), ("c", 7, False, "c7"), ("d", 8, False, "d8"), ("e", 9, True, None)}


def _rows(df):
    return [tuple(r[c] for c in changes.COLUMNS) for r in df.collect()]


def _frame(spark, rows):
    return spark.createDataFrame(rows, changes.SCHEMA)


def test_latest(spark):
    got = _rows(changes.latest(_frame(spark, CHANGES + CHANGES[:4])))
    assert len(got) == len(LAST) and set(got) == LAST
    assert {r["id"] for r in changes.current(changes.latest(_frame(spark, CHANGES))).collect()} == {"a", "c", "d"}


def test_any_order_of_deltas(spark, tmp_path):
    deltas = [CHANGES[0::3], CHANGES[1::3] + CHANGES[:2], CHANGES[2::3]]
    for nth, order in enumerate(itertools.permutations(deltas)):
        path = f"{tmp_path}/{nth}"
        for number, delta in enumerate(order):
            snapshot = changes.write_version(spark, path, _frame(spark, delta), number + 1)
        assert set(_rows(snapshot)) == LAST
    again = changes.write_version(spark, path, _frame(spark, deltas[0]), 3)
    assert changes.read_version(spark, path, 1).count() and set(_rows(again)) <= set(CHANGES) | LAST


def test_one_number_twice(spark):
    rows = [("a", 1, False, "z"), ("a", 1, False, "b"), ("b", 1, False, "x"), ("b", 1, True, None)]
    assert set(_rows(changes.latest(_frame(spark, rows)))) == {("a", 1, False, "b"), ("b", 1, True, None)}


def test_nulls_and_nothing(spark):
    rows = [(None, 1, False, "x"), ("a", None, False, "x"), ("a", 1, False, None)]
    assert _rows(changes.latest(_frame(spark, rows))) == [("a", 1, False, None)]
    assert _rows(changes.latest(_frame(spark, []))) == []


def test_other_columns(spark):
    wide = _frame(spark, CHANGES).withColumns({"_state": F.lit(1), "alive": F.lit(2)})
    assert set(_rows(changes.applied(_frame(spark, []), wide))) == LAST


def test_stream(spark, tmp_path):
    for number in range(3):
        _frame(spark, CHANGES[number::3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes.follow(stream, f"{tmp_path}/out", f"{tmp_path}/progress", availableNow=True).awaitTermination()
    assert set(_rows(changes.read_version(spark, f"{tmp_path}/out", 3))) == LAST
