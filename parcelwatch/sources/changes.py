"""The registry's change feed: numbered changes of documents, applied to versioned snapshots.

A change is ``id, seq, deleted, body``.  What counts is the greatest ``seq`` of an id, whatever the order
in which changes arrive and however often; a deletion is kept as such, so that an older change which
arrives later does not bring a document back.  Applying is therefore the same in any split into deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, seq bigint, deleted boolean, body string"
COLUMNS = ("id", "seq", "deleted", "body")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every id; changes without an id or a number are left out.

    Bodies are not aggregated over all changes: the last number of an id is found on narrow rows, and
    changes meet it by id and number, so one id with a third of all changes is spread by number.  Of
    different changes with one number a deletion counts, then the body that sorts first.
    """
    known = changes.select(*COLUMNS).filter("id IS NOT NULL AND seq IS NOT NULL")
    last = known.groupBy("id").agg(F.max("seq").alias("seq"))
    gone = F.coalesce("deleted", F.lit(False))
    body = F.when(~gone, F.col("body"))
    met = known.join(last, ["id", "seq"], "left_semi").select(
        "id", "seq", F.struct((~gone).alias("alive"), body.alias("body")).alias("_state")
    )
    chosen = met.groupBy("id", "seq").agg(F.min("_state").alias("_state"))
    return chosen.select("id", "seq", (~F.col("_state.alive")).alias("deleted"), "_state.body")


def applied(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after the changes, deletions included."""
    return latest(snapshot.select(*COLUMNS).unionByName(changes.select(*COLUMNS)))


def current(snapshot: DataFrame) -> DataFrame:
    """Documents that exist, as ``registry`` reads them: ``body``."""
    return snapshot.filter(~F.col("deleted")).select("id", "body")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Snapshot ``version`` under ``path``; version 0 is empty."""
    if version == 0:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={version}")


def write_version(spark: SparkSession, path: str, changes: DataFrame, version: int) -> DataFrame:
    """Apply ``changes`` to snapshot ``version - 1`` and write ``version``, again if it is there.

    Older versions stay as they are, so a run that was cut off is simply made once more.
    """
    after = applied(read_version(spark, path, version - 1), changes)
    after.write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_version(spark, path, version)


def follow(stream: DataFrame, path: str, progress: str, **trigger):
    """Write a version for every batch of a stream of changes; the batch's number decides the version."""

    def batch(changes: DataFrame, number: int) -> None:
        write_version(changes.sparkSession, path, changes, number + 1)

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", progress)
        .trigger(**trigger)
        .start()
    )
