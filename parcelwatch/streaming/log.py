"""Tables that a stream adds to batch by batch, kept outside the stream's own state.

Every batch owns a directory, which a retry overwrites: what a batch reads are the batches before it,
so running one again gives the same.  Now and then the batches so far are merged into one snapshot, and
later readers need that and the batches after it.  Directories follow from batch numbers, which a
stream counts without gaps, so nothing is ever listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def by_keys(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by sorted keys, whatever size Spark takes them for.

    It takes the size of compressed files for that of the rows in them, and what is derived from such
    estimates for no more.  Keys and flags of releases shrink to a twentieth and less in files, so a table
    far too large for it would be sent to every task, by way of the driver's memory.
    """
    return rows.hint("merge")


class BatchLog:
    """``merge`` brings the rows of several batches together; without it they are only stacked."""

    def __init__(
        self, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 16
    ) -> None:
        self.path, self.schema, self.every = path, schema, every
        self.merge = merge or (lambda rows: rows)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """All rows of the batches before ``batch_id``, merged."""
        last = batch_id // self.every * self.every
        paths = [f"{self.path}/snapshot/before={last}"] if last else []
        paths += [f"{self.path}/delta/batch={i}" for i in range(last, batch_id)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*paths)
        return self.merge(rows) if len(paths) > 1 else rows

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches so far as they were added; for readers outside the stream."""
        return spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/delta")

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write the rows of a batch and, where it is due, a snapshot; returns the rows as written."""
        spark, path = rows.sparkSession, f"{self.path}/delta/batch={batch_id}"
        self._write(rows, path)
        if (batch_id + 1) % self.every == 0:
            last = batch_id + 1 - self.every
            parts = [f"{self.path}/delta/batch={i}" for i in range(last, batch_id + 1)]
            parts += [f"{self.path}/snapshot/before={last}"] if last else []
            merged = self.merge(spark.read.schema(self.schema).parquet(*parts))
            self._write(merged, f"{self.path}/snapshot/before={batch_id + 1}")
        return spark.read.schema(self.schema).parquet(path)

    def _write(self, rows: DataFrame, path: str) -> None:
        wanted = [f.name for f in StructType.fromDDL(self.schema)]
        rows.select(*wanted).write.mode("overwrite").parquet(path)
