"""Network indicators of a stream of files: distinct ones, their first sighting, five locations.

What must be known of an indicator is bounded: its first five sightings in reading order.  Every batch
adds its own first five, a rank limit that Spark applies before the shuffle, so an indicator that a batch
holds a million times sends five rows a task.  The first five of all batches are among these, whatever the
order in which files arrive, and a file delivered again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..operators import ioc
from ..plans.scan import scan_hits
from .log import BatchLog

_IDENTITY = ["pkg", "version", "type", "key"]
_ORDER = ["path", "line", "step", "fragment", "nth"]
SCHEMA = (
    "pkg string, version string, type string, key string, path string, line int, step int, fragment bigint, "
    "nth int, method string, raw string"
)


def first_sightings(seen: DataFrame) -> DataFrame:
    """The first five different sightings of each indicator; equal ones are one."""
    place = F.dense_rank().over(Window.partitionBy(*_IDENTITY).orderBy(*_ORDER))
    first = seen.withColumn("place", place).filter(F.col("place") <= rules.MAX_LOCATIONS)
    return first.drop("place").dropDuplicates([*_IDENTITY, *_ORDER])


def sighting_log(path: str, every: int = 16) -> BatchLog:
    return BatchLog(path, SCHEMA, first_sightings, every)


def add_sightings(log: BatchLog, hits: DataFrame, batch_id: int) -> None:
    """Add the indicators among the hits of a batch of package files (:func:`scan_hits`)."""
    seen = ioc.sightings(hits).select(*_IDENTITY, *_ORDER, "method", "raw")
    log.append(first_sightings(seen), batch_id)


def write_indicators(
    files: DataFrame, path: str, checkpoint: str, every: int = 16, **trigger
) -> StreamingQuery:
    """Keep the indicators of a stream of package files in the log at ``path``."""
    log = sighting_log(path, every)
    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: add_sightings(log, scan_hits(batch, (ioc.SCANNER,)), batch_id))
        .trigger(**trigger)
        .start()
    )


def indicator_findings(spark: SparkSession, log: BatchLog) -> DataFrame:
    """Findings over all batches so far; the same as those of one scan over all files."""
    return ioc.findings(ioc.indicators(log.merge(log.rows(spark))))
