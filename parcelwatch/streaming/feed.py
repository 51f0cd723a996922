"""Scanning files as they are published.

Content rules look at one file at a time, so findings leave each micro-batch as soon as its files
are read.  A release is scored once all files its manifest announces have arrived; what is kept
between batches is one row of counts per release, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import binaries, scoring, static_rules
from ..operators.hits import as_findings
from ..plans.scan import CONTENT_SCANNERS, scan_contents

#: Scanners that need nothing but the files.
FILE_SCANNERS = (*CONTENT_SCANNERS, "binaries")


def file_findings(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Findings of all single-file scanners; the same on a stream and on a table."""
    return scan_contents(files, carry=carry).unionByName(binaries.scan_binaries(files, carry))


def write_findings(
    files: DataFrame, flags: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append findings of a stream of package files to a Parquet table."""
    found = as_findings(static_rules.relax_for_cli_tools(file_findings(files), flags))
    return (
        found.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(path)
    )


def running_totals(files: DataFrame, max_delay: str | None = None) -> DataFrame:
    """Files received and additive facts per release, updated batch by batch.

    With ``max_delay`` the files carry the ``published_at`` time of their release, and a release is
    forgotten that long after the latest publication seen; without it every release is remembered.
    """
    carry: tuple[str, ...] = ()
    if max_delay is not None:
        files, carry = files.withWatermark("published_at", max_delay), ("published_at",)
    receipts = files.select("pkg", "version", *carry, F.lit(None).cast("string").alias("scanner"))
    arrived = scoring.run_rows(receipts, carry)
    found = scoring.finding_rows(file_findings(files, carry), carry=carry)
    return (
        arrived.unionByName(found)
        .groupBy("pkg", "version", *carry)
        .agg(F.count_if("ran").alias("n_files"), *scoring.total_columns())
    )


def score_complete(
    totals: DataFrame, releases: DataFrame, others: DataFrame | None = None
) -> DataFrame:
    """Scores of the releases whose last file has arrived.

    ``releases(pkg, version, file_count, is_cli)`` comes from the registry documents.  ``others`` are
    the totals (:func:`scoring.totals`) of what needs no files: manifests, names, repositories and
    comparisons.  Without them the scores are points of a partial run, without a grade.
    """
    done = totals.drop("is_cli").join(
        releases.select("pkg", "version", F.col("file_count").alias("n_files"), "is_cli"),
        ["pkg", "version", "n_files"],
    )
    ran = {f"ran_{s}": F.lit(s in FILE_SCANNERS) for s in scoring.WEIGHTED}
    arrived = done.withColumns({**ran, "any_run": F.lit(True)})
    if others is None:
        return scoring.score_totals(arrived)
    key = ["pkg", "version"]
    rest = others.join(arrived.select(*key), key, "left_semi")
    summed = scoring.merge_totals(arrived.select(*others.columns), rest)
    return scoring.score_totals(scoring.only_found(summed))


def write_scores(
    files: DataFrame,
    releases: DataFrame,
    path: str,
    checkpoint: str,
    max_delay: str | None = None,
    others: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Write the scores of releases as they become complete (see :func:`running_totals`).

    Each batch owns a directory that a retry overwrites, so a restart neither loses nor repeats
    scores.
    """

    def finish(batch: DataFrame, batch_id: int) -> None:
        score_complete(batch, releases, others).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        running_totals(files, max_delay)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(finish)
        .trigger(**trigger)
        .start()
    )
