"""Files that cannot be reviewed as source: native add-ons, libraries, executables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from .hits import as_findings

SCANNER = "binaries"


def scan_binaries(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Reads paths only: contents are never fetched from storage."""
    path = F.col("path")
    ext = F.lower(tx.extension(path))
    return as_findings(
        files.filter(tx.is_binary_file(path)).select(
            "pkg",
            "version",
            F.lit(SCANNER).alias("scanner"),
            F.lit(rules.WARNING).alias("severity"),
            F.substr(ext, F.lit(2)).alias("rule_id"),
            F.concat(
                F.lit("Binary file found: "), ext, F.lit(" (cannot be source-reviewed)")
            ).alias("message"),
            path.alias("file"),
            tx.basename(path).alias("evidence"),
            *carry,
        ),
        carry,
    )


def summarize(findings: DataFrame) -> DataFrame:
    """``pkg, version, n_files, summary`` with a count per extension, extensions in order."""
    by_ext = findings.groupBy("pkg", "version", "rule_id").count()
    part = F.struct("rule_id", "count")
    listed = F.transform(
        F.array_sort(F.collect_list(part)),  # at most one entry per known extension
        lambda p: F.concat(p["count"].cast("string"), F.lit(" ."), p["rule_id"]),
    )
    return by_ext.groupBy("pkg", "version").agg(
        F.sum("count").alias("n_files"),
        F.concat(
            F.sum("count").cast("string"), F.lit(" binary file(s): "), F.array_join(listed, ", ")
        ).alias("summary"),
    )
