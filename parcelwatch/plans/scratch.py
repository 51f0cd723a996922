"""Where intermediate tables and stream progress go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one the cluster names.

    Without a name only a local session, whose executors live in the driver, gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='run-')}/{uuid.uuid4().hex}"
