"""Helpers shared by the operators: inputs, written intermediate tables, row identity."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only a local session, whose executors live in the driver, may do without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="llm-"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at its end.

    Results are lazy and read them: write a result to be kept with ``lasting=True``, or count or collect
    it, before the end.  Contexts may be nested; each deletes its own.
    """
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives executors, has a known size.

    It stays there, unless written inside :func:`passing_tables` and not ``lasting``.
    """
    path, passing = shared_dir(df.sparkSession), _PASSING.get()
    if passing is not None and not lasting:
        passing.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` alone, a null text as an empty one; other columns can't clash with ours."""
    return df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text")
    )


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls match: an equi-join key for Spark."""
    return left.eqNullSafe(right)
