"""Files and small lists from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_package_tree(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<pkg>/<version>/<path>`` (or ``<root>/@scope/<pkg>/...``) as package files.

    Unreadable files are skipped; bytes that are not UTF-8 become replacement characters.  ``sha256``
    is that of the bytes as they are.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .load(root)
    )
    # Paths come back as URIs, so the root may have gained a scheme in front.
    marker = "/" + root.strip("/") + "/"
    inside = F.substr("path", F.locate(marker, F.col("path")) + F.lit(len(marker)))
    layout = r"(?s)\A((?:@[^/]+/)?[^/]+)/([^/]+)/(.+)\z"
    return raw.select(
        *[
            F.regexp_extract(inside, layout, group).alias(name)
            for group, name in ((1, "pkg"), (2, "version"), (3, "path"))
        ],
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.sha2("content", 256).alias("sha256"),
    ).filter(F.col("pkg") != "")


def read_popular(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names as ``popular(name, ord)``, in list order."""
    body = spark.read.text(path, wholetext=True)
    names = F.from_json("value", "array<string>")
    return body.select(F.posexplode(names).alias("ord", "name")).select(
        "name", F.col("ord").cast("bigint").alias("ord")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as ``file, body``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


#: Fields of a hosting-service record that are used.
HEALTH_FIELDS = (
    "full_name string, stargazers_count bigint, forks_count bigint, open_issues_count bigint,"
    " license struct<spdx_id: string>, created_at string, pushed_at string, archived boolean"
)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """Repository records as returned by the hosting service, one JSON object per line."""
    return health_records(spark.read.schema(HEALTH_FIELDS).json(path))


def health_records(raw: DataFrame) -> DataFrame:
    """Hosting-service records to ``repo_health``; a date that does not parse is null.

    A record without a name keeps the one it was ``requested`` under, where that is known.
    """

    def or_zero(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    asked = [F.col("requested")] if "requested" in raw.columns else []
    name = F.coalesce("full_name", *asked)
    return raw.filter(name.isNotNull()).select(
        name.alias("full_name"),
        *asked,
        or_zero("stargazers_count").alias("stars"),
        or_zero("forks_count").alias("forks"),
        or_zero("open_issues_count").alias("open_issues"),
        F.coalesce("license.spdx_id", F.lit("")).alias("license"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.try_to_timestamp("pushed_at").alias("last_push"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
    )
