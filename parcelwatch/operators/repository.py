"""Repository links, repository health and the points they earn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls


def parse_links(links: DataFrame) -> DataFrame:
    """Add ``owner`` and ``repo`` (null for anything but a GitHub link)."""
    owner, repo = urls.github_repository(F.col("repository_url"))
    return links.withColumns({"owner": owner, "repo": repo})


def link_health(links: DataFrame, health: DataFrame) -> DataFrame:
    """Health of each release's repository; ``found`` is false where there is none.

    ``links(pkg, version, repository_url, publisher, ...)`` and ``health(full_name, ...)``, which may
    say in ``requested`` under which name it was asked for: a renamed repository answers to its old
    name.  Of several records for a name, in whatever case, one counts.
    Releases without a usable link are set aside before the join: as nulls they would all land
    in one task.
    """
    parsed = parse_links(links)
    asked = F.coalesce("requested", "full_name") if "requested" in health.columns else F.col("full_name")
    record = F.struct(*[c for c in health.columns if c != "requested"])
    # The second key makes the join shuffle anew: after a grouping by the first alone, Spark could not
    # split a repository that very many releases share.
    by_name = (
        health.groupBy(F.lower(asked).alias("_repo")).agg(F.max(record).alias("_record"))
        .select("_repo", F.length("_repo").alias("_size"), "_record.*")
    )
    usable = F.col("owner").isNotNull() & F.col("repo").isNotNull()
    key = F.lower(F.concat_ws("/", "owner", "repo"))
    joined = (
        parsed.filter(usable)
        .withColumns({"_repo": key, "_size": F.length(key)})
        .join(by_name, ["_repo", "_size"], "left")
        .drop("_repo", "_size")
        .withColumn("found", F.col("full_name").isNotNull())
        .withColumn(
            "publisher_matches",
            F.col("found")
            & F.coalesce(F.lower("publisher") == F.lower("owner"), F.lit(False)),
        )
    )
    unlinked = parsed.filter(~usable).withColumns(
        {"found": F.lit(False), "publisher_matches": F.lit(False)}
    )
    return joined.unionByName(unlinked, allowMissingColumns=True)


def repository_points(
    found: Column,
    archived: Column,
    stars: Column,
    created_at: Column,
    publisher_matches: Column,
    has_provenance: Column,
    as_of: Column,
) -> Column:
    """Points for a repository's standing; none if there is no repository."""

    def penalty(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    mismatch = (
        F.when(publisher_matches | has_provenance, 0.0)
        .when(stars >= rules.POPULAR_STARS, rules.MISMATCH_POPULAR_PENALTY)
        .otherwise(rules.MISMATCH_PENALTY)
    )
    points = (
        F.lit(rules.REPOSITORY_POINTS)
        - penalty(archived, rules.ARCHIVED_PENALTY)
        - penalty(stars == 0, rules.ZERO_STARS_PENALTY)
        - penalty(created_at > as_of - F.expr("INTERVAL 1 MONTH"), rules.YOUNG_PENALTY)
        - mismatch
    )
    return F.when(found, F.greatest(F.lit(0.0), points)).otherwise(0.0)


def score_links(links: DataFrame, health: DataFrame, as_of: Column) -> DataFrame:
    """``link_health`` with ``repository_points``; ``as_of`` is the date of the assessment."""
    return link_health(links, health).withColumn(
        "repository_points",
        repository_points(
            F.col("found"),
            F.coalesce(F.col("archived"), F.lit(False)),
            F.coalesce(F.col("stars"), F.lit(0)),
            F.col("created_at"),
            F.col("publisher_matches"),
            F.col("provenance_id").isNotNull(),
            as_of,
        ),
    )
