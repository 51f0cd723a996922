"""Tool-server configurations: which packages they run, and whether the fleet passes the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls

_CONFIG = "mcpServers map<string,variant>"


def _package_argument(command: Column, args: Column) -> Column:
    """First argument of a package runner that is no flag and no value of one."""
    runner = F.regexp_replace(command, r"\.exe\z", "").isin(*rules.RUNNER_COMMANDS)

    def step(state: Column, arg: Column) -> Column:
        def to(skip: Column | bool, found: Column) -> Column:
            skip = F.lit(skip) if isinstance(skip, bool) else skip
            return F.struct(skip.alias("skip"), found.alias("found"))

        none = F.lit(None).cast("string")
        return (
            F.when(state["found"].isNotNull(), state)
            .when(state["skip"], to(False, none))
            .when(arg.isin(*rules.VALUE_FLAGS), to(True, none))
            .when(arg.startswith("-"), to(False, none))
            .otherwise(to(False, arg))
        )

    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("found"))
    picked = F.aggregate(args, start, step, lambda s: s["found"])
    return F.nullif(F.when(runner, picked), F.lit(""))


def tool_servers(configs: DataFrame) -> DataFrame:
    """``configs(config_file, body)`` to one row per configured server; bad JSON yields none."""
    servers = configs.select(
        "config_file", F.explode(F.from_json("body", _CONFIG)["mcpServers"]).alias("name", "_v")
    )
    entry = F.col("_v")
    read = servers.filter(F.schema_of_variant(entry).startswith("OBJECT")).select(
        "config_file",
        "name",
        F.coalesce(F.try_variant_get(entry, "$.command", "string"), F.lit("")).alias("command"),
        F.coalesce(
            F.try_variant_get(entry, "$.args", "array<string>"), F.array().cast("array<string>")
        ).alias("args"),
    )
    package = _package_argument(F.col("command"), F.col("args"))
    return read.withColumn("npm_package", package).withColumn(
        "version_pinned",
        F.coalesce(urls.is_pinned(F.col("npm_package")), F.lit(False)),
    )


def gate_servers(servers: DataFrame, scores: DataFrame, latest: DataFrame) -> DataFrame:
    """Score and exit code of each package-backed server.

    ``scores(pkg, version, score, grade, verdict, exit_code)`` and ``latest(pkg, version)``.  A
    package that many servers run was scored once; one that has no score counts as failed.
    """
    name, version = urls.split_specifier(F.col("npm_package"))
    backed = servers.filter(F.col("npm_package").isNotNull()).select(
        "config_file",
        F.col("name").alias("server"),
        "npm_package",
        "version_pinned",
        name.alias("pkg"),
        F.nullif(version, F.lit("")).alias("_wanted"),
    )
    # Every release answers to its exact version; the latest one also to no version at all.
    answers = scores.join(
        latest.select("pkg", "version", F.lit(True).alias("_latest")), ["pkg", "version"], "left"
    ).select(
        "pkg",
        "version",
        "score",
        "grade",
        "verdict",
        "exit_code",
        F.explode(
            F.when(F.col("_latest"), F.array(F.col("version"), F.lit("")))
            .otherwise(F.array("version"))
        ).alias("_asked"),
    )
    return (
        backed.withColumn("_asked", F.coalesce("_wanted", F.lit("")))
        .join(answers, ["pkg", "_asked"], "left")
        .select(
            "config_file",
            "server",
            "npm_package",
            "version_pinned",
            "pkg",
            "version",
            "score",
            "grade",
            "verdict",
            F.coalesce("exit_code", F.lit(rules.EXIT_FAILED)).alias("exit_code"),
        )
    )


def fleet_gate(gated: DataFrame) -> DataFrame:
    """One row: servers, failures, servers without a pinned version, and the worst exit code."""
    return gated.agg(
        F.count("*").alias("n_servers"),
        F.count_if(F.col("score").isNull()).alias("n_failed"),
        F.count_if(~F.col("version_pinned")).alias("n_unpinned"),
        F.coalesce(F.max("exit_code"), F.lit(0)).alias("worst_exit"),
    )
