"""Scanners over manifest data: lifecycle scripts and declared dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from .hits import as_findings

HOOKS, DEPENDENCIES = "hooks", "dependencies"


def scan_hooks(scripts: DataFrame) -> DataFrame:
    """Findings for install-time scripts; ``scripts(pkg, version, name, command)``."""
    name, command = F.col("name"), F.col("command")
    runs_shell = tx.contains_any(F.lower(command), rules.SHELL_COMMANDS)
    benign = name == rules.BENIGN_HOOK
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    told = (
        F.when(benign, F.concat(quoted, F.lit(" script defined: "), command))
        .when(runs_shell, F.concat(quoted, F.lit(" script executes shell commands: "), command))
        .otherwise(F.concat(quoted, F.lit(" lifecycle script defined: "), command))
    )
    severity = (
        F.when(benign, rules.INFO).when(runs_shell, rules.CRITICAL).otherwise(rules.WARNING)
    )
    return as_findings(
        scripts.filter(
            name.isin(rules.BENIGN_HOOK, *rules.LIFECYCLE_HOOKS) & command.isNotNull()
        ).select(
            "pkg",
            "version",
            F.lit(HOOKS).alias("scanner"),
            severity.alias("severity"),
            name.alias("rule_id"),
            told.alias("message"),
            F.lit("package.json").alias("file"),
            command.alias("evidence"),
        )
    )


def summarize_hooks(findings: DataFrame) -> DataFrame:
    """``pkg, version, summary``; there are only seven hook names, so the list is short."""
    active = F.col("severity") != rules.INFO
    n_shell = F.count_if(F.col("severity") == rules.CRITICAL)
    names = F.array_join(
        F.array_sort(F.collect_set(F.when(active, F.col("rule_id")))), ", "
    )
    shell = F.when(
        n_shell > 0, F.concat(F.lit(" ("), n_shell.cast("string"), F.lit(" with shell commands)"))
    ).otherwise("")
    return findings.groupBy("pkg", "version").agg(
        F.when(F.count_if(active) > 0, F.concat(F.lit("Lifecycle hooks: "), names, shell))
        .otherwise("Only benign lifecycle hooks (prepare)")
        .alias("summary")
    )


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    """Direct and optional dependencies per package version; a name in both counts twice."""
    optional = F.col("kind") == "optional"
    return dependencies.groupBy("pkg", "version").agg(
        F.count_if(~optional).alias("n_direct"), F.count_if(optional).alias("n_optional")
    )


def count_findings(counts: DataFrame) -> DataFrame:
    total = F.col("n_direct") + F.col("n_optional")
    shown = total.cast("string")
    extreme = total > rules.DEPENDENCIES_CRITICAL
    message = F.when(
        extreme,
        F.concat(F.lit("Extreme dependency count: "), shown,
                 F.lit(f" dependencies (threshold: {rules.DEPENDENCIES_CRITICAL})"
                       " — dependency bloat")),
    ).otherwise(
        F.concat(F.lit("High dependency count: "), shown,
                 F.lit(f" dependencies (threshold: {rules.DEPENDENCIES_WARNING})"))
    )
    return as_findings(
        counts.filter(total > rules.DEPENDENCIES_WARNING).select(
            "pkg",
            "version",
            F.lit(DEPENDENCIES).alias("scanner"),
            F.when(extreme, rules.CRITICAL).otherwise(rules.WARNING).alias("severity"),
            F.lit("count").alias("rule_id"),
            message.alias("message"),
            F.lit("package.json").alias("file"),
            F.concat(
                F.col("n_direct").cast("string"), F.lit(" direct + "),
                F.col("n_optional").cast("string"), F.lit(" optional"),
            ).alias("evidence"),
        )
    )


def spec_findings(dependencies: DataFrame) -> DataFrame:
    """Unpinned specs (critical) and specs that bypass the registry (warning).

    An optional entry overrides a direct one of the same name.  Only specs worth a finding take part
    in that, so no text is aggregated.
    """
    name, spec = F.col("name"), F.col("spec")
    unpinned = spec.isin(*rules.UNPINNED_SPECS)
    message = F.when(
        unpinned,
        F.concat(F.lit("Unpinned dependency: "), name, F.lit('@"'), spec,
                 F.lit('" — accepts any version')),
    ).otherwise(
        F.concat(F.lit("Git URL dependency: "), name, F.lit(" — not pinned to npm registry"))
    )
    worth = dependencies.filter(unpinned | spec.rlike(rules.GIT_SPEC))
    optional = F.col("kind") == "optional"
    key = ["pkg", "version", "name"]
    direct = worth.filter(~optional).join(dependencies.filter(optional).select(*key), key, "left_anti")
    columns = [*key, "spec"]
    return as_findings(
        direct.select(*columns).unionByName(worth.filter(optional).select(*columns)).select(
            "pkg",
            "version",
            F.lit(DEPENDENCIES).alias("scanner"),
            F.when(unpinned, rules.CRITICAL).otherwise(rules.WARNING).alias("severity"),
            F.when(unpinned, "unpinned").otherwise("git-url").alias("rule_id"),
            message.alias("message"),
            F.lit("package.json").alias("file"),
            F.concat(F.lit('"'), name, F.lit('": "'), spec, F.lit('"')).alias("evidence"),
        )
    )


def scan_dependencies(dependencies: DataFrame) -> DataFrame:
    """``dependencies(pkg, version, name, spec, kind)`` to findings."""
    return count_findings(dependency_counts(dependencies)).unionByName(spec_findings(dependencies))
