"""Per-scanner results: counts, the pass mark and a one-line summary for every scanner that ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx

_SEVERITIES = (rules.CRITICAL, rules.WARNING, rules.INFO)


def release_facts(files: DataFrame) -> DataFrame:
    """``pkg, version, n_code_files``; reads paths only."""
    return files.groupBy("pkg", "version").agg(
        F.count_if(tx.is_code_file(F.col("path"))).alias("n_code_files")
    )


def _n(column: str) -> Column:
    return F.col(column).cast("string")


def _listed(*severities: str) -> Column:
    """``2 critical, 1 warning`` for the non-zero counts."""
    return F.concat_ws(
        ", ",
        *[F.when(F.col(f"n_{s}") > 0, F.concat(_n(f"n_{s}"), F.lit(f" {s}"))) for s in severities],
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def scanner_results(
    findings: DataFrame,
    runs: DataFrame,
    facts: DataFrame,
) -> DataFrame:
    """``pkg, version, scanner, passed, n_critical, n_warning, n_info, summary``.

    ``findings`` are final (allowances made).  ``facts`` has per release what summaries mention
    besides findings: ``n_code_files, is_cli, n_direct, n_optional, has_manifest, has_scripts,
    known_name, package_name, similar`` (see :func:`with_facts`).
    """
    severity, rule = F.col("severity"), F.col("rule_id")
    extensions = tuple(e[1:] for e in sorted(rules.BINARY_EXTENSIONS))
    counted = findings.groupBy("pkg", "version", "scanner").agg(
        *[F.count_if(severity == s).alias(f"n_{s}") for s in _SEVERITIES],
        F.count("*").alias("n"),
        F.count_if(rule == "url").alias("n_urls"),
        F.count_if(rule == "ipv4").alias("n_ips"),
        *[F.count_if(rule == e).alias(f"ext_{e}") for e in extensions],
        # Hook names come from a list of seven, so the set stays small.
        F.collect_set(
            F.when(rule.isin(*rules.LIFECYCLE_HOOKS) & (F.col("scanner") == "hooks"), rule)
        ).alias("hooks"),
    )
    joined = runs.join(counted, ["pkg", "version", "scanner"], "left").join(
        facts, ["pkg", "version"], "left"
    )
    zero = [f"n_{s}" for s in _SEVERITIES] + ["n", "n_urls", "n_ips", "n_direct", "n_optional"]
    filled = joined.na.fill(0, [*zero, "n_code_files", *[f"ext_{e}" for e in extensions]]).na.fill(
        False, ["is_cli", "has_manifest", "has_scripts", "known_name"]
    )

    none = F.col("n") == 0
    clean = (F.col("n_critical") == 0) & (F.col("n_warning") == 0)
    by_extension = F.concat_ws(
        ", ",
        *[
            F.when(F.col(f"ext_{e}") > 0, _text(_n(f"ext_{e}"), f" .{e}"))
            for e in extensions
        ],
    )
    hooks = F.array_join(F.array_sort("hooks"), ", ")
    flags = _listed(rules.CRITICAL, rules.WARNING)
    summaries = {
        "static": F.when(none, "No dangerous patterns detected").otherwise(
            _text("Found ", _listed(*_SEVERITIES), " pattern(s) across ", _n("n_code_files"),
                  " files",
                  F.when(F.col("is_cli"), " (CLI tool — shell execution expected)").otherwise(""))
        ),
        "obfuscation": F.when(none, "No obfuscation detected").otherwise(
            _text("Obfuscation indicators: ", _listed(*_SEVERITIES))
        ),
        "secrets": F.when(none, "No embedded secrets detected").otherwise(
            _text("Secrets found: ", flags)
        ),
        "hooks": F.when(~F.col("has_manifest"), "No package.json found")
        .when(~F.col("has_scripts"), "No scripts defined")
        .when(none, "No lifecycle hooks found")
        .when(F.size("hooks") == 0, "Only benign lifecycle hooks (prepare)")
        .otherwise(
            _text("Lifecycle hooks: ", hooks,
                  F.when(F.col("n_critical") > 0,
                         _text(" (", _n("n_critical"), " with shell commands)")).otherwise(""))
        ),
        "binaries": F.when(none, "No binary files found").otherwise(
            _text(_n("n"), " binary file(s): ", by_extension)
        ),
        "dependencies": F.when(~F.col("has_manifest"), "No package.json found").otherwise(
            _text(_n("n_direct"), " direct, ", _n("n_optional"), " optional dependencies",
                  F.when(clean, "").otherwise(_text(" (", flags, ")")))
        ),
        "typosquatting": F.when(
            F.col("known_name"),
            _text('"', F.col("package_name"), '" is a known popular package'),
        )
        .when(none, "No similar popular package names")
        .otherwise(_text("Similar to: ", F.coalesce("similar", F.lit("")))),
        "ioc": F.when(none, "No URLs or IP addresses found").otherwise(
            _text(
                F.concat_ws(
                    ", ",
                    F.when(F.col("n_urls") > 0, _text(_n("n_urls"), " URL(s)")),
                    F.when(F.col("n_ips") > 0, _text(_n("n_ips"), " IP(s)")),
                ),
                " extracted (defanged)",
            )
        ),
    }
    # Scanners of one's own have no wording of theirs.
    summary = F.when(none, "No findings").otherwise(_text("Findings: ", _listed(*_SEVERITIES)))
    for name, text in summaries.items():
        summary = F.when(F.col("scanner") == name, text).otherwise(summary)
    passed = F.when(F.col("scanner") == "ioc", True).when(
        F.col("scanner") == "binaries", none
    ).otherwise(clean)
    return filled.select(
        "pkg",
        "version",
        "scanner",
        passed.alias("passed"),
        *[f"n_{s}" for s in _SEVERITIES],
        summary.alias("summary"),
    )


def with_facts(
    files: DataFrame,
    flags: DataFrame,
    dependency_counts: DataFrame,
    with_scripts: DataFrame,
    names: DataFrame,
    name_summaries: DataFrame,
    manifests: DataFrame,
) -> DataFrame:
    """Everything summaries mention, one row per release, from one grouping of stacked facts.

    ``names(pkg, version, name)``, ``name_summaries(name, summary)`` from the similarity check;
    ``manifests`` and ``with_scripts`` list the releases that have a manifest, and one with a
    scripts section.
    """
    layout = {
        "n_code_files": "bigint", "is_cli": "boolean", "n_direct": "bigint", "n_optional": "bigint",
        "has_manifest": "boolean", "has_scripts": "boolean", "known_name": "boolean",
        "package_name": "string", "similar": "string",
    }

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(
            "pkg",
            "version",
            *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in layout.items()],
        )

    summary = F.col("summary")
    named = names.join(name_summaries, "name")
    stacked = [
        rows(release_facts(files), n_code_files=F.col("n_code_files")),
        rows(flags, is_cli=F.col("is_cli")),
        rows(dependency_counts, n_direct=F.col("n_direct"), n_optional=F.col("n_optional")),
        rows(with_scripts, has_scripts=F.lit(True)),
        rows(manifests, has_manifest=F.lit(True)),
        rows(
            named,
            known_name=summary.endswith(" is a known popular package"),
            package_name=F.col("name"),
            similar=F.regexp_extract(summary, r"(?s)\ASimilar to: (.*)\z", 1),
        ),
    ]
    union = stacked[0]
    for frame in stacked[1:]:
        union = union.unionByName(frame)
    return union.groupBy("pkg", "version").agg(*[F.max(c).alias(c) for c in layout])
