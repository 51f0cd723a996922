"""Line rules over code files: risky calls and modules, with string and comment context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions.sql import quote
from .hits import SIGHTING, literal_map

SCANNER = "static"


def before_match(pattern: str) -> str:
    """The text in front of the first match of ``pattern``."""
    return f"regexp_extract(text, {quote(rf'(?s)\A(.*?)(?:{pattern})')}, 1)"


def _outside_code(pattern: str) -> str:
    """Whether the first match of ``pattern`` sits in a string literal or behind ``//``."""
    return f"NOT {before_match(pattern)} RLIKE {quote(rules.CODE_PREFIX)}"


def looks_at_context(rule: rules.LineRule) -> bool:
    return rule.code_only and rule.severity != rules.INFO


def _rule_hit(rule: rules.LineRule) -> str:
    matches = f"text RLIKE {quote(rule.pattern)}"
    if rule.unless:
        matches += f" AND NOT text RLIKE {quote(rule.unless)}"
    quoted = "false"
    if looks_at_context(rule):
        quoted = f"in_comment OR {_outside_code(rule.pattern)}"
    return f"""CASE WHEN {matches} THEN named_struct('scanner', '{SCANNER}',
      'rule_id', {quote(rule.rule_id)}, 'severity', {quote(rule.severity)},
      'message', {quote(rule.message)}, 'line', line, 'evidence', CAST(NULL AS STRING),
      'shows_line', true, 'quoted', {quoted}, 'sighting', CAST(NULL AS {SIGHTING})) END"""


def rule_hits(line_rules: Sequence[rules.LineRule] = rules.STATIC_RULES) -> Column:
    """Array of hits of one line, at most one per rule.

    Reads the columns ``text``, ``line`` and ``in_comment``.  Each pattern is a literal, compiled
    once per task.
    """
    return F.expr(f"array_compact(array({', '.join(_rule_hit(r) for r in line_rules)}))")


def may_match(line: Column) -> Column:
    return tx.contains_any(line, rules.STATIC_MARKERS)


def relax_for_cli_tools(
    findings: DataFrame,
    flags: DataFrame,
    line_rules: Sequence[rules.LineRule] = rules.STATIC_RULES,
) -> DataFrame:
    """Lower the findings that are normal for command-line tools to info.

    ``findings`` needs ``pkg, version, scanner, rule_id, severity`` and may have ``message``.
    The flag joins to findings (or counts of them), never to the files with their contents, and
    only flagged packages take part.
    """
    expected = {r.rule_id: r.message for r in line_rules if r.cli_expected}
    if not expected:
        return findings
    tools = flags.filter("is_cli").select("pkg", "version", F.lit(True).alias("_cli")).distinct()
    joined = findings.join(tools, ["pkg", "version"], "left")
    relax = (
        F.col("_cli").isNotNull()
        & (F.col("scanner") == SCANNER)
        & F.col("rule_id").isin(*expected)
    )
    out = {"severity": F.when(relax, rules.INFO).otherwise(F.col("severity"))}
    if "message" in findings.columns:
        plain = literal_map(expected)[F.col("rule_id")]
        out["message"] = F.when(relax, F.concat(plain, F.lit(rules.CLI_SUFFIX))).otherwise(
            F.col("message")
        )
    return joined.withColumns(out).drop("_cli")
