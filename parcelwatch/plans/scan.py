"""One pass over file contents for every rule that a single file can answer.

All content scanners share the read, the split into lines and the explode.  Nothing here
shuffles: each file is handled where it was read, so the plan is as parallel as the input splits
and a package of any size is spread over all tasks that read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions.entropy import shannon_entropy
from ..operators import ioc, long_lines, obfuscation, secrets, static_rules
from ..operators import lines as ln
from ..operators.hits import as_findings, settle
from ..schemas import FINDING_COLUMNS

#: Scanners whose findings come straight from single files.
CONTENT_SCANNERS = ("static", "obfuscation", "secrets")
#: All scanners that read contents.
READING_SCANNERS = (*CONTENT_SCANNERS, ioc.SCANNER)


def scan_hits(
    files: DataFrame,
    scanners: Sequence[str] = READING_SCANNERS,
    line_rules: Sequence[rules.LineRule] = rules.STATIC_RULES,
    carry: Sequence[str] = (),
    longest: int | None = None,
) -> DataFrame:
    """Hits of the chosen scanners: the findings layout and, for indicators, ``sighting``.

    Write these to a table once and derive findings (:func:`findings_of`) and indicators
    (:func:`indicators_of`) from it, so that contents are read a single time.  ``carry`` names further
    columns of the files to keep.

    Lines of more than ``longest`` bytes are read in parts of that many code points by all tasks for the
    built-in static rules, encoded runs and indicators; the hits stay the same.  Files that can have such
    a line are read once more for it.  Secrets may span any character and are looked for in whole lines.
    """
    static, obfuscated, secret, network = (s in scanners for s in READING_SCANNERS)
    path, content = F.col("path"), F.col("content")
    code, text_file = tx.is_code_file(path), tx.is_text_file(path)
    whole_text = secret or network
    chosen = files.filter(code | text_file if whole_text else code).select(
        "pkg",
        "version",
        F.col("path").alias("file"),
        content,
        code.alias("code"),
        *([text_file.alias("text_file")] if whole_text else []),
        *carry,
    )

    keep = ["pkg", "version", "file", "code", *carry] + (["text_file"] if whole_text else [])
    if obfuscated:
        chosen = _measure(chosen, keep)
        keep = [*keep, "minified", "file_hits"]

    line, number = F.col("text"), F.col("line")
    builtin = tuple(line_rules) == rules.STATIC_RULES
    if longest is not None and static and not builtin:
        raise ValueError("lines are read in parts for the built-in rules only")
    exploded = ln.explode_lines(chosen, keep, with_comments=static)
    fits = F.octet_length(line) <= longest if longest is not None else None
    wanted, arrays = [], []

    def look(may: Column, hits: Column, whole: bool = False) -> None:
        may = may if whole or fits is None else fits & may
        wanted.append(may)
        arrays.append(F.when(may, hits))

    if static:
        may = F.col("code") & static_rules.may_match(line) if builtin else F.col("code")
        look(may, static_rules.rule_hits(line_rules))
    if obfuscated:
        may = F.col("code") & obfuscation.may_match(line)
        look(may, obfuscation.line_hits(line, number, F.col("minified")))
        look((number == 1) & (F.size("file_hits") > 0), F.col("file_hits"), whole=True)
    if secret:
        look(F.col("text_file") & secrets.may_match(line), secrets.line_hits(), whole=True)
    if network:
        look(F.col("text_file") & ioc.may_match(line), ioc.line_hits(line, number))
    every = F.flatten(F.array_compact(F.array(*arrays)))
    hits = exploded.filter(tx.any_of(wanted)).select(
        "pkg", "version", "file", "text", *carry, F.explode(every).alias("hit")
    )
    settled = settle(hits.select("pkg", "version", "file", "text", *carry, "hit.*"))
    found = settled.select(*FINDING_COLUMNS, "sighting", *carry)
    in_parts = [s for s in scanners if s != secrets.SCANNER]
    if longest is None or not in_parts:
        return found
    giant = chosen.filter(F.octet_length("content") > longest)
    lines = ln.explode_lines(giant, [c for c in keep if c != "file_hits"], with_comments=static)
    parts = long_lines.hits(lines.filter(~fits), in_parts, longest, carry)
    return found.unionByName(parts.select(*FINDING_COLUMNS, "sighting", *carry))


def findings_of(hits: DataFrame) -> DataFrame:
    """Findings of the content scanners, before any allowance for command-line tools."""
    return as_findings(hits.filter(F.col("scanner") != ioc.SCANNER))


def indicators_of(hits: DataFrame) -> DataFrame:
    """Distinct network indicators per release."""
    return ioc.indicators(ioc.sightings(hits))


def scan_contents(
    files: DataFrame,
    scanners: Sequence[str] = CONTENT_SCANNERS,
    line_rules: Sequence[rules.LineRule] = rules.STATIC_RULES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Findings of the chosen content scanners, before any allowance for command-line tools."""
    return as_findings(scan_hits(files, scanners, line_rules, carry), carry)


def _measure(files: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``minified`` and ``file_hits``, the whole-file obfuscation measures."""
    content = F.col("content")
    entropy_of = obfuscation.entropy_input(F.col("file"), content)
    measured = obfuscation.classify_arrays(
        files.select(
            *keep,
            "content",
            shannon_entropy(entropy_of).alias("entropy"),
            (
                F.col("code") & obfuscation.looks_minified(content, ln.split_lines(content))
            ).alias("minified"),
        )
    )
    hits = obfuscation.file_hits(F.col("entropy"), F.col("minified"), F.col("array_kind"))
    return measured.select(
        *keep, "content", "minified", F.when(F.col("code"), hits).alias("file_hits")
    )


def scan_static(files: DataFrame, flags: DataFrame) -> DataFrame:
    """Static findings; ``flags(pkg, version, is_cli)`` marks command-line tools."""
    return static_rules.relax_for_cli_tools(scan_contents(files, ("static",)), flags)


def scan_obfuscation(files: DataFrame) -> DataFrame:
    return scan_contents(files, ("obfuscation",))


def scan_ioc(files: DataFrame) -> DataFrame:
    return ioc.findings(indicators_of(scan_hits(files, (ioc.SCANNER,))))


def scan_secrets(files: DataFrame) -> DataFrame:
    return scan_contents(files, ("secrets",))


def scan_user_rules(
    files: DataFrame, line_rules: Sequence[rules.LineRule], flags: DataFrame
) -> DataFrame:
    """The static scanner run with the caller's own rules."""
    found = scan_contents(files, ("static",), line_rules)
    return static_rules.relax_for_cli_tools(found, flags, line_rules)
