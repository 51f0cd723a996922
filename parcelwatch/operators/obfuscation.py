"""Signs of obfuscated code: entropy, encoded runs, very long lines, rotated string arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions.entropy import shannon_entropy
from .hits import hit

SCANNER = "obfuscation"

# Tried only where a run starts, so runs just below the limit cost no more than their length.
_BASE64_RUN = r"(?<![A-Za-z0-9+/=])" + rules.BASE64_RUN

# Opening bracket and one more complete string literal than the limit allows.
_ARRAY = rf"\[(?:{rules.WS}*+{rules.STRING_LITERAL}[,{rules.WS_CHARS}]*+){{{rules.ARRAY_LIMIT + 1}}}"
_ARRAY_SPLIT = rf"(?s)\A(.*?){_ARRAY}(.{{0,{rules.ARRAY_WINDOW_AFTER}}})"

_HAS_KEYWORD = rf"{rules.WB}(?:{'|'.join(rules.JS_KEYWORDS)}){rules.WE}"


def looks_minified(content: Column, lines: Column) -> Column:
    """Long lines and keywords, but not saturated with machine-made names."""
    return (
        F.exists(lines, lambda line: tx.longer_than(line, rules.MINIFIED_LINE))
        & content.rlike(_HAS_KEYWORD)
        & (F.regexp_count(content, F.lit(rules.OBFUSCATOR_NAME)) <= rules.OBFUSCATOR_NAME_LIMIT)
    )


def _rotates(window: str) -> Column:
    return tx.any_of(
        [F.col(window).rlike(a) & F.col(window).rlike(b) for a, b in rules.ROTATION_PAIRS]
    )


def classify_arrays(files: DataFrame) -> DataFrame:
    """Add ``array_kind``: 'rotated' or 'data' for the first large string array, else null.

    Rotation code (push and shift) is looked for close behind the 51st string and close before
    the bracket.  The steps are columns of their own so that each pattern runs once per file.
    """
    content, held = F.col("content"), files.columns
    found = files.withColumn("_has", content.contains("[") & content.rlike(rf"(?s){_ARRAY}"))
    cut = found.withColumns(
        {
            "_before": F.when(F.col("_has"), F.regexp_extract(content, _ARRAY_SPLIT, 1)),
            "_after": F.when(F.col("_has"), F.regexp_extract(content, _ARRAY_SPLIT, 2)),
        }
    )
    windows = cut.withColumns(
        {
            "_before": tx.utf16_right(F.col("_before"), rules.ARRAY_WINDOW_BEFORE),
            "_after": tx.utf16_left(F.col("_after"), rules.ARRAY_WINDOW_AFTER),
        }
    )
    kind = F.when(_rotates("_after") | _rotates("_before"), "rotated").otherwise("data")
    return windows.select(*held, F.when(F.col("_has"), kind).alias("array_kind"))


def entropy_input(path: Column, content: Column) -> Column:
    """The text whose entropy matters; null for files the check does not cover."""
    # A unit takes at most three bytes, so only short texts need an exact count.
    size, least = F.octet_length(content), rules.ENTROPY_MIN_LENGTH
    big = (size >= 3 * least) | ((size >= least) & (tx.utf16_length(content) >= least))
    return F.when(tx.is_code_file(path) & big, content)


def file_entropy(files: DataFrame) -> DataFrame:
    """Entropy of every code file of at least 256 units: ``pkg, version, path, entropy``."""
    measured = files.select(
        "pkg", "version", "path", entropy_input(F.col("path"), F.col("content")).alias("content")
    ).filter(F.col("content").isNotNull())
    return measured.select(
        "pkg", "version", "path", shannon_entropy("content").alias("entropy")
    )


def file_hits(entropy: Column, minified: Column, kind: Column) -> Column:
    """Array of whole-file hits."""
    shown = F.format_string("%.2f", entropy)

    def entropy_hit(rule_id, word, threshold, tail, severity):
        label = F.concat(F.lit(word), shown, F.lit(f" (threshold: {threshold}) — {tail}"))
        bits = F.concat(F.lit("File entropy: "), shown, F.lit(" bits/char"))
        return hit(SCANNER, rule_id, severity, label, None, bits)

    high, raised = "entropy-critical", "entropy-warning"
    minified_tail = "appears to be minified code"
    by_entropy = (
        F.when(
            (entropy >= rules.ENTROPY_CRITICAL) & minified,
            entropy_hit(high, "High Shannon entropy: ", rules.ENTROPY_CRITICAL,
                        minified_tail, rules.INFO),
        )
        .when(
            entropy >= rules.ENTROPY_CRITICAL,
            entropy_hit(high, "Very high Shannon entropy: ", rules.ENTROPY_CRITICAL,
                        "likely obfuscated", rules.CRITICAL),
        )
        .when(
            (entropy >= rules.ENTROPY_WARNING) & minified,
            entropy_hit(raised, "Elevated Shannon entropy: ", rules.ENTROPY_WARNING,
                        minified_tail, rules.INFO),
        )
        .when(
            entropy >= rules.ENTROPY_WARNING,
            entropy_hit(raised, "Elevated Shannon entropy: ", rules.ENTROPY_WARNING,
                        "possible obfuscation", rules.WARNING),
        )
    )
    by_array = F.when(
        kind == "rotated",
        hit(SCANNER, "string-array", rules.CRITICAL,
            "Large string array (>50 elements) with obfuscation markers", None,
            "String array with 50+ elements and rotation/encoding detected"),
    ).when(
        kind == "data",
        hit(SCANNER, "string-array", rules.INFO,
            "Large string array (>50 elements) — appears to be a data table", None,
            "String array with 50+ readable elements (keywords, identifiers, etc.)"),
    )
    return F.array_compact(F.array(by_entropy, by_array))


def has_hex_run(line: Column) -> Column:
    return line.rlike(rules.HEX_RUN)


def has_base64_run(line: Column) -> Column:
    return line.rlike(_BASE64_RUN)


def line_hits(line: Column, number: Column, minified: Column) -> Column:
    """Array of hits of one line."""
    units = F.when(tx.longer_than(line, rules.LONG_LINE), tx.utf16_length(line))
    return measured_hits(has_hex_run(line), has_base64_run(line), units, number, minified)


def measured_hits(
    hex_run: Column, base64_run: Column, units: Column, number: Column, minified: Column
) -> Column:
    """Array of hits of a line that was looked at already; ``units`` is its length."""
    severity = F.when(minified, rules.INFO).otherwise(rules.WARNING)
    bundled = F.when(minified, " (in bundled code)").otherwise("")
    by_hex = F.when(
        hex_run,
        hit(SCANNER, "hex-run", severity,
            F.concat(F.lit("Hex-encoded string sequences detected"), bundled), number, shows_line=True),
    )
    by_base64 = F.when(
        base64_run,
        hit(SCANNER, "base64-run", severity,
            F.concat(F.lit("Large base64-encoded blob (>500 chars)"), bundled), number, shows_line=True),
    )
    long_line = F.when(
        units > rules.LONG_LINE,
        hit(SCANNER, "long-line", rules.INFO,
            F.concat(F.lit("Very long line ("), units.cast("string"),
                     F.lit(" chars) — possible minification without source maps")), number),
    )
    return F.array_compact(F.array(by_hex, by_base64, long_line))


def may_match(line: Column) -> Column:
    size = F.octet_length(line)
    return (
        (line.contains("\\x") & line.rlike(rules.HEX_RUN))
        | (size > rules.LONG_LINE)
        | ((size >= 500) & line.rlike(_BASE64_RUN))
    )
