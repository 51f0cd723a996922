"""Network indicators: URLs and IPv4 addresses, plain or encoded, reported defanged.

Extraction is per line and needs no shuffle.  Each distinct indicator of a package keeps its first
sighting and at most five locations; that limit is a rank filter, which Spark applies before the
shuffle, so an indicator repeated a billion times sends five rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import decode, urls
from .hits import as_findings, hit

SCANNER = "ioc"

# Cheap tests that every line with a URL, an address or an encoded run passes.  Each extractor
# runs only on text that passes its own.
_DOTTED = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
_BASE64_RUN = r"(?<![\p{Alnum}+/])[\p{Alnum}+/]{20}"

# Tried only where a run of punctuation starts, so long runs cost no more than their length.
_TRAILING = r"(?<![.),'\";])" + rules.URL_TRAILING


def _has_char_codes(text: Column) -> Column:
    return F.lower(text).contains("string.fromcharcode")


def may_match(line: Column) -> Column:
    return (
        line.contains("://")
        | (line.contains("\\x") & line.rlike(rules.HEX_ESCAPES))
        | (line.contains("\\u") & line.rlike(rules.UNICODE_ESCAPES))
        | _has_char_codes(line)
        | line.rlike(_DOTTED)
        | line.rlike(_BASE64_RUN)
    )


def _extract(text: Column, condition: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, which is only tried where ``condition`` holds."""
    return F.when(condition, F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(
        F.array().cast("array<string>")
    )


def _fragments(line: Column) -> Column:
    """The line itself and every decoded piece of it, in reading order."""

    def decoded(step: int, method: str, matches: Column, decoder) -> Column:
        return F.transform(
            matches, lambda m, i: _fragment(step, F.lit(method), i, decoder(m))
        )

    hex_runs = _extract(line, line.contains("\\x"), rules.HEX_ESCAPES)
    unicode_runs = _extract(line, line.contains("\\u"), rules.UNICODE_ESCAPES)
    codes = _extract(line, _has_char_codes(line), rules.CHAR_CODES, 1)
    blobs = _extract(line, line.rlike(_BASE64_RUN), rules.BASE64_BLOB)
    return F.concat(
        F.array(_fragment(0, F.lit(None).cast("string"), F.lit(0), line)),
        decoded(1, "hex", hex_runs, decode.hex_escapes),
        decoded(2, "unicode", unicode_runs, decode.unicode_escapes),
        decoded(3, "charcode", codes, decode.char_codes),
        decoded(4, "base64", blobs, decode.base64_blob),
    )


def _fragment(step: int, method: Column, index: Column, text: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"),
        method.alias("method"),
        index.cast("bigint").alias("fragment"),
        text.alias("text"),
    )


def _indicators(text: Column) -> Column:
    found_urls = F.transform(
        _extract(text, text.contains("://"), rules.URL_PATTERN),
        lambda m, i: F.struct(
            F.lit("url").alias("type"),
            F.regexp_replace(m, _TRAILING, "").alias("raw"),
            i.alias("nth"),
        ),
    )
    found_ips = F.transform(
        _extract(text, text.rlike(_DOTTED), rules.IPV4_PATTERN),
        lambda m, i: F.struct(F.lit("ipv4").alias("type"), m.alias("raw"), i.alias("nth")),
    )
    return F.concat(found_urls, found_ips)


def line_hits(line: Column, number: Column) -> Column:
    """Array of hits of one line: every indicator in it, plain or decoded, in reading order."""
    readable = F.filter(_fragments(line), lambda f: f["text"].isNotNull())
    seen = F.flatten(
        F.transform(
            readable,
            lambda f: F.transform(
                _indicators(f["text"]),
                lambda i: F.struct(
                    f["step"], f["method"], f["fragment"], i["type"], i["raw"], i["nth"]
                ),
            ),
        )
    )
    return F.transform(
        seen, lambda s: hit(SCANNER, s["type"], rules.INFO, s["raw"], number, sighting=s)
    )


def sightings(hits: DataFrame) -> DataFrame:
    """Occurrences worth reporting, one row each, from the hits of a content scan."""
    raw, is_url = F.col("raw"), F.col("type") == "url"
    ignored = F.when(is_url, urls.is_ignored_host(urls.host(raw))).otherwise(
        raw.isin(*rules.IGNORED_IPS)
    )
    return (
        hits.filter(F.col("scanner") == SCANNER)
        .select("pkg", "version", F.col("file").alias("path"), "line", "sighting.*")
        .filter(~ignored)
        .withColumn("key", F.when(is_url, F.lower(raw)).otherwise(raw))
    )


def without_hosts(seen: DataFrame, domains: DataFrame) -> DataFrame:
    """Sightings whose host is no ``domain`` of the given table and not below one.

    For lists of any length, beside the built-in one: distinct hosts meet the list by each run of their
    trailing labels, and sightings lose the hosts that were found there.  Spark broadcasts either side by
    its measured size and otherwise splits a hot host.  Addresses stay; case does not matter; null and
    empty entries match nothing; a list may repeat itself.
    """
    listed = domains.select(F.lower("domain").alias("_suffix")).filter("_suffix <> ''")
    hosted = seen.withColumn("_host", F.when(F.col("type") == "url", urls.host(F.col("raw"))))
    hosts = hosted.filter("_host <> ''").select("_host").distinct()
    labels = F.split("_host", "[.]")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    ignored = hosts.select("_host", F.explode(suffixes).alias("_suffix")).join(listed, "_suffix", "left_semi")
    return hosted.join(ignored.select("_host"), "_host", "left_anti").drop("_host")


_IDENTITY = ["pkg", "version", "type", "key"]


def locations(seen: DataFrame) -> DataFrame:
    """The first five sightings of each distinct indicator, numbered."""
    order = Window.partitionBy(*_IDENTITY).orderBy("path", "line", "step", "fragment", "nth")
    return (
        seen.withColumn("nth_location", F.row_number().over(order))
        .filter(F.col("nth_location") <= rules.MAX_LOCATIONS)
        .select(
            *_IDENTITY,
            F.when(F.col("type") == "url", urls.defang_url(F.col("raw")))
            .otherwise(urls.defang_ip(F.col("raw")))
            .alias("defanged"),
            "method",
            "nth_location",
            F.col("path").alias("file"),
            "line",
        )
    )


def indicators(seen: DataFrame) -> DataFrame:
    """One row per distinct indicator: first sighting and the (capped) number of locations."""
    first = F.struct("defanged", "method", "file", "line")
    return (
        locations(seen)
        .groupBy(*_IDENTITY)
        .agg(
            F.min_by(first, "nth_location").alias("first"),
            F.count("*").alias("n_locations"),
        )
        .select(*_IDENTITY, "first.*", "n_locations")
    )


def findings(distinct: DataFrame) -> DataFrame:
    """Findings from :func:`indicators`: info when seen plainly first, warning when decoded."""
    hidden = F.col("method").isNotNull()
    kind = F.when(F.col("type") == "url", "URL").otherwise("IP")
    label = F.when(hidden, F.concat(kind, F.lit(" ("), F.col("method"), F.lit("-decoded)")))
    label = label.otherwise(F.concat(F.lit("External "), kind))
    parts = F.concat_ws(
        "; ",
        F.when(hidden, F.concat(F.lit("Decoded from "), F.col("method"), F.lit(" obfuscation"))),
        F.when(
            F.col("n_locations") > 1,
            F.concat(F.lit("Found in "), F.col("n_locations").cast("string"),
                     F.lit(" location(s)")),
        ),
    )
    return as_findings(
        distinct.select(
            "pkg",
            "version",
            F.lit(SCANNER).alias("scanner"),
            F.when(hidden, rules.WARNING).otherwise(rules.INFO).alias("severity"),
            F.col("type").alias("rule_id"),
            F.concat(label, F.lit(": "), F.col("defanged")).alias("message"),
            "file",
            "line",
            F.nullif(parts, F.lit("")).alias("evidence"),
        )
    )


def distinct_counts(seen: DataFrame) -> DataFrame:
    """Distinct URLs and addresses per package version."""
    return (
        seen.select(*_IDENTITY)
        .distinct()
        .groupBy("pkg", "version")
        .agg(
            F.count_if(F.col("type") == "url").alias("n_urls"),
            F.count_if(F.col("type") == "ipv4").alias("n_ips"),
        )
    )
