"""Lines too long for one task: read in parts by all tasks, with the hits of the whole line.

Parts end behind a character that no pattern here has before its last one and that counts as no letter,
digit, dot or run to a pattern that looks back.  So a match lies in one part, and a part's matches are
the line's.  A run without such a character stays whole, as the decoders need it whole.  What a part
cannot know, whether it starts in a string literal, is followed from part to part (:mod:`automata`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions.sql import quote
from . import ioc, obfuscation, static_rules
from .automata import Automaton, effect, entries
from .hits import hit, literal_map, settle

_SEPARATORS = r"\"'`<>\]\[}{;"

_MARKS = "\"'`"
# State 0: code; 1: code behind a slash; then for each quote inside its literal and behind a backslash
# there; last: behind two slashes.
_COMMENTED = 2 + 2 * len(_MARKS)
_OPENING = {q: 2 + 2 * i for i, q in enumerate(_MARKS)}
_QUOTING = Automaton(
    "/\\" + _MARKS,
    (
        (1, 0, *_OPENING.values(), 0),
        (_COMMENTED, 0, *_OPENING.values(), 0),
        *(
            moves
            for q, state in _OPENING.items()
            for moves in (
                (state, state + 1, *(0 if other == q else state for other in _MARKS), state),
                (state,) * (len(_MARKS) + 3),
            )
        ),
        (_COMMENTED,) * (len(_MARKS) + 3),
    ),
)
#: A text that leads from the start to each state.
_LEADS = ("", "/", *(lead for q in _MARKS for lead in (q, q + "\\")), "//")


def cut(lines: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """``lines(*key, text, ...)`` to one row per part: all columns, ``part`` and the part as ``text``.

    A part has at least ``size`` code points, but for the last, and ends with the next separator.  Parts
    are dealt to all tasks by line and number.
    """
    if size < 1:
        raise ValueError("a part has at least one code point")
    parts = F.regexp_extract_all(
        "text", F.lit(f"(?s).{{1,{size}}}+[^{_SEPARATORS}]*+[{_SEPARATORS}]?+"), F.lit(0)
    )
    others = [c for c in lines.columns if c != "text"]
    return lines.select(*others, F.posexplode(parts).alias("part", "text")).repartition(*key, "part")


def _rule_look(rule: rules.LineRule) -> str:
    """What a part says of a rule: silenced, or matched and, for each state, whether outside code."""
    looks = ["CAST(NULL AS array<boolean>)"]
    if static_rules.looks_at_context(rule):
        before = static_rules.before_match(rule.pattern)
        looks = [
            f"NOT concat({quote(lead)}, {before}) RLIKE {quote(rules.CODE_PREFIX)}" for lead in _LEADS
        ]
        looks = [f"array({', '.join(looks)})"]
    name = f"'rule_id', {quote(rule.rule_id)}"
    matched = f"""CASE WHEN text RLIKE {quote(rule.pattern)} THEN
      named_struct({name}, 'silenced', false, 'outside', {looks[0]}) END"""
    if not rule.unless:
        return matched
    return f"""CASE WHEN text RLIKE {quote(rule.unless)} THEN named_struct({name},
      'silenced', true, 'outside', CAST(NULL AS array<boolean>)) ELSE {matched} END"""


def _static(parts: DataFrame, key: list[str], held: list[str]) -> DataFrame:
    code = parts.filter("code")
    looks = f"array_compact(array({', '.join(map(_rule_look, rules.STATIC_RULES))}))"
    seen = code.filter(static_rules.may_match(F.col("text"))).select(*held, "part", F.inline(F.expr(looks)))
    first = (
        seen.groupBy(*held, "rule_id")
        .agg(F.bool_or("silenced").alias("silenced"), F.min(F.struct("part", "outside")).alias("first"))
        .filter("NOT silenced")
        .select(*held, "rule_id", "first.*")
    )
    effects = code.select(*key, "part", effect(_QUOTING, F.col("text")).alias("effect"), F.lit(0).alias("n"))
    entered = entries(effects, key, "part").drop("before")
    by_id = {r.rule_id: r for r in rules.STATIC_RULES}
    rule = F.col("rule_id")
    quoted = F.col("outside").isNotNull() & (F.col("in_comment") | F.col("outside")[F.col("entry")])
    found = hit(
        static_rules.SCANNER,
        rule,
        literal_map({i: r.severity for i, r in by_id.items()})[rule],
        literal_map({i: r.message for i, r in by_id.items()})[rule],
        F.col("line"),
        shows_line=True,
    ).withField("quoted", F.coalesce(quoted, F.lit(False)))
    return first.join(entered, [*key, "part"]).select(*held, found.alias("hit"))


def _obfuscation(parts: DataFrame, held: list[str]) -> DataFrame:
    text = F.col("text")
    seen = (
        parts.filter("code")
        .groupBy(*held)
        .agg(
            F.bool_or(obfuscation.has_hex_run(text)).alias("_hex"),
            F.bool_or(obfuscation.has_base64_run(text)).alias("_base64"),
        )
    )
    found = obfuscation.measured_hits(
        F.col("_hex"), F.col("_base64"), F.col("units"), F.col("line"), F.col("minified")
    )
    return seen.select(*held, F.explode(found).alias("hit"))


def _network(parts: DataFrame, held: list[str]) -> DataFrame:
    text = F.col("text")
    found = parts.filter(F.col("text_file") & ioc.may_match(text)).select(
        *held, "part", F.explode(ioc.line_hits(text, F.col("line"))).alias("hit")
    )
    order = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("hit.sighting.fragment")
    return found.select(*held, F.col("hit").withField("sighting.fragment", order).alias("hit"))


def hits(lines: DataFrame, scanners: Sequence[str], size: int, carry: Sequence[str] = ()) -> DataFrame:
    """Settled hits of the built-in line rules: static, obfuscation and network indicators.

    ``lines`` has ``pkg, version, file, line, text, in_comment, code`` and, for the scanners that need
    them, ``minified`` and ``text_file``.  The hits are those of the whole lines at any ``size``.  A line
    of one release, file and number with one text counts once.
    """
    text = F.col("text")
    flags = [c for c in ("code", "text_file", "minified") if c in lines.columns]
    # Lines are told apart by their text too, should a table hold a path twice.
    key = ["pkg", "version", "file", "line", "_text"]
    named = lines.select(
        "pkg", "version", "file", "line", F.xxhash64("text").alias("_text"), "in_comment", *flags, *carry,
        tx.line_head(text).alias("head"), tx.utf16_length(text).alias("units"), "text",
    )
    parts = cut(named, key, size)
    held = [*key, "in_comment", *flags, *carry, "head", "units"]
    found = []
    if static_rules.SCANNER in scanners:
        found.append(_static(parts, key, held))
    if obfuscation.SCANNER in scanners:
        found.append(_obfuscation(parts, held))
    if ioc.SCANNER in scanners:
        found.append(_network(parts, held))
    columns = ["pkg", "version", "file", *carry, "head"]
    every = found[0].select(*columns, "hit")
    for more in found[1:]:
        every = every.union(more.select(*columns, "hit"))
    return settle(every.select(*columns, "hit.*"), F.col("head"))
