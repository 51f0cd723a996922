"""Credentials left in text files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..functions.sql import quote
from .hits import SIGHTING

SCANNER = "secrets"


def _rule_hits(rule: rules.SecretRule) -> str:
    return f"""transform(regexp_extract_all(text, {quote(rule.pattern)}, 0), found -> named_struct(
      'scanner', '{SCANNER}', 'rule_id', {quote(rule.rule_id)}, 'severity', {quote(rule.severity)},
      'message', {quote(rule.message)}, 'line', line,
      'evidence', concat(left(found, 4), '{rules.SECRET_MASK}', right(found, 4)),
      'shows_line', false, 'quoted', false,
      'sighting', CAST(NULL AS {SIGHTING})))"""


def line_hits() -> Column:
    """Array of hits of one line, one for every match of a rule; reads ``text`` and ``line``.

    The evidence shows the first and last four characters of the secret around a fixed mask.
    """
    return F.expr(f"flatten(array({', '.join(_rule_hits(r) for r in rules.SECRET_RULES)}))")


def may_match(line: Column) -> Column:
    return tx.contains_any(line, rules.SECRET_MARKERS) | tx.contains_any(
        F.lower(line), rules.SECRET_WORDS
    )
