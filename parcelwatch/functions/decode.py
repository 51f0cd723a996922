"""Decoders for text hidden in source code: escapes, character codes, base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import text as tx


def from_utf16_hex(units: Column) -> Column:
    """Hex digits of UTF-16 units to text; an unpaired surrogate becomes U+FFFD."""
    spaced = F.regexp_replace(F.lower(units), "(.{4})", "$1 ")
    for pattern in (
        r"d[89ab][0-9a-f]{2} (?!d[c-f][0-9a-f]{2} )",
        r"(?<!d[89ab][0-9a-f]{2} )d[c-f][0-9a-f]{2} ",
    ):
        spaced = F.regexp_replace(spaced, pattern, "fffd ")
    return F.decode(F.unhex(F.regexp_replace(spaced, " ", "")), "UTF-16BE")


def hex_escapes(match: Column) -> Column:
    digits = F.replace(match, F.lit("\\x"), F.lit(""))
    return F.decode(F.unhex(digits), "ISO-8859-1")


def unicode_escapes(match: Column) -> Column:
    return from_utf16_hex(F.replace(match, F.lit("\\u"), F.lit("")))


def char_codes(code_list: Column) -> Column:
    """Comma-separated code list to text; null if any entry is no code or there are under four."""
    codes = F.transform(
        F.split(code_list, ",", -1),
        lambda c: F.regexp_extract(c, rf"\A{rules.WS}*([0-9]+)", 1).try_cast("bigint"),
    )
    usable = (F.size(codes) >= 4) & F.forall(codes, lambda c: c.isNotNull() & (c <= 0x10FFFF))
    units = F.transform(codes, lambda c: F.lpad(F.hex(c % 65536), 4, "0"))
    return F.when(usable, from_utf16_hex(F.array_join(units, "")))


def base64_blob(match: Column) -> Column:
    """Decoded text if it is long enough and mostly printable ASCII, else null."""
    text = F.make_valid_utf8(F.unbase64(match).cast("string"))
    length = tx.utf16_length(text)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7e]", ""))
    return F.when(
        (length >= rules.BASE64_MIN_LENGTH) & (printable / length > rules.BASE64_PRINTABLE), text
    )
