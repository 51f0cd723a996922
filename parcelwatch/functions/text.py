"""String and path expressions with the exact semantics the rules are written against."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    return any_of([col.contains(w) for w in words])


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: a code point outside the basic plane counts twice."""
    # Only text with 4-byte characters can differ, and then it is longer in bytes than in points.
    return F.when(
        F.octet_length(col) == F.length(col), F.length(col)
    ).otherwise((F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int"))


def longer_than(col: Column, limit: int) -> Column:
    """``utf16_length(col) > limit``, skipping the count when the bytes already rule it out."""
    return (F.octet_length(col) > limit) & (utf16_length(col) > limit)


def utf16_left(col: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; half of a split pair is dropped, as UTF-8 cannot hold it."""
    head = F.substring(col, 1, units)
    raw = F.substring(F.encode(head, "UTF-16BE"), 1, 2 * units)
    split = F.hex(F.substring(raw, 2 * units - 1, 1)).rlike("^D[89AB]$")
    whole = F.when(split, F.substring(raw, 1, 2 * units - 2)).otherwise(raw)
    return F.when(head.rlike(_ASTRAL), F.decode(whole, "UTF-16BE")).otherwise(head)


def utf16_right(col: Column, units: int) -> Column:
    """Last ``units`` UTF-16 units; half of a split pair is dropped."""
    tail = F.right(col, F.lit(units))
    raw = F.encode(tail, "UTF-16BE")
    size = F.octet_length(raw)
    cut = F.when(size > 2 * units, F.substr(raw, size - 2 * units + 1)).otherwise(raw)
    split = F.hex(F.substring(cut, 1, 1)).rlike("^D[CDEF]$")
    whole = F.when(split, F.substring(cut, 3, 2 * units)).otherwise(cut)
    return F.when(tail.rlike(_ASTRAL), F.decode(whole, "UTF-16BE")).otherwise(tail)


def js_trim(col: Column) -> Column:
    # The look-behind keeps a long run of blanks inside the text from being tried at every place.
    return F.regexp_replace(col, rf"\A{rules.WS}++|(?<!{rules.WS}){rules.WS}++\z", "")


_EVIDENCE_UNITS = 200


def line_head(line: Column) -> Column:
    """Start of the trimmed line: all that evidence can need."""
    return F.substring(js_trim(line), 1, _EVIDENCE_UNITS)


def evidence(head: Column) -> Column:
    """At most 200 units of a :func:`line_head`."""
    return utf16_left(head, _EVIDENCE_UNITS)


# --- paths ----------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text from the last dot of the file name; empty for none, and for a name's leading dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1)


def is_vendored(path: Column) -> Column:
    return path.contains(rules.VENDOR_MARK)


def is_test_file(path: Column) -> Column:
    names = "|".join(rules.TEST_SEGMENTS)
    return path.rlike(rf"(?:\A|[\\/])(?:{names})(?:[\\/]|\z)") | path.rlike(rules.TEST_FILE_NAME)


def is_code_file(path: Column) -> Column:
    """Runtime JavaScript or TypeScript: no declarations, vendored code or tests."""
    return (
        extension(path).isin(*rules.CODE_EXTENSIONS)
        & ~any_of([path.endswith(s) for s in rules.DECLARATION_SUFFIXES])
        & ~is_vendored(path)
        & ~is_test_file(path)
    )


def is_text_file(path: Column) -> Column:
    return F.lower(extension(path)).isin(*rules.TEXT_EXTENSIONS) & ~is_vendored(path)


def is_binary_file(path: Column) -> Column:
    return F.lower(extension(path)).isin(*rules.BINARY_EXTENSIONS) & ~is_vendored(path)


def size_label(n_bytes: Column) -> Column:
    """``11469`` -> ``11.2 KB``; at most gigabytes."""
    units = ("B", "KB", "MB", "GB")
    label = F.when(n_bytes < 1024, F.format_string("%d B", n_bytes.cast("long")))
    for power in (1, 2):
        label = label.when(
            n_bytes < 1024 ** (power + 1),
            F.format_string(f"%.1f {units[power]}", n_bytes / float(1024**power)),
        )
    return label.otherwise(F.format_string("%.1f GB", n_bytes / float(1024**3)))
