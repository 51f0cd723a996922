"""License scans: canonical digests of whole texts and of single lines, looked up among known ones.

A text is brought to a canonical form: lower case, copyright lines gone, equivalent spellings made
one, punctuation and blanks turned to single spaces.  Its digest is hash-joined to the digests of
known licenses; so is that of every line that speaks of a license.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns

_TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
_NO_NAMES = r"(?ms)^3\..*?(?=^THIS SOFTWARE)"  # the clause that BSD-2-Clause lacks
# Words of BSD texts that name the holder in one or the other way.
_BSD = {"BSD-3-Clause": _TEXTS["BSD-3-Clause"], "BSD-2-Clause": re.sub(_NO_NAMES, "", _TEXTS["BSD-3-Clause"])}
_TITLES = {
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
}
# Identifiers of SPDX lines; those that only say "only" or nothing name the version itself.
_SPDX = (
    "0BSD", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib", "LGPL", "Apache-2.0 OR MIT", "MIT OR Apache-2.0",
)
_VERSIONS = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")


def _whole(title: str, text: str) -> tuple[str, ...]:
    """A text with its title lines and without them, and up to the end of its terms."""
    body = text[text.index(title) + len(title) :] if title in text else text
    ends = ("END OF TERMS AND CONDITIONS",)
    terms = [t[: t.index(e) + n * len(e)] for t in (text, body) for e in ends if e in t for n in (0, 1)]
    return (text, body, *terms)


_STARTS = {
    "Apache-2.0": "http://www.apache.org/licenses/", "GPL-2.0": "Version 2, June 1991", "GPL-3.0": "Version 3, 29 June 2007",
    "LGPL-2.1": "Version 2.1, February 1999", "LGPL-3.0": "Version 3, 29 June 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================", "CC0-1.0": "CC0 1.0 Universal",
}
# Public notices and license texts, by identifier.  Fixed values.
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
)
_BODIES = _BSD | {"ISC": dict(_NOTICES)["ISC"], "MIT": _NOTICES[-1][1].removeprefix("MIT License\n\n")}
KNOWN: tuple[tuple[str, str], ...] = (
    *((i, f"SPDX-License-Identifier: {i}") for i in _SPDX),
    *((i, f"SPDX-License-Identifier: {i}{end}") for i in _VERSIONS for end in ("", "-only")),
    *((i, text) for i, own in _TEXTS.items() if i not in _BSD for text in _whole(_STARTS.get(i, "\0"), own)),
    *(
        (i, f"{title}\n\n{text}")
        for i, body in _BODIES.items()
        for text in (body, re.sub(r"(?m)^[0-9]\.", "*", body))  # clauses with and without numbers
        for title in ("", *_TITLES[i])
    ),
    *_NOTICES,
)
# Spellings that mean the same, after lower case and before punctuation goes.
SAME: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("http://", "https://"), ("&", " and "), ("organisation", "organization"),
    ("non-infringement", "noninfringement"), ("sub-license", "sublicense"),
    ("favour", "favor"), ("merchantibility", "merchantability"),
)
# Spellings of two words, after blanks have become single spaces.
SAME_WORDS: tuple[tuple[str, str], ...] = (("copyright owner", "copyright holder"), ("per cent", "percent"))
# What stands next to copyright lines in some licenses: where lines are wrapped anew, they share a line.
_BESIDE = (
    "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed[.]?",
    "51 franklin street, fifth floor, boston, ma 02110-1301,? usa",
    "copyright [(]c[)] <year> <name of author>",
)
BESIDE = "(?:" + "|".join(_BESIDE).replace(" ", r"[ \t\n]+") + ")"
# "(c)" alone is a mark only before a year: it also numbers the items of a list.
# Years may come before or after the mark; "copyright notice" and the like are part of a license.  A name may
# stand before the year if the line ends there: a sentence goes on.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/]*(?:(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|[\[{<]y)|\(c\)[ \t]+(?:[0-9]{4}|copyright)|©)[^\n]*(?:\n[ \t]*<[^>\n]*>[ \t]*(?m:$))?"
    r"|copyright:?[ \t]+(?:[^ \t-\r0-9]+[ \t]+){1,8}[(]?[0-9]{4}(?:[ \t]*[,–-][ \t]*(?:[0-9]{4}|present))*[)]?"
    r"[.,;]?(?:[ \t]+all rights reserved)?[.]?[ \t]*(?:[\r\x{85}\x{2028}\x{2029}][^\n]*)?(?m:$))"
)
ABOUT = r"(?i)licen[cs]e|permission"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), BESIDE, "\n"), COPYRIGHT_LINE, "$1")
    for spelling, same in SAME:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelling, same in SAME_WORDS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """``known_digest, license_id``, one row per digest; its size is that of ``known``."""
    table = spark.createDataFrame(list(known), "license_id string, known string")
    return table.groupBy(digest(F.col("known")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(
    docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_digest, text_license, n_license_lines, line_licenses`` of every row.

    ``text_license`` names the license that the whole text is, null if none; ``line_licenses`` those
    that single lines state, in order and joined by commas, empty if none.  A null text counts as
    empty; an empty canonical form is no license, and an empty table gives no rows.  A very long text is
    digested in its row.  A null ``doc_id`` and repeated rows are kept.  The
    known digests are broadcast; their number is the caller's.
    """
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(ABOUT))
    found = F.when(F.col("text").rlike(ABOUT), F.transform(lines, digest)).otherwise(F.array().cast("array<string>"))
    rows = own_columns(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("text_digest"),
        found.alias("lines"),
    )
    table = F.broadcast(known_digests(docs.sparkSession, known))
    whole = rows.join(table, F.col("text_digest") == F.col("known_digest"), "left").select(
        "row", "doc_id", "text_digest", F.col("license_id").alias("text_license"),
        F.explode_outer("lines").alias("line"),
    )
    by_line = whole.join(table, F.col("line") == F.col("known_digest"), "left")
    return by_line.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_digest").alias("text_digest"),
        F.first("text_license").alias("text_license"), F.count("license_id").alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"),
    ).drop("row")
