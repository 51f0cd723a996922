"""Line-first cleaning with built-in expressions.

Each line is tested on its own: too many marks, a navigation bar, phrases of boilerplate that are most
of its words.  Failing lines are removed, and a document that loses too much of its text that way is rejected.  Counts of the whole
text reject documents that are too short or repeat themselves.  Everything is computed in the row
that holds the text: one pass, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import own_columns

BLANK = r"[ \t-\r]"
# Punctuation of sentences, citations, numbers and code: a few such marks (one, of ! and ?) with a word or
# the end after them make a place, and up to eight places in a row count as one mark.  All other marks count
# one by one: symbols, long runs, and what stands next to either.
# Every repeat that could begin anywhere is bounded, so that the time stays linear on long runs.
_BOUND = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf},;'\""
_PLAIN = _BOUND + r"\p{Pd}.:/_=+…¿¡、。，：；·"
_WORDS = r"\p{L}\p{M}\p{N} \t-\r"
_TEXT = (
    r"[ \t]{0,2}(?:(?:\p{Sc}?\p{N}%|[\p{L}\p{M}\p{N}]|\p{Sc}\p{N})"
    rf"(?:[{_WORDS}]*(?:\p{{N}}%|[\p{{L}}\p{{M}}\p{{N}}]))?|\z)"
)
_CRY = rf"[!?！？][ \t]{{0,2}}(?:[{_PLAIN}][ \t]{{0,2}}){{0,2}}"
_OPERATOR = rf"[{_PLAIN}]{{0,2}}[ \t]{{1,2}}(?:&&|[|][|]|[<>!=]=|[<>*]|[=-]>)[ \t]{{1,2}}[{_PLAIN}]{{0,2}}"
_RUN = rf"[ \t]{{0,2}}(?:[.]{{3}}[\"'”’»]|(?:[{_BOUND}][ \t]{{0,2}}){{1,5}}|(?:[{_PLAIN}][ \t]{{0,2}}){{1,3}})(?:{_CRY})?"
MARKS = (
    rf"(?:[\p{{L}}\p{{M}}\p{{N}}]{_CRY}|\p{{N}}%|{_OPERATOR}|{_RUN}){_TEXT}(?:(?:{_OPERATOR}|{_RUN}|{_CRY}){_TEXT}){{0,7}}"
    rf"|[^{_WORDS}]"
)
PLAIN = rf"[^{_WORDS}]"
SEPARATORS = r"(?:^|[ \t])[|»›•·>](?:$|[ \t])"
# Blanks and ASCII marks between words, and a word; both as small classes, the same in Java and in RE2.
GAP = r"[ \t-\r!-/:-@\[-`{-~]"
WORD = GAP.replace("[", "[^", 1) + "+"


def _phrases(*phrases: str) -> str:
    """One of ``phrases``; ``_`` is a gap, ``*`` a word."""
    return "(?:" + "|".join(phrases).replace("*", WORD).replace("_", GAP + "+") + ")"


def _mostly(phrases: str, others: int) -> str:
    """A phrase with up to ``others`` more words before and after it together."""
    some = (rf"(?:{WORD}{GAP}+){{{n}}}{phrases}(?:{GAP}+{WORD}){{0,{others - n}}}" for n in range(others + 1))
    return "|".join(some)


_FOUR = _phrases("skip_to_main_content")
_THREE = _phrases(
    "all_rights_reserved", "terms_of_(?:use|service)", "our_(?:privacy|cookie)_policy", "log_in_to", "back_to_top",
    "skip_to_content", "share_on_(?:facebook|twitter)", "subscribe_to_our",
)
_TWO = _phrases(
    "privacy_policy", "cookie_(?:policy|settings)", "uses_cookies", "enable_javascript", "click_here", "sign_up",
    "lorem_ipsum",
)
_LONG = _phrases(
    "copyright_(?:*_){0,8}all_rights_reserved", "©_(?:*_){0,8}all_rights_reserved", "skip_to_main_content",
    "(?:this|our)_(?:web)?site_uses_cookies(?:_(?:to|for)(?:_*){1,8})?", "click_here_(?:to|for)(?:_*){1,4}",
    "sign_up_(?:for|to)_(?:our|the)(?:_*){1,3}", "(?:you_must|please)_log_in_to(?:_*){1,4}",
    "please_enable_javascript(?:_(?:to|in)(?:_*){1,6})?", "subscribe_to_our(?:_*){1,4}",
)
# Phrases of two, three and four words or more are over half of the line's words: up to fifty with
# nothing between them, or up to three with other words (few, as their splits are tried one by one).
BOILERPLATE = (
    rf"(?i)\A{GAP}*(?:(?:(?:{_FOUR}|{_THREE}|{_TWO})(?:{GAP}+|\z)){{1,50}}\z"
    rf"|(?:(?:{_mostly(_LONG, 3)}|{_mostly(_THREE, 2)}|{_mostly(_TWO, 1)})(?:{GAP}+|\z)){{1,3}}\z)"
)
SYMBOLS = "[#*$%&|<>]"
MIN_MARKS, MARK_PERCENT = 4, 15
MIN_SEPARATORS, SEPARATOR_PERCENT = 3, 15
MIN_WORDS, REPEAT_PERCENT, WINDOW, LOSS_PERCENT = 20, 30, 8, 30


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside the lambdas of ``use``."""
    return F.transform(F.array(value), use)[0]


def _reaches(count: Column, least: int, percent: int, size) -> Column:
    """Whether ``count`` is ``least`` and more than ``percent`` of ``size()``, which is computed only then."""
    return _bound(count, lambda n: F.when(n >= least, n * 100 > size() * percent).otherwise(False))


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule.

    Every match of ``MARKS`` and of ``SEPARATORS`` has a character of its own that is no letter, number or
    blank, so a line without enough of these needs neither pattern.
    """
    def size():
        return F.length(line)

    def words():
        return F.regexp_count(line, F.lit(r"[^ \t-\r]+"))

    def by_marks(plain: Column) -> Column:
        enough = _reaches(plain, MIN_MARKS, MARK_PERCENT, size)
        marks = F.when(enough, _reaches(F.regexp_count(line, F.lit(MARKS)), MIN_MARKS, MARK_PERCENT, size)).otherwise(False)
        bars = _reaches(F.regexp_count(line, F.lit(SEPARATORS)), MIN_SEPARATORS, SEPARATOR_PERCENT, words)
        return F.when(plain >= min(MIN_MARKS, MIN_SEPARATORS), marks | bars).otherwise(False)

    return _bound(F.regexp_count(line, F.lit(PLAIN)), by_marks) | line.rlike(BOILERPLATE)


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur at least twice, from 64-bit hashes of the windows.

    A window's hash is made of those of its halves, down to single words.  The windows are only sorted where two of them are equal at all.
    """

    def covered(hashes: Column) -> Column:
        def neighbours(pairs: Column) -> Column:
            n = F.size(pairs)
            equal = F.filter(
                F.sequence(F.lit(1), n),
                lambda i: ((i > 1) & (F.element_at(pairs, F.greatest(i - 1, F.lit(1)))["h"] == F.element_at(pairs, i)["h"]))
                | ((i < n) & (F.element_at(pairs, F.least(i + 1, n))["h"] == F.element_at(pairs, i)["h"])),
            )
            places = F.array_sort(F.transform(equal, lambda i: F.element_at(pairs, i)["p"]))
            return _bound(
                places,
                lambda p: F.aggregate(
                    p,
                    F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
                    lambda a, x: F.struct(
                        (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum"), x.alias("last")
                    ),
                )["sum"],
            )

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(pairs, neighbours)).otherwise(0)

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of windows of ``2 * width`` words from those of ``width``."""
        n = F.size(hashes) - width
        ahead = F.slice(hashes, 1, n), F.slice(hashes, width + 1, n)
        return _bound(F.zip_with(*ahead, lambda a, b: F.xxhash64(a, b)), lambda x: x if 2 * width == WINDOW else doubled(x, 2 * width))

    single = F.transform(words, lambda w: F.xxhash64(w))
    hashes = _bound(single, lambda x: doubled(x, 1))
    return F.when(F.size(words) >= WINDOW, _bound(hashes, covered)).otherwise(0).cast("bigint")


def judged(text: Column) -> Column:
    """All counts, verdicts and the cleaned text of one text, as a struct; null counts as empty."""

    def by_word(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def by_line(lines: Column) -> Column:
        good = F.filter(lines, lambda line: ~line_fails(line))
        with_word = F.filter(lines, lambda line: line.rlike(r"[^ \t-\r]"))
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            _bound(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _bound(good, lambda x: F.struct(F.size(x).alias("n"), F.array_join(x, "\n").alias("text"))).alias("good"),
        )

    def verdicts(text: Column, w: Column, x: Column) -> Column:
        lost = F.length(text) - F.length(x["good"]["text"])
        failed = (w["n_words"] < MIN_WORDS) | (w["n_repeat_words"] * 100 > w["n_words"] * REPEAT_PERCENT)
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            x["n_lines"].alias("n_lines"), (x["n_lines"] - x["good"]["n"]).alias("n_bad_lines"),
            lost.cast("bigint").alias("lost_chars"), failed.alias("base_failed"),
            (~failed & (lost * 100 <= F.length(text) * LOSS_PERCENT)).alias("kept"),
            x["good"]["text"].alias("cleaned"),
        )

    def by_text(text: Column) -> Column:
        words = F.array_remove(F.split(text, BLANK + "+"), "")
        return _bound(
            _bound(words, by_word),
            lambda w: _bound(_bound(F.split(text, "\n"), by_line), lambda x: verdicts(text, w, x)),
        )

    return _bound(F.coalesce(text, F.lit("")), by_text)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the fields of ``judged`` for every row.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, lost_chars,
    base_failed, kept, cleaned``.  A null text has no words and fails; a null ``doc_id`` and repeated
    rows are kept as they are.  A text is judged whole, however long, in time that grows with its length;
    an empty table gives no rows.
    """
    texts = own_columns(docs, id_col, text_col)
    return texts.select("doc_id", judged(F.col("text")).alias("found")).select("doc_id", "found.*")


def clean(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; texts lose the lines that fail.

    ``size_col`` is the column that has the text's length in characters, if there is one.  Null and empty
    texts have too few words and go; null ids and repeated rows are judged like any other; an empty table
    stays empty.
    """
    found = "quality_" + "_".join(docs.columns)  # no column of this name can be there
    new = {text_col: F.col(f"`{found}`.cleaned")}
    if size_col:
        new[size_col] = F.length(new[text_col]).cast(docs.schema[size_col].dataType)
    # Exploding an array of one keeps the verdict a column: as an expression, the filter and each of
    # the new columns would compute it again.
    rows = docs.select("*", F.explode(F.array(judged(docs[text_col]))).alias(found))
    judged_rows = rows.where(F.col(f"`{found}`.kept"))
    return judged_rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
