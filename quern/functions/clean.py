"""Cleaning of Markdown text as column expressions, in the order that clean_document applies them.

Everything is a built-in expression but Unicode normalisation, for which there is none.  A null text
stays null, an empty one empty.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Character classes and line patterns of the cleaning rules.
ZERO_WIDTH = "​‌‍﻿"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
FULL_FIRST, FULL_LAST, FULL_OFFSET = 0xFF01, 0xFF5E, 0xFEE0
PAGE_NUMBER = r"^(?:\s*[-–—]\s*\d+\s*[-–—]\s*$|Page\s+\d+\s+of\s+\d+\s*$|第\s*\d+\s*页\s*$|p[\.:]?\s*\d+\s*$)"
SEPARATOR = r"^[-_]{20,}\s*$"
HEADING = r"#{1,6}[^\S\n]"
LIST_ITEM = r"^(?:[-*+]|\d+\.)\s+"
# Pattern and replacement, in order; links go before images, so an image leaves its "!".
PASSAGE = [
    (r"```[\s\S]*?```", ""),
    (r"\|", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"<[^>]+>", ""),
    (r"`([^`]+)`", "$1"),
    (r"#{1,6}\s*", ""),
    (r"^\s*[-*+]\s+", ""),
    (r"^\s*\d+\.\s+", ""),
    (r"\n{3,}", "\n\n"),
]
#: Java's flags for Python's meaning of ^, $, . and \s.
LINES, UNICODE = "(?md)", "(?mdU)"


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_unicode(c: Column) -> Column:
    """NFC; only texts with a character that it could change go to Python, all below U+0300 are in that form."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\u02FF]"), c)), c)


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def fullwidth_to_halfwidth(c: Column) -> Column:
    full = range(FULL_FIRST, FULL_LAST + 1)
    return F.translate(c, "".join(map(chr, full)), "".join(chr(x - FULL_OFFSET) for x in full))


def normalize_line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_trailing_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, LINES + r"[ \t]+$", "")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{4,}", "\n\n\n")


def trim_file_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def ensure_heading_spacing(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)(?<=[^\n]\n)(?={HEADING})", "\n")


def ensure_list_spacing(c: Column) -> Column:
    """A blank line on either side of a run of list items; a fence right after a run needs none."""

    # The lines are bound once: transform over an array of one array.
    bound = F.transform(F.array(F.split(c, "\n")), lambda a: F.array_join(F.transform(a, lambda line, i: _spaced(a, line, i)), "\n"))
    return F.when(c.rlike("(?mdU)" + LIST_ITEM), bound[0]).otherwise(c)


def _spaced(lines: Column, line: Column, i: Column) -> Column:
    before = F.get(lines, i - 1)
    item, was_item = line.rlike("(?U)" + LIST_ITEM), F.coalesce(before.rlike("(?U)" + LIST_ITEM), F.lit(False))
    opens = item & ~was_item & F.coalesce(before != "", F.lit(False))
    closes = was_item & ~item & ~line.startswith("```") & (line != "")
    return F.when(opens | closes, F.concat(F.lit("\n"), line)).otherwise(line)


def ensure_code_block_spacing(c: Column) -> Column:
    """A blank line before each opening fence: every second fence opens, counted from the first."""

    def spaced(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: _fenced(parts, p, i)), "")

    bound = F.transform(F.array(F.split(c, "(?md)^```")), spaced)
    return F.when(F.contains(c, F.lit("```")), bound[0]).otherwise(c)


def _fenced(parts: Column, part: Column, i: Column) -> Column:
    before = F.get(parts, i - 1)
    tight = (i % 2 == 1) & (before != "") & ~before.rlike(r"(?:\A|\n)\n\z")
    return F.when(i == 0, part).when(tight, F.concat(F.lit("\n```"), part)).otherwise(F.concat(F.lit("```"), part))


def remove_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, "(?imdU)" + PAGE_NUMBER, "")


def remove_separators(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + SEPARATOR, "")


#: The rules that need no Python, in order.
NATIVE = (remove_zero_width, remove_control_chars, fullwidth_to_halfwidth, normalize_line_endings, strip_trailing_whitespace, collapse_blank_lines, trim_file_ends, ensure_heading_spacing, ensure_list_spacing, remove_page_numbers, remove_separators)


def clean_native(c: Column) -> Column:
    return reduce(lambda x, f: f(x), NATIVE, c)


def clean_document(c: Column) -> Column:
    """All rules in order."""
    before = reduce(lambda x, f: f(x), NATIVE[:9], normalize_unicode(c))
    return remove_separators(remove_page_numbers(ensure_code_block_spacing(before)))


def with_clean_document(rows: DataFrame, column: str) -> DataFrame:
    """rows with clean_document of a column in its place; rules that name their text several times get it from a step before.

    As one expression, each such rule works out all rules before it again for each time that it names its text.
    """
    last = (remove_page_numbers, remove_separators)
    for steps in ((normalize_unicode,), NATIVE[:8], (ensure_list_spacing,), (ensure_code_block_spacing,), last):
        rows = rows.withColumn(column, reduce(lambda x, f: f(x), steps, F.col(column)))
    return rows


def clean_passage(c: Column) -> Column:
    """Markdown syntax stripped to plain text."""
    stripped = reduce(lambda x, p: F.regexp_replace(x, UNICODE + p[0], p[1]), PASSAGE, c)
    return F.regexp_replace(stripped, r"(?U)\A\s+|\s+\z", "")


def content_passes(c: Column, min_chars: int = 10) -> Column:
    return F.char_length(clean_passage(c)) >= min_chars
