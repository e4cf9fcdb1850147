"""Titles to words, and the small string and array helpers built on the same rules.

A title becomes one *token line*: its words joined by newlines, whitespace and edge
punctuation gone. A word never holds whitespace, so the line and the word array carry the
same information, and patterns and keys can work on the line with plain code-generated
string expressions instead of per-word lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters, as the inside of a regex class.
SPACE = r"\s\x{85}\p{Z}"

# A run of punctuation is entered at its first character only and never given back, so the
# cost stays linear on long rows of punctuation.
_WORD_END = rf"\p{{P}}(?<!\p{{P}}\p{{P}})\p{{P}}*+(?=[{SPACE}]|\z)"
_BETWEEN = rf"[{SPACE}][{SPACE}\p{{P}}]*+"
_TRIM = rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"

EMPTY_KEY = "0" * 32


def token_line(text: Column | str) -> Column:
    """The words of ``text`` joined by newlines; empty when there are none, null for null."""
    text = F.col(text) if isinstance(text, str) else text
    # the blank in front lets the first word shed its punctuation like any other
    ends = F.regexp_replace(F.concat(F.lit(" "), text), _WORD_END, "")
    return F.trim(F.regexp_replace(ends, _BETWEEN, "\n"), F.lit("\n"))


def line_words(line: Column) -> Column:
    """Token line to ``array<string>``; a missing title has no words."""
    return F.array_remove(F.split(F.coalesce(line, F.lit("")), "\n"), "")


def tokenize(text: Column | str) -> Column:
    """The words of ``text``: split on white space, punctuation trimmed at both word ends."""
    return line_words(token_line(text))


def dedup_key(line: Column) -> Column:
    """128-bit hex key of a token line; word boundaries count, titles without words share one key."""
    return F.when(F.coalesce(line, F.lit("")) == "", F.lit(EMPTY_KEY)).otherwise(
        F.md5(F.translate(line, "\n", " "))
    )


def is_blank(text: Column | str) -> Column:
    """True for null, empty or white-space-only text."""
    text = F.col(text) if isinstance(text, str) else text
    return ~F.coalesce(text.rlike(rf"[^{SPACE}]"), F.lit(False))


def trim_space(text: Column) -> Column:
    """Trim Unicode white space (the SQL ``trim`` only knows the plain blank)."""
    return F.regexp_replace(text, _TRIM, "")


def split_trim(text: Column | str, separator: str) -> Column:
    """Split by a literal separator, trim the parts, drop the empty ones."""
    text = F.col(text) if isinstance(text, str) else text
    quoted = rf"\Q{separator}\E"
    return F.filter(F.transform(F.split(text, quoted), trim_space), lambda part: part != "")


def index_of(items: Column, value: Column | str) -> Column:
    """0-based position of the first equal element, -1 when absent."""
    return (F.array_position(items, value) - 1).cast("int")


def contains(items: Column, value: Column | str) -> Column:
    return F.array_contains(items, value)


def append_absent(items: Column, value: Column) -> Column:
    """Append unless present; order stays."""
    return F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value))
