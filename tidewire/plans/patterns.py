"""Word patterns to regular expressions.

A word pattern is a prefix match unless it starts with ``*``; a lower-case letter stands for
both cases, any other letter only for itself; parentheses hold raw, case-free regex; ``$``
ends the word, ``$`` and one letter stand for a set of noun endings.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Noun endings by the letter after "$".
ENDINGS = {
    "а": "а у ы е ой",
    "А": "а у ы е ой ы ам ах ами",
    "я": "я ю и ей",
    "Я": "я ю и ей и ь ям ями ях",
    "и": "ия ий ие ию ии ией ием",
    "И": "ия ий ие ию ии ией ием ий иев иям иями иях",
    "ъ": "е а у ом",
    "Ъ": "е а у ом ы и ов ей ам ами ах",
    "o": "o е а у ом",
    "O": "o е а у ом ы и ов ей ам ами ах",
    "ь": "ь й е ё я ю ью и ем ём",
    "Ь": "ь й е ё я ю ью и ем ём ей ев ёв ям ам ями ами ах ях",
}
# Letters that share the endings of another letter.
SAME_ENDINGS = {"a": "а", "A": "А", "е": "ь", "Е": "Ь", "e": "ь", "E": "Ь"}
# Letters whose endings include the empty one.
BARE_ENDINGS = "ъЪ"

CASE_FREE = "(?iu:"

_PATTERN = regex.compile(
    r"(?P<star>\*?)(?P<body>(?:(?P<group>\((?:[^()$]|(?&group))*\))|[^()*$])*)(?P<end>(?:\$.*)?)",
    regex.DOTALL,
)
_PIECE = regex.compile(
    r"(?P<group>\((?:[^()]|(?&group))*\))"  # raw regex
    r"|(?P<soft>\p{Ll}[^()\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*)"  # from a lower-case letter on
    r"|(?P<hard>[^()\p{Ll}]+)",
    regex.DOTALL,
)
# Constructs the two regex dialects (Java here, RE2 in the SQL oracle) read differently.
_NOT_PORTABLE = regex.compile(
    r"[+*?}]\+"  # possessive
    r"|\\[0-9]|\\[^\p{P}\p{S}AbBzdDsSwWpPaftnrvxQE]"  # back references, unknown escapes
    r"|\[\[|\[[^\]\\]*(?:\[|&&)"  # named or nested classes
    r"|\{(?:\d*,)?\d{5,}|\{(?:\d*,)?(?:[2-9]\d{3}|1[1-9]\d\d|10[1-9]\d|100[1-9])"  # counts above 1000
)
# What a pattern may hold to be searched on a whole token line: nothing that can eat the
# newline between two words.
_CROSSES_WORDS = regex.compile(r"\s|\\[A-Za-wyzA-Z0-9]|\\x(?!26)|\[[^\]]*\\|\[\^|\[[^\]]*[\x00-\x1f]")
# Bodies that stand for their own letters, in both cases or one, and hold no regex.
_PLAIN = regex.compile(r"[\p{Ll}\p{Lu}\p{Nd}'_-]*")
# A character no plain body holds.
OTHER = "\uE000"
_NOT_LITERAL = regex.compile(r"\\.|\[[^\]]*\]|(?P<group>\((?:[^()]|(?&group))*\))", regex.DOTALL)


class Translated(NamedTuple):
    regex: str
    probe: str  # "^abc": words must start so; "abc": words must hold it; "": any word may match


def _ending(mark: str) -> str | None:
    letters = mark[1:]
    if not letters:
        return "$"
    letter = SAME_ENDINGS.get(letters[-1], letters[-1])
    if len(letters.encode()) > 2 or letter not in ENDINGS:
        return None
    empty = "|" if letter in BARE_ENDINGS else ""
    return CASE_FREE + empty + "|".join(ENDINGS[letter].split()) + ")$"


def _probe(body: str, anchored: bool) -> str:
    """The literal letters any matching word must hold, in the form of an index probe."""
    plain = _NOT_LITERAL.sub("\0", body)
    if "|" in plain:
        return ""
    if anchored:
        head = regex.match(r"\p{L}*", plain).group()
        if regex.match(r"[?*{]", plain[len(head):]):
            head = head[:-1]
        return "^" + head if head else ""
    runs = [run[:-1] if after else run for run, after in regex.findall(r"(\p{L}+)([?*{]?)", plain)]
    best = max(runs, key=len, default="")
    return best if len(best) >= 3 else ""


def translate(pattern: str) -> Translated | None:
    """One pattern to its regex and index probe; None when it is malformed."""
    shape = _PATTERN.fullmatch(pattern)
    if shape is None:
        return None
    body, anchored = shape["body"], not shape["star"]
    out = ["^"] if anchored else []
    for piece in _PIECE.finditer(body):
        text = piece.group()
        if piece["group"]:
            out.append(text.replace("(", CASE_FREE))
        elif piece["soft"]:
            out.append(CASE_FREE + text + ")")
        else:
            out.append(text)
    if shape["end"] and body:  # a "$" with nothing before it adds no condition
        ending = _ending(shape["end"])
        if ending is None:
            return None
        out.append(ending)
    if _NOT_PORTABLE.search(body) or "\\(" in body or "\\)" in body:
        return None
    return Translated("".join(out), _probe(body, anchored))


def stays_in_word(pattern: str) -> bool:
    """Can the regex of this pattern be searched on a whole token line?"""
    return _CROSSES_WORDS.search(pattern) is None


def witnesses(pattern: str) -> list[str] | None:
    """The hardest words a plain pattern accepts: another plain pattern that accepts them accepts all of its words.

    Open ends go on with a character no body holds, and letters of both cases are lower-case, which only
    a letter of both cases accepts. There is a word for each ending. None for malformed patterns and raw regexes.
    """
    shape = _PATTERN.fullmatch(pattern)
    if translate(pattern) is None or not _PLAIN.fullmatch(shape["body"]):
        return None
    body, mark = shape["body"], shape["end"]
    start = OTHER + body if shape["star"] or not body else body
    if not body or not mark:
        return [start + OTHER]
    if mark == "$":
        return [start]
    letter = SAME_ENDINGS.get(mark[-1], mark[-1])
    return [start + end for end in ENDINGS[letter].split() + [""] * (letter in BARE_ENDINGS)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def witness_column(patterns: pd.Series) -> pd.Series:
    return patterns.map(witnesses)


def line_regex(regexes: list[str]) -> str:
    """Consecutive word regexes as one regex over a token line (``^``/``$`` at word edges)."""
    return "(?md)" + r"[^\n]*\n[^\n]*".join(f"(?:{r})" for r in regexes)


_TRANSLATED = T.StructType([T.StructField("regex", T.StringType()), T.StructField("probe", T.StringType())])


@F.pandas_udf(_TRANSLATED)
def translate_column(patterns: pd.Series) -> pd.DataFrame:
    found = [translate(p) or (None, None) for p in patterns]
    return pd.DataFrame(found, columns=["regex", "probe"])


def compiles(regex_column: Column) -> Column:
    """Does the regex compile where it will run?"""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), regex_column).isNotNull()


# Letters that plain lower-casing does not bring to the form case-free matching compares by.
_FOLDS = {"İ": "i"} | {
    c: c.upper().lower()
    for c in map(chr, range(0x80, 0x10000))
    if len(c.upper()) == 1 and len(c.upper().lower()) == 1 and c.upper().lower() != c.lower()
}


def fold(text: Column) -> Column:
    """Case folding that makes any two texts equal that case-free matching treats as equal."""
    return F.lower(F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values())))


def word_probes(word: Column) -> Column:
    """All probe keys a word answers to (see :func:`probe_key`)."""
    return folded_probes(fold(word))


def folded_probes(folded: Column) -> Column:
    """The same of a folded word, which had better be a column of its own: it is read many times."""
    length = F.length(folded)
    starts = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), length)),
        lambda n: F.concat(F.lit("^"), F.substring(folded, F.lit(1), n)),
    )
    triples = F.when(
        length >= 3,
        F.transform(F.sequence(F.lit(1), length - 2), lambda i: F.substring(folded, i, F.lit(3))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), starts, triples))


def probe_key(probe: Column) -> Column:
    """The one key under which a pattern is looked up: up to three folded letters."""
    anchored = probe.startswith("^")
    return F.when(anchored, F.substring(F.concat(F.lit("^"), fold(F.substring(probe, F.lit(2), F.length(probe)))), 1, 4)).otherwise(
        F.substring(fold(probe), 1, 3)
    )
