"""The column functions under names for SQL, and the throttle as a table function.

``register(spark)`` makes them known to the session. The scalar ones are SQL functions whose bodies Catalyst puts in place, so they are
optimised and generated like any other expression. ``throttle`` takes a table by partition and order::

    SELECT * FROM throttle(TABLE(pulls) PARTITION BY user_id ORDER BY (ts, id), 'ts', 21600)

``register_rules`` makes a small rule table into two functions, ``satisfied(line)`` and ``active(src)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewire.functions.render import DATE_LAYOUT
from tidewire.functions.text import _BETWEEN, _TRIM, _WORD_END, EMPTY_KEY, SPACE
from tidewire.plans.patterns import line_regex, stays_in_word, translate
from tidewire.plans.rules import Rule

#: name -> (parameters, type, body)
FUNCTIONS = {
    "token_line": ("text STRING", "STRING", rf"trim(BOTH '\n' FROM regexp_replace(regexp_replace(concat(' ', text), r'{_WORD_END}', ''), r'{_BETWEEN}', '\n'))"),
    "line_words": ("line STRING", "ARRAY<STRING>", r"array_remove(split(coalesce(line, ''), '\n'), '')"),
    "tokenize": ("text STRING", "ARRAY<STRING>", "line_words(token_line(text))"),
    "dedup_key": ("line STRING", "STRING", rf"CASE WHEN coalesce(line, '') = '' THEN '{EMPTY_KEY}' ELSE md5(translate(line, '\n', ' ')) END"),
    "is_blank": ("text STRING", "BOOLEAN", f"NOT coalesce(text RLIKE r'[^{SPACE}]', false)"),
    "trim_space": ("text STRING", "STRING", f"regexp_replace(text, r'{_TRIM}', '')"),
    "split_trim": ("text STRING, separator STRING", "ARRAY<STRING>",
                   rf"filter(transform(split(text, concat(r'\Q', separator, r'\E')), p -> regexp_replace(p, r'{_TRIM}', '')), p -> p <> '')"),
    "affix_match": ("name STRING, globs ARRAY<STRING>", "BOOLEAN", "size(globs) = 0 OR exists(globs, g -> startswith(name, g) OR endswith(name, g))"),
    "muted": ("ts TIMESTAMP_NTZ, first INT, last INT", "BOOLEAN",
              "coalesce(first = last OR pmod(hour(ts) - first, 24) < pmod(last - first, 24), false)"),
    "agency": ("name STRING", "STRING", "substring_index(name, '.', 1)"),
    "date_text": ("published TIMESTAMP_NTZ", "STRING", f"coalesce(date_format(published, '{DATE_LAYOUT}'), '')"),
    "query_escape": ("text STRING", "STRING", "replace(replace(url_encode(text), '*', '%2A'), '%7E', '~')"),
    "build_url": ("url_format STRING, message STRING", "STRING", "replace(url_format, '%s', query_escape(message))"),
}


class Throttle:
    """Rows of a partition at least so many seconds after the last one that passed; of the rows without a time, which come first, one."""

    def __init__(self):
        self.last = None
        self.timeless = False

    @staticmethod
    def analyze(rows: AnalyzeArgument, ts: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or ts.value not in rows.dataType.names:
            raise ValueError("throttle takes a table, the name of its time column and a number of seconds")
        return AnalyzeResult(schema=rows.dataType)

    def eval(self, rows: Row, ts: str, seconds: float) -> Iterator[tuple]:
        at = rows[ts]
        if at is None:
            passes, self.timeless = not self.timeless, True
        else:
            passes = self.last is None or at - self.last >= timedelta(seconds=float(seconds))
            if passes:
                self.last = at
        if passes:
            yield tuple(rows)


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("throttle", udtf(Throttle))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sequence_test(patterns: list[str]) -> str:
    """Do consecutive words of the token line ``line`` match the patterns?"""
    regexes = [translate(p).regex for p in patterns]
    if all(map(stays_in_word, patterns)):
        return f"(line <> '' AND line RLIKE {literal(line_regex(regexes))})"
    words = r"split(line, '\n')"
    starts = f"(size({words}) - {len(regexes) - 1})"
    slices = ", ".join(f"slice({words}, {k + 1}, greatest({starts}, 0))" for k in range(len(regexes)))
    tests = " AND ".join(f"w.`{k}` RLIKE {literal(r)}" for k, r in enumerate(regexes))
    return f"(line <> '' AND {starts} > 0 AND exists(arrays_zip({slices}), w -> {tests}))"


def condition(rule: Rule) -> str:
    conjs = [" AND ".join(map(sequence_test, dict.fromkeys(map(tuple, seqs)))) for seqs in rule.conjs if seqs]
    return " OR ".join(f"({conj})" for conj in conjs) or "false"


def coverage(rule: Rule) -> str:
    if not rule.sources or "" in rule.sources:
        return "true"
    return " OR ".join(f"startswith(src, {literal(g)}) OR endswith(src, {literal(g)})" for g in dict.fromkeys(rule.sources))


def register_rules(spark: SparkSession, rules: list[Rule]) -> None:
    """Compiled rules (:func:`plans.rules.compile_rules`) as functions of the session.

    ``satisfied(line)`` is the array of the ids of all rules that a token line satisfies, empty for a line without words or a missing one, and
    ``active(src)`` says whether some rule reads the source. Without rules nothing is satisfied or active.
    """
    kind = rules[0].id_type if rules else "int"
    hits = ", ".join(f"CASE WHEN {condition(rule)} THEN CAST({literal(str(rule.filter_id))} AS {kind}) END" for rule in rules)
    found = f"array_compact(array({hits}))" if rules else f"CAST(array() AS ARRAY<{kind}>)"
    read = " OR ".join(coverage(rule) for rule in rules) or "false"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION satisfied(line STRING) RETURNS ARRAY<{kind}> RETURN {found}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION active(src STRING) RETURNS BOOLEAN RETURN coalesce({read}, false)")
