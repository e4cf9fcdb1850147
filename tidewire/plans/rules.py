"""Rules as tables: conditions cut into terms, checked, and small rule sets compiled to columns.

``cond`` reads: alternatives by ``;``, all-of parts by ``&``, consecutive words by blanks.
One row of ``rule_terms`` is one word pattern at its place. Part numbers count the non-blank
parts from 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.affix import affix_match_literal
from tidewire.functions.text import split_trim
from tidewire.plans.patterns import compiles, line_regex, stays_in_word, translate, translate_column

MAX_COLUMN_RULES = 64
MAX_COLUMN_TERMS = 2_000

SEQ = ["filter_id", "conj_id", "seq_id"]


def cond_tree(cond: Column | str) -> Column:
    """A condition as nested arrays: alternatives, their all-of parts, their words; null has none."""
    return F.transform(
        split_trim(F.coalesce(F.col(cond) if isinstance(cond, str) else cond, F.lit("")), ";"),
        lambda conj: F.transform(split_trim(conj, "&"), lambda seq: split_trim(seq, " ")),
    )


def rule_terms(filters: DataFrame) -> DataFrame:
    """``filters(filter_id, cond)`` to ``(filter_id, conj_id, seq_id, pos, pattern)``."""
    return (
        filters.select("filter_id", F.posexplode(cond_tree("cond")).alias("conj_id", "_conj"))
        .select("filter_id", "conj_id", F.posexplode("_conj").alias("seq_id", "_seq"))
        .select(*SEQ, F.posexplode("_seq").alias("pos", "pattern"))
    )


def translated_patterns(terms: DataFrame) -> DataFrame:
    """Each distinct pattern once, with its regex and probe; both null when it does not compile."""
    found = terms.select("pattern").distinct().withColumn("_t", translate_column("pattern"))
    usable = compiles(F.col("_t.regex"))
    return found.select(
        "pattern",
        F.when(usable, F.col("_t.regex")).alias("regex"),
        F.when(usable, F.col("_t.probe")).alias("probe"),
    )


def translated_terms(terms: DataFrame) -> DataFrame:
    """``rule_terms`` with ``regex`` and ``probe``."""
    return terms.join(translated_patterns(terms), "pattern")


def usable_terms(terms: DataFrame) -> DataFrame:
    """Translated terms of the rules in which every pattern compiles."""
    translated = translated_terms(terms)
    broken = translated.filter(F.col("regex").isNull()).select("filter_id").distinct()
    return translated.join(broken, "filter_id", "left_anti")


def rule_lint(filters: DataFrame) -> DataFrame:
    """Problems of rules as ``(filter_id, code, seq)``, ``seq`` the offending sequence text.

    ``PREFIX_DUP``: the sequence extends one that comes earlier in its rule. ``SHADOWED``: it is
    the beginning of an earlier one. ``ALWAYS_TRUE_CONJ``: an all-of part is also an alternative
    by itself. ``REPEATED_IN_CONJ``: named twice in one all-of. ``BAD_PATTERN``: no valid regex.
    ``NO_CONDITION``: nothing to match, so ``seq`` is empty.
    "Earlier" is by alternatives without ``&`` first, then by their length in bytes. Beginnings
    are found by an equi-join on the cut-off sequence, not by comparing all pairs.
    """
    alternatives = filters.select(
        "filter_id", F.posexplode(F.arrays_zip(split_trim("cond", ";").alias("text"), cond_tree("cond").alias("seqs"))).alias("conj_id", "_conj"))
    placed = alternatives.select(
        "filter_id", "conj_id",
        F.struct(F.col("_conj.text").contains("&").alias("a"), F.octet_length("_conj.text").alias("b"), F.col("conj_id").alias("c")).alias("_rank"),
        F.size("_conj.seqs").alias("_size"), F.posexplode("_conj.seqs").alias("seq_id", "patterns"),
    ).withColumn("seq", F.array_join("patterns", " "))
    distinct = placed.groupBy("filter_id", "seq").agg(
        F.min(F.struct("_rank", "seq_id")).alias("_first"),
        F.first("patterns").alias("patterns"),
        F.min("_size").alias("_least"), F.max("_size").alias("_most"),
    )
    # single-word sequences have no beginnings to look up
    begins = distinct.filter(F.size("patterns") > 1).select(
        "filter_id", F.col("seq").alias("_long"), F.col("_first").alias("_at"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("patterns") - 1),
                              lambda n: F.array_join(F.slice("patterns", 1, n), " "))).alias("seq"),
    )
    pairs = begins.join(distinct, ["filter_id", "seq"])
    short_first = F.col("_first") < F.col("_at")
    nested = pairs.select(
        "filter_id",
        F.when(short_first, "PREFIX_DUP").otherwise("SHADOWED").alias("code"),
        F.when(short_first, F.col("_long")).otherwise(F.col("seq")).alias("seq"),
    )
    always = distinct.filter((F.col("_least") == 1) & (F.col("_most") > 1)).select(
        "filter_id", F.lit("ALWAYS_TRUE_CONJ").alias("code"), "seq")
    repeated = (
        placed.groupBy("filter_id", "conj_id", "seq").agg(F.count("*").alias("_n")).filter("_n > 1")
        .select("filter_id", F.lit("REPEATED_IN_CONJ").alias("code"), "seq")
    )
    bad = translated_terms(rule_terms(filters)).filter(F.col("regex").isNull()).select(
        "filter_id", F.lit("BAD_PATTERN").alias("code"), F.col("pattern").alias("seq"))
    nothing = filters.filter(~F.exists(cond_tree("cond"), lambda conj: F.exists(conj, lambda seq: F.size(seq) > 0))).select(
        "filter_id", F.lit("NO_CONDITION").alias("code"), F.lit("").alias("seq"))
    return nested.unionByName(always).unionByName(repeated).unionByName(bad).unionByName(nothing).distinct()


@dataclass
class Rule:
    """One filter, ready to become a column."""

    filter_id: int
    sources: list[str]
    conjs: list[list[list[str]]]
    id_type: str = "int"

    def id_column(self) -> Column:
        return F.lit(self.filter_id).cast(self.id_type)

    def matches(self, line: Column) -> Column:
        """Does the token line satisfy the condition? Single sequences are tried before all-ofs."""
        tests = []
        for seqs in sorted(filter(None, self.conjs), key=len):
            distinct = dict.fromkeys(map(tuple, seqs))
            tests.append(reduce(lambda a, b: a & b, [sequence_matches(list(s), line) for s in distinct]))
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def covers(self, src: Column) -> Column:
        return affix_match_literal(src, self.sources)


def sequence_matches(patterns: list[str], line: Column) -> Column:
    """Do consecutive words of the token line match the patterns, from any word on?"""
    regexes = [translate(p).regex for p in patterns]
    if all(map(stays_in_word, patterns)):
        return (line != "") & line.rlike(line_regex(regexes))
    words = F.split(line, "\n")
    last_start = F.size(words) - (len(regexes) - 1)
    rows = F.arrays_zip(*[F.slice(words, k + 1, last_start).alias(f"w{k}") for k in range(len(regexes))])
    hit = F.exists(rows, lambda row: reduce(lambda a, b: a & b, [row[f"w{k}"].rlike(r) for k, r in enumerate(regexes)]))
    return F.when((line != "") & (last_start > 0), hit).otherwise(False)


def compile_rules(filters: DataFrame) -> list[Rule] | None:
    """A small rule table as :class:`Rule` objects; None when it is too large.

    A rule with a bad pattern never matches, though the sources it names stay active.
    At most ``MAX_COLUMN_RULES`` + 1 rows come to the driver.
    """
    id_type = filters.schema["filter_id"].dataType.simpleString()
    rows = filters.select("filter_id", "sources", cond_tree("cond").alias("tree")).limit(MAX_COLUMN_RULES + 1).collect()
    terms = [(r.filter_id, pattern) for r in rows for conj in r.tree for seq in conj for pattern in seq]
    if len(rows) > MAX_COLUMN_RULES or len(terms) > MAX_COLUMN_TERMS:
        return None
    good = good_patterns(filters.sparkSession, {pattern for _, pattern in terms})
    broken = {filter_id for filter_id, pattern in terms if pattern not in good}
    return [
        Rule(r.filter_id, list(r.sources or []), [] if r.filter_id in broken else [list(conj) for conj in r.tree], id_type)
        for r in sorted(rows, key=lambda r: r.filter_id)
    ]


def good_patterns(spark: SparkSession, patterns: set[str]) -> set[str]:
    """The patterns that translate to a regex Spark's own engine compiles."""
    translated = [(p, t.regex) for p in sorted(patterns) if (t := translate(p))]
    if not translated:
        return set()
    names, regexes = zip(*translated)
    table = spark.createDataFrame(pa.table({"pattern": list(names), "regex": list(regexes)}))
    return {r.pattern for r in table.filter(compiles(F.col("regex"))).collect()}
