"""Alternatives of a rule that add nothing: another one of the rule holds wherever they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.matching import word_hits
from tidewire.plans.patterns import witness_column
from tidewire.plans.rules import SEQ, rule_terms, translated_patterns, usable_terms
from tidewire.plans.sizing import is_small
from tidewire.session import durable


def pattern_inclusions(patterns: DataFrame) -> DataFrame:
    """``(pattern, by)``: every word that ``pattern`` accepts is accepted by ``by``; each pattern includes itself.

    ``patterns(pattern, regex, probe)`` are distinct and compile. The witnesses of a pattern are looked up like the words of a text, and a
    pattern that accepts all of them includes it. Patterns with raw regexes are compared as texts only.
    """
    plain = durable(patterns.withColumn("_words", witness_column("pattern")).filter(F.col("_words").isNotNull()).withColumn(
        "pid", F.monotonically_increasing_id()), "plain")
    witnesses = plain.select("pid", "pattern", F.size("_words").alias("_size"), F.explode("_words").alias("word"))
    accepted = word_hits(witnesses, plain.select("pid", "regex", "probe"), is_small(plain)).select("word", F.col("pid").alias("_by"))
    whole = witnesses.join(accepted, "word").groupBy("pid", "pattern", "_size", "_by").agg(F.count("*").alias("_met")).filter("_met = _size")
    found = whole.select("pattern", F.col("_by").alias("pid")).join(plain.select("pid", F.col("pattern").alias("by")), "pid").select("pattern", "by")
    return found.union(patterns.select("pattern", F.col("pattern").alias("by"))).distinct()


def rule_subsumed(filters: DataFrame) -> DataFrame:
    """``(filter_id, conj_id, by_conj)``: alternative ``conj_id`` of the rule adds nothing, as ``by_conj`` holds wherever it does.

    A sequence stands wherever a longer one does that includes it, word by word from some place on; an all-of holds wherever another one does that
    has such a sequence for each of its own. Of alternatives that include each other the first one stays. Rules with a bad pattern never
    match and are left out, and a rule that is given twice is one rule. All joins are by pattern, within a rule.
    """
    terms = durable(usable_terms(rule_terms(filters)).select(*SEQ, "pos", "pattern").distinct(), "terms")
    inclusions = durable(pattern_inclusions(translated_patterns(terms)), "inclusions")
    sizes = terms.groupBy(*SEQ).agg(F.count("*").alias("_len"))
    # the places where a word of the one stands for a word of the other
    ours = terms.join(inclusions, "pattern").select("filter_id", "conj_id", "seq_id", "pos", "by")
    theirs = terms.join(sizes, SEQ).select(
        "filter_id", F.col("conj_id").alias("_conj"), F.col("seq_id").alias("_seq"), F.col("pos").alias("_pos"), F.col("pattern").alias("by"), "_len")
    met = ours.join(theirs, ["filter_id", "by"]).filter("conj_id <> _conj")
    sequences = (
        met.groupBy("filter_id", "conj_id", "seq_id", "_conj", "_seq", "_len", (F.col("pos") - F.col("_pos")).alias("_shift"))
        .agg(F.count("*").alias("_met")).filter("_met = _len")
        .select("filter_id", "conj_id", F.col("_conj").alias("by_conj"), "_seq").distinct()
    )
    wanted = sizes.groupBy("filter_id", F.col("conj_id").alias("by_conj")).agg(F.count("*").alias("_size"))
    held = sequences.groupBy("filter_id", "conj_id", "by_conj").agg(F.count("*").alias("_held"))
    pairs = durable(held.join(wanted, ["filter_id", "by_conj"]).filter("_held = _size").select("filter_id", "conj_id", "by_conj"), "pairs")
    mutual = pairs.filter("conj_id > by_conj").select("filter_id", F.col("conj_id").alias("by_conj"), F.col("by_conj").alias("conj_id"))
    return pairs.join(mutual, ["filter_id", "conj_id", "by_conj"], "left_anti")
