"""Items against rules: which item satisfies which filter.

Two ways with one answer. A small rule table becomes columns: one narrow pass, no shuffle. A
large one is matched through the vocabulary: regexes run once per distinct word that shares a
literal beginning or letter triple with the pattern, which gives an index of words and pattern numbers. The frequent words
of it are broadcast, rarer ones try the patterns where they stand, so no table of words is shuffled. A sequence is looked for at
the occurrences of its rarest pattern, then at the word beside it, and the few places that are left are held against all its
other patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import line_words
from tidewire.plans.patterns import fold, folded_probes, probe_key
from tidewire.plans.rules import SEQ, Rule, rule_terms, usable_terms
from tidewire.plans.sizing import frequent_join, frequent_power, is_small, lookup_join, power_of
from tidewire.session import durable
from tidewire.sources.tables import once


# Words with their patterns are short rows: so many of them are broadcast if their bytes fit.
INDEX_ROWS = 2_000_000
# Fixed value: words of a piece of text.
BLOCK_WORDS = 256


def match_column(rules: list[Rule], scoped: bool = False):
    """The ids of all satisfied rules as one array over ``line`` (and ``src`` when scoped)."""
    hits = []
    for rule in rules:
        test = rule.matches(F.col("line"))
        if scoped:
            test = rule.covers(F.col("src")) & test
        hits.append(F.when(test, rule.id_column()))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def match_by_columns(items: DataFrame, rules: list[Rule], scoped: bool = False) -> DataFrame:
    """``items`` with ``line`` to one row per item and satisfied rule, item columns kept."""
    # the outer form: a plain explode would have its non-empty test, the whole match, run twice
    rows = items.select("*", F.explode_outer(match_column(rules, scoped)).alias("filter_id"))
    return rows.filter(F.col("filter_id").isNotNull())


def numbered_rows(items: DataFrame) -> DataFrame:
    """``items`` written down, with a number for each row (``_row``): rows may repeat an item's id."""
    return durable(items.withColumn("_row", F.monotonically_increasing_id()), "rows")


def tried(rows: DataFrame, patterns: DataFrame, patterns_fit: bool) -> DataFrame:
    """``rows`` and ``pid``: each row of a ``word`` with each pattern it matches.

    A pattern (pid, regex, probe) is looked up under a single probe key, a word answers to several, and only the
    pairs that meet and of which the word holds all letters of the probe run the regex. Patterns without literal letters sit under the empty key
    and are tried on every word, as they must be.
    """
    # lower-casing makes a last sigma of its own
    same = lambda folded: F.translate(folded, "ς", "σ")
    folded = rows.select("*", once(fold(F.col("word"))).alias("_folded"))
    probed = folded.select("*", F.explode(folded_probes(F.col("_folded"))).alias("probe"))
    anchored = F.col("probe").startswith("^")
    letters = same(fold(F.when(anchored, F.substring("probe", 2, 1 << 30)).otherwise(F.col("probe"))))
    lookup = patterns.select("pid", "regex", probe_key(F.col("probe")).alias("probe"), anchored.alias("_anchored"), letters.alias("_letters"))
    met = lookup_join(probed, lookup, "probe", small_fits=patterns_fit)
    held = F.when(F.col("_anchored"), F.startswith(same(F.col("_folded")), F.col("_letters"))).otherwise(F.contains(same(F.col("_folded")), F.col("_letters")))
    return met.filter(held).filter(F.expr("word rlike regex")).select(*rows.columns, "pid")


def counted_words(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def word_hits(tokens: DataFrame, patterns: DataFrame, patterns_fit: bool) -> DataFrame:
    """``(word, pid, n)``: vocabulary words matching each pattern, with their token counts."""
    return tried(counted_words(tokens), patterns, patterns_fit).select("word", "pid", "n")


class WordIndex(NamedTuple):
    """Which word matches which pattern, where rows of words stay where they are.

    The most frequent words are broadcast, with their patterns or without any, as many as are always small. Of the other words each
    row tries the patterns by itself, which are broadcast. Only patterns that don't fit are found by a shuffle of those rows.
    """

    vocabulary: DataFrame  # word, n
    hits: DataFrame  # word, pid, n
    patterns: DataFrame  # pid, regex, probe
    fit: bool  # are the patterns small?
    least: int  # the words from this power of two on are frequent, 0: all of them

    def _index(self, pids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the patterns ``pids``: frequent words to broadcast, and the other ones."""
        index = lookup_join(self.hits, pids, "pid", "left_semi", small_fits=self.fit).select("word", "pid", "n")
        return index.filter(power_of("n") >= self.least).drop("n"), index.filter(power_of("n") < self.least)

    def _frequent(self) -> DataFrame:
        return self.vocabulary.filter(power_of("n") >= self.least).select("word")

    def _unknown(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self._frequent()), "word", "left_anti")

    def met(self, tokens: DataFrame, pids: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """``tokens`` and ``pid``: rows of a ``word`` with each of the patterns ``pids`` it matches; ``cut`` makes the rows narrow once they have met."""
        frequent, rare = self._index(pids)
        known = cut(tokens.join(F.broadcast(frequent), "word"))
        if self.least == 0:
            return known
        unknown = cut(self._unknown(tokens))
        rest = tried(unknown, lookup_join(self.patterns, pids, "pid", "left_semi", small_fits=True), True) if self.fit \
            else frequent_join(unknown, rare, "word", "n", INDEX_ROWS)
        return known.unionByName(rest)

    def holding(self, rows: DataFrame, pids: DataFrame) -> DataFrame:
        """``rows`` of which the ``word`` matches the pattern ``pid``, one of ``pids``."""
        frequent, rare = self._index(pids)
        if self.least == 0:
            return rows.join(F.broadcast(frequent), ["word", "pid"])
        if not self.fit:
            return rows.join(F.broadcast(frequent), ["word", "pid"]).unionByName(frequent_join(self._unknown(rows), rare, ["word", "pid"], "n", INDEX_ROWS))
        # in one pass: found, or to be tried as the word is none of the frequent ones
        found = rows.join(F.broadcast(frequent.withColumn("_found", F.lit(True))), ["word", "pid"], "left")
        known = found.join(F.broadcast(self._frequent().withColumn("_known", F.lit(True))), "word", "left")
        tried_here = F.when(F.col("_known").isNull(), F.expr("word rlike regex")).otherwise(False)
        return known.join(F.broadcast(self.patterns.select("pid", "regex")), "pid").filter(F.coalesce("_found", tried_here)).select(*rows.columns)


def word_index(tokens: DataFrame, patterns: DataFrame, patterns_fit: bool) -> WordIndex:
    vocabulary = durable(counted_words(tokens), "vocabulary")
    hits = durable(tried(vocabulary, patterns, patterns_fit).select("word", "pid", "n"), "hits")
    least = frequent_power(vocabulary.unionByName(hits.select("word", "n")), "n", INDEX_ROWS)
    return WordIndex(vocabulary, hits, patterns, patterns_fit, least)


def rule_sequences(filters: DataFrame) -> DataFrame:
    """Sequences of the usable rules: ``(filter_id, conj_id, seq_key, terms)``, ``terms`` their words in order.

    Equal sequences have equal keys, so rules that share a sequence share its matching.
    """
    terms = usable_terms(rule_terms(filters))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "regex", "probe")))
    seqs = terms.groupBy(*SEQ).agg(ordered.alias("terms"))
    return seqs.select("filter_id", "conj_id", F.md5(F.to_json("terms")).alias("seq_key"), "terms")


def conj_places(seqs: DataFrame) -> DataFrame:
    """``(seq_key, filter_id, conj_id, size)``, ``size`` the number of distinct sequences of the all-of."""
    sets = seqs.groupBy("filter_id", "conj_id").agg(F.collect_set("seq_key").alias("_keys"))
    return sets.select("filter_id", "conj_id", F.size("_keys").alias("size"), F.explode("_keys").alias("seq_key"))


def rarest_first(seqs: DataFrame, patterns: DataFrame, hits: DataFrame, seqs_fit: bool) -> DataFrame:
    """``(seq_key, parts)``: the patterns of each sequence that can match at all as (offset, pid).

    The first part is the pattern with the fewest matching tokens, at offset 0, the second one stands beside it, and the others follow in
    order of tokens. A sequence with a pattern no word matches drops out.
    """
    counted = patterns.join(hits.groupBy("pid").agg(F.sum("n").alias("n")), "pid").select("regex", "pid", "n")
    distinct = seqs.groupBy("seq_key").agg(F.first("terms").alias("terms"))
    terms = distinct.select("seq_key", F.size("terms").alias("len"), F.inline("terms"))
    met = lookup_join(terms, counted, "regex", small_fits=seqs_fit).groupBy("seq_key", "len").agg(
        F.array_sort(F.collect_list(F.struct("n", "pos", "pid"))).alias("terms")).filter(F.size("terms") == F.col("len"))
    first = F.col("terms")[0]["pos"]
    beside = F.filter(F.slice("terms", 2, F.size("terms")), lambda t: F.abs(t["pos"] - first) == 1)
    order = F.concat(F.slice("terms", 1, 1), F.slice(beside, 1, 1))
    order = F.concat(order, F.array_except("terms", order))
    return met.select("seq_key", F.transform(order, lambda t: F.struct((t["pos"] - first).alias("offset"), t["pid"].alias("pid"))).alias("parts"))


def text_places(worded: DataFrame, before: int, after: int) -> DataFrame:
    """``(_row, pos, word, block, _at)``: each word of each text, with a piece of the text that has so many words ``before`` and ``after`` it, and its place there.

    Texts are cut into overlapping pieces, so what a row of a word holds does not grow with its text.
    """
    step = max(BLOCK_WORDS, before + after)
    lead = lambda at: F.least(at, F.lit(before))
    last = F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / step).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        (k * step).alias("at"), F.slice("words", k * step - lead(k * step) + 1, lead(k * step) + step + after).alias("block")))
    cut = worded.select("_row", F.inline(blocks))
    tokens = cut.select("_row", "at", "block", F.posexplode("block").alias("_at", "word"))
    own = (F.col("_at") >= lead(F.col("at"))) & (F.col("_at") < lead(F.col("at")) + step)
    return tokens.filter(own).select("_row", (F.col("at") - lead(F.col("at")) + F.col("_at")).alias("pos"), "word", "block", "_at")


def sequence_hits(rows: DataFrame, seqs: DataFrame, seqs_fit: bool) -> DataFrame:
    """``(_row, seq_key)``: which row holds which sequence.

    Sequences that begin with the same parts share the places where these stand. A place is a row and a position, never a copy
    of a text: it takes along the words that stand around it as far as the longest sequence reaches, so its other parts are looked at on the spot and no table of words is
    dealt out by row and position.
    """
    # pinned: the explodes below would have the words made again for their non-empty test
    worded = rows.select("_row", once(line_words(F.col("line"))).alias("words"))
    patterns = durable(seqs.select(F.inline("terms")).groupBy("regex").agg(F.min("probe").alias("probe")).withColumn(
        "pid", F.monotonically_increasing_id()), "patterns")
    index = word_index(worded.select(F.explode("words").alias("word")), patterns, seqs_fit)
    parts = durable(rarest_first(seqs, patterns, index.hits, seqs_fit), "parts")
    # a sequence of one pattern stands in a row or not, wherever
    single = parts.filter(F.size("parts") == 1).select("seq_key", F.col("parts")[0]["pid"].alias("pid"))
    once_each = index.met(worded.select("_row", F.explode(F.array_distinct("words")).alias("word")), single.select("pid"))
    found = lookup_join(once_each.select("_row", "pid"), single, "pid", small_fits=seqs_fit).select("_row", "seq_key")
    longer = parts.filter(F.size("parts") > 1).select(
        "seq_key", F.col("parts")[0]["pid"].alias("pid"), F.col("parts")[1].alias("second"), F.slice("parts", 3, F.size("parts")).alias("rest"))
    offset = F.col("part.offset")
    before, after = longer.select(F.explode(F.concat("rest", F.array("second"))).alias("part")).agg(-F.min(offset), F.max(offset)).first()
    if before is None:
        return found.distinct()
    before, after = max(before, 0), max(after, 0)
    # sequences with the same two first parts are one pair
    pair_key = F.struct("pid", "second")
    pairs = longer.select(pair_key.alias("pair")).distinct().select("pair", "pair.pid", "pair.second.offset", F.col("pair.second.pid").alias("second"))
    by_pair = longer.select(pair_key.alias("pair"), "seq_key", "rest")
    here = F.least(F.col("pos"), F.lit(before))
    begun = index.met(text_places(worded, before, after), pairs.select("pid"), lambda places: places.select(
        *[c for c in places.columns if c not in ("block", "_at")], once(F.slice("block", F.col("_at") - here + 1, here + after + 1)).alias("around")))
    held = lookup_join(begun.drop("word"), pairs, "pid", small_fits=seqs_fit).select(
        "_row", "pos", "pair", "around", F.get("around", here + F.col("offset")).alias("word"), F.col("second").alias("pid"))
    both = index.holding(held, pairs.select(F.col("second").alias("pid"))).select("_row", "pos", "pair", "around")
    rest = F.transform("rest", lambda part: F.struct(part["pid"].alias("pid"), F.get("around", here + part["offset"]).alias("word")))
    places = durable(lookup_join(both, by_pair, "pair", small_fits=seqs_fit).select("_row", "pos", "seq_key", rest.alias("rest")), "places")
    found = found.union(places.filter(F.size("rest") == 0).select("_row", "seq_key"))
    # all other parts at once: each is a word and a pattern, and all of them must match
    wanted = durable(places.select("_row", F.col("pos").alias("at"), "seq_key", F.size("rest").alias("wanted"), F.explode("rest").alias("part")).select(
        "_row", "at", "seq_key", "wanted", "part.pid", "part.word"), "wanted")
    met = index.holding(wanted, longer.select(F.explode("rest.pid").alias("pid")))
    whole = met.groupBy("_row", "at", "seq_key", "wanted").agg(F.count("*").alias("met")).filter("met = wanted")
    return found.union(whole.select("_row", "seq_key")).distinct()


def conj_hits(seq_hits: DataFrame, places: DataFrame, places_fit: bool) -> DataFrame:
    """All-of by counting: ``(_row, filter_id, conj_id, found)`` with every distinct sequence found."""
    return (
        lookup_join(seq_hits, places, "seq_key", small_fits=places_fit)
        .groupBy("_row", "filter_id", "conj_id", "size").agg(F.count("*").alias("found"))
        .filter("found = size").drop("size")
    )


def row_conjs(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """Satisfied alternatives by row (:func:`numbered_rows`), with the number of sequences they hold."""
    seqs = durable(rule_sequences(filters), "sequences")
    # every rule-side table is made of these rows, none has more than they have terms
    fit = is_small(seqs.select(F.explode("terms")))
    return conj_hits(sequence_hits(rows, seqs, fit), conj_places(seqs), fit)


def match_rows(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """``(_row, filter_id)`` for rule tables of any size."""
    return row_conjs(rows, filters).select("_row", "filter_id").distinct()


def conj_by_count(items: DataFrame, filters: DataFrame) -> DataFrame:
    """``(item_id, filter_id, conj_id, found)``: satisfied alternatives, each row of ``items`` by itself."""
    rows = numbered_rows(items.select("item_id", "line"))
    return row_conjs(rows, filters).join(rows.select("_row", "item_id"), "_row").select("item_id", "filter_id", "conj_id", "found")


def match_by_vocabulary(items: DataFrame, filters: DataFrame) -> DataFrame:
    """``(item_id, filter_id)`` for rule tables of any size, one row for each row of ``items`` and satisfied rule."""
    rows = numbered_rows(items.select("item_id", "line"))
    return match_rows(rows, filters).join(rows.select("_row", "item_id"), "_row").select("item_id", "filter_id")
