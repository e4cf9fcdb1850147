import itertools
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import sql
from tidewire.functions.text import line_words, token_line
from tidewire.operators import matching, routing, subsumption
from tidewire.plans import sizing
from tidewire.plans.patterns import line_regex, stays_in_word, translate
from tidewire.plans.rules import compile_rules, rule_lint, rule_terms, translated_patterns

FILTERS = "filter_id int, cond string, sources array<string>, pubs array<string>"


def filters(spark, *conds):
    return spark.createDataFrame([(i, c, [], []) for i, c in enumerate(conds)], FILTERS)


def titled(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "item_id long, title string").withColumn("line", token_line("title"))


WORDS = [
    (r"R(\x26)D", ["R&D", "R&Dept"], ["R+D", "r&d", "rd", "myR&D"]),
    ("*ness", ["kindness", "Ness", "zzNeSSzz"], []),
    ("*ness$", ["kindness"], ["nessa"]),
    ("ness", ["nessa"], ["kindness"]),
    ("печ$ь", ["печью", "ПЕЧИ"], ["печка"]),
    ("м.т(ер)?$Ь", ["матерях", "мать", "М1ТЕРЯМ"], []),
    ("город$ъ", ["город", "города", "Городом"], ["городами"]),
    ("A|b", ["Ax", "xb", "xB"], ["xA"]),
    ("a|B", ["aBx", "Bx", "ABx"], ["ax", "xa", "xB", "xaB"]),
    ("*", ["q"], []), ("$", ["q"], []), ("*$", ["q"], []), ("$ь", ["q"], []),
    ("[A-Z]x", ["QX", "Qx"], ["qx"]),
]


@pytest.mark.parametrize("pattern,yes,no", WORDS)
def test_word_patterns(spark, pattern, yes, no):
    regex = translate(pattern).regex
    df = spark.createDataFrame([(w,) for w in yes + no], "w string").select("w", F.col("w").rlike(regex).alias("m"))
    assert {r.w for r in df.collect() if r.m} == set(yes)
    # the same through the token line
    hits = df.filter(F.col("w").rlike(line_regex([regex]))).collect() if stays_in_word(pattern) else None
    assert hits is None or {r.w for r in hits} == set(yes)


EXPRESSIONS = [
    (r"good day;moon & r(\x26)d;*ness$ ok & by$ & Zoo",
     ["the R&D moon", "moon or r&D", "good DaY", "kindness okay by ZOO", "Zoo by ness OK"],
     ["day good", "Zoo okay by kindly", "Zoo ness OK"]),
    ("dd;eee;fff", ["q dd q", "DDd", "EeEeee t t"], ["qqEFqq"]),
    ("dd & ee; ff & ee", ["EE DD", "FFF Eee"], ["ddd fffff"]),
    ("x & x", ["x"], ["y"]),
    ("a b & c; a & dddd", ["a q dddd"], ["a c"]),
    (" ; & ", [], ["a"]),
    (r"(\D)$ b", ["q b", "x q b"], ["1 b", "q", "", "b q"]),
    (r"[^0-9]a; ([^x])$ b c", ["ba", "a b c"], ["1a", "x b c", "b c", "q"]),
    ("*", ["q"], ["..."]),
    ("a * c", ["a b c", "x a b c"], ["a c", "a\nc"]),
]


@pytest.mark.parametrize("cond,yes,no", EXPRESSIONS)
def test_expressions_both_ways(spark, cond, yes, no):
    table = filters(spark, cond)
    items = titled(spark, yes + no)
    want = set(range(len(yes)))
    assert {r.item_id for r in routing.item_matches(items, table, by_vocabulary=False).collect()} == want
    assert {r.item_id for r in routing.item_matches(items, table, by_vocabulary=True).collect()} == want


def test_rules_as_sql_functions(spark):
    """The function of a rule table satisfies what its columns satisfy."""
    table = filters(spark, *[cond for cond, _, _ in EXPRESSIONS], "(it's|\\x26)$", "a; (")
    items = titled(spark, sorted({t for _, yes, no in EXPRESSIONS for t in yes + no} | {"it's", "&", "", "a"}) + [None])
    rules = compile_rules(table)
    sql.register_rules(spark, rules)
    want = {tuple(r) for r in matching.match_by_columns(items, rules).select("item_id", "filter_id").collect()}
    got = spark.sql("SELECT item_id, explode(hits) FROM (SELECT item_id, satisfied(line) AS hits FROM {items})", items=items)
    assert {tuple(r) for r in got.collect()} == want and any(f == len(EXPRESSIONS) for _, f in want)
    sources = spark.createDataFrame([(1, "a", ["x", "o'y"], []), (2, "a", ["z"], [])], FILTERS)
    sql.register_rules(spark, compile_rules(sources))
    names = spark.createDataFrame([("x.b",), ("q.o'y",), ("b.z",), ("q",), (None,)], "src string")
    assert [r[0] for r in spark.sql("SELECT active(src) FROM {names}", names=names).collect()] == [True, True, True, False, False]
    sql.register_rules(spark, [])
    assert [tuple(r) for r in spark.sql("SELECT satisfied('a'), active('x')").collect()] == [([], False)]


def test_terms(spark):
    rows = rule_terms(filters(spark, " a  b & c ;; d&; ")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 0, "a"), (0, 0, 0, 1, "b"), (0, 0, 1, 0, "c"), (0, 1, 0, 0, "d")]


BAD = ["a++", "a*b", "[ab", "(ab", "a)b", "$xyz$" + "a", "k$щ", r"\d", "(a$)", r"(a\1)", "([[:alpha:]])", "a{2000}", "q$"]


def test_lint(spark):
    table = filters(spark, "a b & c; a & dddd", "x & x; y", "a; b & a; a b c & z", "; ".join(BAD[:5] + BAD[6:-1]))
    got = {(r.filter_id, r.code, r.seq) for r in rule_lint(table).collect()}
    assert {g for g in got if g[0] < 3} == {
        (0, "SHADOWED", "a"), (1, "REPEATED_IN_CONJ", "x"), (2, "ALWAYS_TRUE_CONJ", "a"), (2, "PREFIX_DUP", "a b c")}
    assert {g[2] for g in got if g[1] == "BAD_PATTERN"} == set(BAD[:5] + BAD[6:-1])


PLAIN = ["a", "A", "ab", "aB", "AB", "*a", "*A", "*b", "*ab", "*aB", "a$", "A$", "ab$", "*b$", "*ab$", "*B$", "*", "$", "*$", "й", "Й", "*й$", "aй", "aйb$", "o", "aa", "*aa$"]


def test_inclusions_against_all_words(spark):
    """Inclusion of patterns is inclusion of the words they match, among all words of up to five letters."""
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("aAbBйЙoz", repeat=n)]
    accepted = {p: {w for w in words if word_matches(p, w)} for p in PLAIN}
    table = translated_patterns(spark.createDataFrame([(p,) for p in PLAIN], "pattern string"))
    got = {tuple(r) for r in subsumption.pattern_inclusions(table).collect()}
    assert got == {(p, q) for p in PLAIN for q in PLAIN if accepted[p] <= accepted[q]}


SUBSUMED = [
    ("tional; tion", {(0, 1)}), ("tion; tional", {(1, 0)}), ("x; x", {(1, 0)}), ("Tion; tion", {(0, 1)}), ("tion; Tional", {(1, 0)}),
    ("a b c; b c; c a", {(0, 1)}), ("aa & bb; a", {(0, 1)}), ("a; aa & bb; b & a", {(1, 0), (1, 2), (2, 0)}), ("город$ъ; город", {(0, 1)}),
    ("город$ъ; город$Ъ", {(0, 1)}), ("город$Ъ; *ов$; город$ов", set()), ("Мост$Ъ; *мост", {(0, 1)}), ("мать$; мат$ь", {(0, 1)}), ("(a|b); (a|b); b", {(1, 0)}),
    ("a & a; a", {(1, 0)}), ("a q; a; *", {(0, 1), (0, 2), (1, 2)}), ("a; b", set()), (" ; &", set()), (None, set()),
]


def test_subsumed_alternatives(spark):
    table = filters(spark, *[cond for cond, _ in SUBSUMED])
    got = {tuple(r) for r in subsumption.rule_subsumed(table).collect()}
    assert got == {(i, *pair) for i, (_, pairs) in enumerate(SUBSUMED) for pair in pairs}
    assert {tuple(r) for r in subsumption.rule_subsumed(table.union(table)).collect()} == got
    assert subsumption.rule_subsumed(table.limit(0)).count() == 0


def test_subsumed_alternatives_add_no_match(spark):
    """An alternative that is reported never holds where the other does not."""
    conds = [c for c, _ in SUBSUMED if c and "(" not in c and not re.search(r"\$\w", c)]
    titles = [" ".join(t) for n in (1, 2, 3) for t in itertools.product(["a", "aa", "B", "bb", "tion", "Tional", "q", "c"], repeat=n)]
    for filter_id, conj_id, by in subsumption.rule_subsumed(filters(spark, *conds)).collect():
        alternatives = conds[filter_id].split(";")
        assert all(satisfied(alternatives[by], t.split()) for t in titles if satisfied(alternatives[conj_id], t.split()))


def test_bad_rules_never_match(spark):
    table = filters(spark, "a; (", "a")
    items = titled(spark, ["a"])
    for vocabulary in (False, True):
        assert [tuple(r) for r in routing.item_matches(items, table, by_vocabulary=vocabulary).collect()] == [(0, 1)]


def word_matches(pattern, word):
    """A word pattern by the book, for patterns of letters with an optional star and dollar."""
    anchored, pattern = not pattern.startswith("*"), pattern.lstrip("*")
    end, pattern = pattern.endswith("$"), pattern.rstrip("$")
    body = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in pattern)
    return re.search(("^" if anchored and (pattern or end) else "") + body + ("$" if end and pattern else ""), word) is not None


def satisfied(cond, words):
    def seq_in(seq):
        return any(all(word_matches(p, w) for p, w in zip(seq, words[i:])) for i in range(len(words) - len(seq) + 1))

    conjs = [[s.split() for s in c.split("&") if s.split()] for c in cond.split(";")]
    return any(conj and all(map(seq_in, conj)) for conj in conjs)


pattern = st.builds(lambda star, body, end: star + body + end, st.sampled_from(["", "", "*"]),
                    st.text(st.sampled_from("abAй"), min_size=1, max_size=4), st.sampled_from(["", "", "$"]))
sequence = st.lists(pattern, min_size=1, max_size=3).map(" ".join)
conj = st.lists(sequence, min_size=1, max_size=3).map(" & ".join)
cond = st.lists(conj, min_size=1, max_size=3).map("; ".join)
title = st.lists(st.text(st.sampled_from("abABйЙ"), min_size=1, max_size=4), max_size=8).map(" ".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(cond, min_size=8, max_size=12), st.lists(title, min_size=30, max_size=40))
def test_both_strategies_against_brute_force(spark, conds, titles):
    table, items = filters(spark, *conds), titled(spark, titles)
    want = {(i, f) for (i, t), (f, c) in itertools.product(enumerate(titles), enumerate(conds)) if satisfied(c, t.split())}
    for vocabulary in (False, True):
        rows = routing.item_matches(items, table, by_vocabulary=vocabulary).collect()
        assert sorted((r.item_id, r.filter_id) for r in rows) == sorted(want)


def test_vocabulary_without_broadcast(spark, monkeypatch):
    """The salted way of every lookup gives the same answer as the broadcast one."""
    conds = ["the of & a", "a; b c", "*tion$ & the", "z & y"]
    items, table = titled(spark, ["the of a", "b c", "nation the", "b", "z", "a a a"] * 20), filters(spark, *conds)
    want = sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=True).collect()))
    monkeypatch.setattr(matching, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    assert sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=True).collect())) == want
    assert want == sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=False).collect()))


def test_the_word_index_is_never_copied(spark, monkeypatch):
    """What grows with the texts is no lookup table, which would be copied once per salt when it is large."""
    looked_up = []
    monkeypatch.setattr(matching, "lookup_join", lambda big, small, *a, **k: looked_up.append(small.columns) or sizing.lookup_join(big, small, *a, **k))
    monkeypatch.setattr(matching, "INDEX_ROWS", 0)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    conds = ["the of & a", "a; b c", "*tion$ & the", "z & y", "the of a"]
    items, table = titled(spark, ["the of a", "b c", "nation the", "b", "z", "a a a", ""] * 20), filters(spark, *conds)
    want = sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=False).collect()))
    assert sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=True).collect())) == want
    assert looked_up and not any("word" in columns for columns in looked_up)


def test_repeated_ids_are_matched_by_row(spark):
    """Rows that share an id are never pooled, whatever the number of rules."""
    table = filters(spark, "alpha & beta", "alpha; beta", "alpha beta")
    items = titled(spark, ["alpha", "beta", "alpha beta", "beta alpha"]).withColumn("item_id", F.lit(1))
    want = Counter({(1, 0): 2, (1, 1): 4, (1, 2): 1})
    for vocabulary in (False, True):
        assert Counter(map(tuple, routing.item_matches(items, table, by_vocabulary=vocabulary).collect())) == want
    assert Counter((r.filter_id, r.found) for r in matching.conj_by_count(items, table).collect()) == Counter({(0, 2): 2, (1, 1): 6, (2, 1): 1})


def test_no_row_of_a_place_carries_a_text(spark, monkeypatch):
    """Words are exploded into places without the text they are from."""
    written = []
    monkeypatch.setattr(matching, "durable", lambda df, name="step": written.append((name, df)) or sizing_durable(df, name))
    items = titled(spark, ["the of a b c", "a b c d", "b c the of"] * 5)
    routing.item_matches(items, filters(spark, "a b c; the of", "b & c d", "a * c d"), by_vocabulary=True).collect()
    names = [name for name, _ in written]
    assert {"rows", "hits", "parts", "places", "wanted"} <= set(names)
    for name, df in written:
        if name in ("places", "wanted", "hits", "parts"):
            assert not {"line", "words"} & set(df.columns)
    found = next(df for name, df in written if name == "places")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert joined and not any("words#" in line.split("], ")[-1] for line in joined)
    # regexes run on the vocabulary alone
    for name, df in written:
        if name in ("places", "wanted"):
            assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()


LONG_CONDS = ["a b c d e", "d e; x a", "*tion$ of the & z", "q b c; c d e q", "nothing here", "b", "e a b & of", "the* a b c d e a b", "Ж a; a ж$"]
LONG_TEXTS = ["a b c d e a b", "x a b c d e q b c", "the nation of the z", "z a action of these", "e a b of b c d e", "", "q", "a b c d", "thea a b c d e a b", "Ж a Жж a ж"]


@pytest.mark.parametrize("rows,words,fits", [(0, 1, True), (30, 3, True), (30, 3, False)])
def test_rare_words_and_pieces_of_texts(spark, monkeypatch, rows, words, fits):
    """Frequent words by the index, rare ones on the spot, sequences across the pieces a text is cut into: the same rows."""
    items, table = titled(spark, [" ".join(LONG_TEXTS[i:] + [str(i)]) for i in range(10)] + LONG_TEXTS * 2), filters(spark, *LONG_CONDS)
    want = sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=False).collect()))
    monkeypatch.setattr(matching, "INDEX_ROWS", rows)
    monkeypatch.setattr(matching, "BLOCK_WORDS", words)
    if not fits:
        monkeypatch.setattr(matching, "is_small", lambda *a, **k: False)
        monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    assert sorted(map(tuple, routing.item_matches(items, table, by_vocabulary=True).collect())) == want


def test_words_are_never_dealt_out(spark, monkeypatch):
    """While the rules are small, no table of words is shuffled, however many words there are: places are looked at where the text is."""
    written = []
    monkeypatch.setattr(matching, "durable", lambda df, name="step": written.append((name, df)) or sizing_durable(df, name))
    monkeypatch.setattr(matching, "INDEX_ROWS", 0)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    items = titled(spark, LONG_TEXTS * 5)
    found = routing.item_matches(items, filters(spark, *LONG_CONDS), by_vocabulary=True)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [found, *(df for name, df in written if name in ("places", "wanted"))]]
    shuffled = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(plans) == 3 and shuffled and not any("word#" in line or "pos#" in line for line in shuffled)


def test_too_many_rules_do_not_become_columns(spark):
    table = spark.range(100).select(F.col("id").cast("int").alias("filter_id"), F.lit("a").alias("cond"),
                                    F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("pubs"))
    assert compile_rules(table) is None
    assert routing.item_matches(titled(spark, ["a"]), table, by_vocabulary=False).count() == 100
    assert routing.item_matches(titled(spark, ["a"]), table).count() == 100


sizing_durable = matching.durable


def test_words_of_line(spark):
    assert titled(spark, ["a b", ""]).select(line_words(F.col("line"))).collect()[1][0] == []


def test_folding_covers_case_free_matching(spark):
    """Letters that a case-free regex takes for each other share their index key."""
    from tidewire.plans.patterns import fold

    pairs = set()
    for c in map(chr, range(0x41, 0x10000)):
        if c.isalpha():
            forms = {c.lower(), c.upper(), c.upper().lower(), c.lower().upper(), c.title(), "i", "k", "s", "σ", "μ", "å"}
            pairs |= {(c, f) for f in forms if len(f) == 1 and f != c}
    df = spark.createDataFrame(sorted(pairs), "a string, b string").repartition(8)
    same = df.filter(F.expr("a rlike concat('^(?iu:', b, ')$')"))
    assert same.count() > 1000
    assert same.filter(fold(F.col("a")) != fold(F.col("b"))).collect() == []
