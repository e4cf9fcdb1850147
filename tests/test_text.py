import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import render, text
from tidewire.functions.affix import affix_match, affixes, any_affix_match
from tidewire.functions.hours import is_muted

SPACES = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def words_of(title):
    """Tokenising by the book, one character at a time."""
    fields, current = [], ""
    for c in title + " ":
        if c in SPACES:
            fields.append(current)
            current = ""
        else:
            current += c
    punct = lambda c: unicodedata.category(c).startswith("P")
    out = []
    for word in fields:
        while word and punct(word[0]):
            word = word[1:]
        while word and punct(word[-1]):
            word = word[:-1]
        if word:
            out.append(word)
    return out


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("r")).first().r


def test_tokenize_vectors(spark):
    given = "„Поезд-7“ вышел\t(в 6:45) — на 3,5% раньше, чем «Ласточка»: R&D?! до 12.50 км..."
    want = "Поезд-7|вышел|в|6:45|на|3,5|раньше|чем|Ласточка|R&D|до|12.50|км"
    assert "|".join(one(spark, text.tokenize("s"), given)) == want
    assert one(spark, text.tokenize("s"), " ?; -- !.. ( ) ") == []
    assert one(spark, text.tokenize("s"), None) == []
    assert one(spark, text.tokenize("s"), "a -- b , c-d ---x--- $+") == ["a", "b", "c-d", "x", "$+"]


LETTERS = st.sampled_from(list("abZ1$+-.,!«»'\"&%я  　\x85\x0b \n\t"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=14), min_size=200, max_size=300))
def test_tokenize_fuzz(spark, titles):
    rows = spark.createDataFrame([(t,) for t in titles], "s string").select("s", text.tokenize("s").alias("w")).collect()
    assert [r.w for r in rows] == [words_of(r.s) for r in rows]


def test_long_punctuation_is_linear(spark):
    assert one(spark, text.tokenize("s"), "-" * 200_000 + "x" + "." * 200_000 + "y") == ["x" + "." * 200_000 + "y"]


def test_dedup_key(spark):
    key = lambda s: one(spark, text.dedup_key(text.token_line("s")), s)
    assert key("tide wire") != key("tidew ire")
    assert key("( Tide;   wire?") == key("Tide wire")
    assert key("tide wire") != key("Tide wire")
    assert key("...") == text.EMPTY_KEY


@pytest.mark.parametrize("value,blank", [(" \t ", True), ("  s  ", False), ("", True), (" ", True), (" \x85", True), (None, True)])
def test_is_blank(spark, value, blank):
    assert one(spark, text.is_blank("s"), value) is blank


def test_split_trim(spark):
    got = one(spark, text.split_trim("s", ","), "\u2003low water ,\n,tide  table,,7\tknots\r,\x0b")
    assert got == ["low water", "tide  table", "7\tknots"]
    assert one(spark, text.split_trim("s", "."), "a.b . ") == ["a", "b"]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"],)], "a array<string>")
    got = df.select(
        text.index_of(F.col("a"), "b"), text.index_of(F.col("a"), "x"), text.contains(F.col("a"), "a"),
        text.append_absent(F.col("a"), F.lit("c")), text.append_absent(F.col("a"), F.lit("a"))).first()
    assert list(got) == [1, -1, True, ["a", "b", "c"], ["a", "b"]]


@pytest.mark.parametrize("name,globs,match", [
    ("harbour.log", ["harb"], True), ("harbour.log", ["x", ".log"], True), ("harbour.log", ["bour", "our."], False),
    ("harbour.log", [], True), ("harbour.log", ["", "q"], True), ("harbour.log", ["Harb", "LOG"], False)])
def test_affix(spark, name, globs, match):
    df = spark.createDataFrame([(name, globs)], "n string, g array<string>")
    assert df.select(affix_match(F.col("n"), F.col("g"))).first()[0] is match
    keys = set(df.select(affixes(F.col("n"))).first()[0])
    assert bool(keys & set(globs or [""])) is match


def test_any_affix(spark):
    df = spark.createDataFrame([(["a", "xyz"], ["yz"]), ([], ["q"]), (["a"], []), (["a"], ["b"])], "n array<string>, g array<string>")
    assert [r[0] for r in df.select(any_affix_match(F.col("n"), F.col("g"))).collect()] == [True, True, True, False]


@pytest.mark.parametrize("begin,end,hours", [
    (22, 2, {22, 23, 0, 1}), (9, 12, {9, 10, 11}), (0, 1, {0}), (23, 0, {23}), (13, 13, set(range(24))), (None, None, set())])
def test_mute(spark, begin, end, hours):
    df = spark.range(24).select("id", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.col("id").cast("int"), F.lit(59), F.lit(0)).alias("ts"))
    assert {r.id for r in df.filter(is_muted(F.col("ts"), begin, end)).collect()} == hours


def test_mute_hours_checked():
    with pytest.raises(ValueError):
        is_muted(None, 24, 1)


def item(spark, **values):
    base = dict(title="High tide", link="quay.example/7?x=1", published=None, src="Port.North", template="")
    base.update(values)
    return spark.createDataFrame([tuple(base.values())], "title string, link string, published timestamp_ntz, src string, template string")


def test_default_message(spark):
    df = item(spark)
    slots = render.item_slots() | {"DateFmt": F.lit("31.12 23:59"), "Src.Name": F.lit("Port.South")}
    assert df.select(render.render(None, slots)).first()[0] == "*High tide* 31.12 23:59 \nPort.South quay.example/7?x=1"


def test_templates_take_values_as_they_are(spark):
    df = item(spark, title="{{.Link}} <b>", template="{{.Src.Agency}}: {{ .Title }}/{{.DateFmt}}.")
    assert df.select(render.render_each(F.col("template"), render.item_slots())).first()[0] == "Port: {{.Link}} <b>/."
    assert df.select(render.render("{{.Src.Agency}}: {{ .Title }}/{{.DateFmt}}.", render.item_slots())).first()[0] == "Port: {{.Link}} <b>/."
    with pytest.raises(ValueError):
        render.render("{{.Nope}}", render.item_slots())


def test_urls(spark):
    got = one(spark, render.build_url(F.lit("http://e.org/%20?t=%s&x=1"), F.col("s")), "a b*~&ü/%s")
    assert got == "http://e.org/%20?t=a+b%2A~%26%C3%BC%2F%25s&x=1"


@pytest.mark.parametrize("value,want", [
    ("Mon, 02 Jan 2006 15:04:05 +0300", "2006-01-02 12:04:05"), ("2 Jan 2006 15:04:05 GMT", "2006-01-02 15:04:05"),
    ("Mon, 02 Jan 2006 15:04:05 EST", "2006-01-02 20:04:05"), ("2006-01-02T15:04:05+03:00", "2006-01-02 12:04:05"),
    ("2006-01-02T15:04:05Z", "2006-01-02 15:04:05"), ("02 Jan 2006 15:04 +0000", "2006-01-02 15:04:00"), ("bad", None), (None, None)])
def test_feed_times(spark, value, want):
    got = one(spark, render.parse_feed_time(F.col("s")), value)
    assert (got and str(got)) == want
