"""Dimension joins, routing results and delivery caps."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from compare import duck
from pyspark.sql import functions as F

from tidewire.catalog import subscriptions as subs
from tidewire.catalog.oracle import ORACLE
from tidewire.operators import dimensions, routing
from tidewire.plans import sizing
from tidewire.sources import tables
from tidewire.sources.config import read_config

FILTERS = "filter_id int, cond string, sources array<string>, pubs array<string>"
ITEMS = "item_id long, src string, title string, link string, categories array<string>, published timestamp_ntz"
START = datetime(2024, 1, 1)


def test_desk_routes(spark, folder):
    items = tables.document_items(spark, folder)
    filters, pubs = subs.desk_filters(spark), subs.desk_pubs(spark)
    for scoped, name in ((False, "route_items"), (True, "route_items_scoped")):
        want = dict(duck(folder).execute(f"SELECT pub, count(*) FROM ({ORACLE[name]}) GROUP BY pub").fetchall())
        routed = routing.route_items(items, filters, pubs, scoped)
        assert {r.pub: r["count"] for r in routed.groupBy("pub").count().collect()} == want


@pytest.mark.parametrize("many", [False, True])
def test_odd_rules_and_repeated_items(spark, monkeypatch, many):
    """No condition, no sources, ids of another width, rows that repeat an id: the same answer on both ways."""
    rows = [(1, "a.x", "one two", "l", [], START), (1, "a.x", "three", "l", [], START), (1, "a.x", "one", "l", [], None), (2, "a.x", "one two", "l", [], None)]
    items = spark.createDataFrame(rows, ITEMS)
    filters = spark.createDataFrame([(1 << 40, "one", None, ["p"]), (2, None, ["a"], []), (3, "three", [], []), (4, "", [], None), (5, "a\\(", [], [])],
                                    "filter_id long, cond string, sources array<string>, pubs array<string>")
    pubs = spark.createDataFrame([("p", "u%s", ""), ("q", "u%s", "")], "name string, url_format string, template string")
    if many:
        monkeypatch.setattr(routing, "compile_rules", lambda filters: None)
        monkeypatch.setattr(routing, "MAX_PLAN_PAIRS", 1)
    routed = routing.route_items(items, filters, pubs, dedup=lambda found: found)
    assert dict(routed.dtypes)["item_id"] == "bigint" and routed.columns[-1] == "pub"
    got = Counter((r.item_id, r.title, r.pub) for r in routed.collect())
    assert got == Counter([(1, "one two", "p"), (1, "three", "p"), (1, "three", "q"), (1, "one", "p"), (2, "one two", "p")])
    assert dict(routing.matched_items(items, filters).dtypes)["filter_ids"] == "array<bigint>"


@pytest.mark.parametrize("scoped", [False, True])
def test_many_rules_route_like_few(spark, folder, monkeypatch, scoped):
    items = tables.document_items(spark, folder)
    filters, pubs = subs.desk_filters(spark), subs.desk_pubs(spark)
    want = Counter((r.item_id, r.pub) for r in routing.route_items(items, filters, pubs, scoped).collect())
    monkeypatch.setattr(routing, "compile_rules", lambda filters: None)
    monkeypatch.setattr(routing, "MAX_PLAN_PAIRS", 1)
    monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    got = Counter((r.item_id, r.pub) for r in routing.route_items(items, filters, pubs, scoped).collect())
    assert got == want


def test_only_matched_items_count_as_seen(spark):
    rows = [(1, "b.x", "the of", "l", [], START), (2, "a.x", "the of", "l", [], START + timedelta(hours=1)),
            (3, "a.x", " the, of!", "l", [], START + timedelta(hours=2)), (4, "z.z", "the of", "l", [], START - timedelta(hours=1))]
    items = spark.createDataFrame(rows, ITEMS)
    filters = spark.createDataFrame([(1, "the & of", ["a"], ["p"]), (2, "nothing", ["b"], [])], FILTERS)
    pubs = spark.createDataFrame([("p", "u%s", "")], "name string, url_format string, template string")
    ids = lambda scoped: [r.item_id for r in routing.route_items(items, filters, pubs, scoped).collect()]
    assert ids(False) == [1]  # every filter sees every item of an active source
    assert ids(True) == [2]


def test_items_without_publisher_take_their_title(spark):
    items = spark.createDataFrame([(1, "a.x", "one two", "l", [], START), (2, "a.x", "two", "l", [], START)], ITEMS)
    filters = spark.createDataFrame([(1, "one", [], ["nobody"]), (2, "two", [], ["p"])], FILTERS)
    pubs = spark.createDataFrame([("p", "u%s", "")], "name string, url_format string, template string")
    assert [(r.item_id, r.pub) for r in routing.route_items(items, filters, pubs).orderBy("item_id").collect()] == [(1, "p"), (2, "p")]
    none = spark.createDataFrame([(1, "one", [], ["nobody"])], FILTERS)
    assert routing.survivors(items, none).count() == 1
    assert routing.route_items(items, none, pubs).count() == 0


@pytest.mark.parametrize("cap", [0, 1, 3, 1000])
@pytest.mark.parametrize("small", [True, False])
def test_delivery_cap(spark, monkeypatch, cap, small):
    rows = [(i, "p" if i % 3 else "q", START + timedelta(minutes=(i * 7) % 180)) for i in range(120)]
    rows += [(500 + i, "p", None) for i in range(5)]
    df = spark.createDataFrame(rows, "item_id long, pub string, published timestamp_ntz")
    seen, want = Counter(), {}
    for item_id, pub, at in sorted(rows, key=lambda r: (r[2] or datetime.min, r[0])):
        slot = (pub, at and at.replace(minute=0))
        seen[slot] += 1
        want[item_id] = "pub_send" if seen[slot] <= cap else "pub_full"
    assert {r.item_id: r.event for r in routing.delivery_cap(df, cap).collect()} == want


def test_delivery_cap_counts_ties(spark):
    rows = [(1, "p", START)] * 5 + [(2, "p", START)] * 2 + [(1, "q", None)] * 3
    df = spark.createDataFrame(rows, "item_id long, pub string, published timestamp_ntz").repartition(4)
    for cap in (1, 2, 6):
        sent = Counter((r.pub, r.event) for r in routing.delivery_cap(df, cap).collect())
        assert sent["p", "pub_send"] == min(cap, 7) and sent["q", "pub_send"] == min(cap, 3) and sent.total() == 10


def test_lookup_join_both_ways(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = Counter(map(tuple, big.join(small, "k", how).select("id").collect()))
        for fits in (True, False):
            assert Counter(map(tuple, sizing.lookup_join(big, small, "k", how, small_fits=fits).select("id").collect())) == want
    assert sizing.is_small(small) and not sizing.is_small(small, max_rows=2) and not sizing.is_small(small, max_bytes=10)


def test_frequent_join(spark, monkeypatch):
    """Frequent keys by broadcast, rare ones by a shuffle, each row once."""
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    index = spark.createDataFrame([("hot", 1, 700), ("hot", 2, 700), ("k1", 3, 7), ("k2", 4, 7), ("none", 5, 1)], "k string, v int, n long")
    want = Counter(map(tuple, big.join(index, "k").select("id", "v").collect()))
    for rows in (0, 1, 2, 3, 100):
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", rows)
        joined = sizing.frequent_join(big, index, "k", "n", rows)
        assert joined.columns == ["k", "id", "v"]
        assert Counter(map(tuple, joined.select("id", "v").collect())) == want


def test_publishers_meet_rows_by_classes(spark, monkeypatch):
    """No table of publishers is made for every set of filters that rows satisfy, and a row has each publisher once."""
    kept = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [2]), (3, [3, 1]), (4, [4]), (5, [])], "item_id long, filter_ids array<int>")
    filters = spark.createDataFrame([(1, "x", [], ["p", "q"]), (2, "x", [], ["q", "r"]), (3, "x", [], []), (4, "x", [], ["nobody"])], FILTERS)
    pubs = spark.createDataFrame([(name, "u%s", "") for name in ("p", "q", "r", "s")], "name string, url_format string, template string")
    want = Counter((r.item_id, r.pub) for r in routing.routes(kept, filters, pubs).collect())
    looked_up = []
    monkeypatch.setattr(routing, "MAX_PLAN_PAIRS", 1)
    monkeypatch.setattr(routing, "lookup_join", lambda big, small, *a, **k: looked_up.append(small.columns) or sizing.lookup_join(big, small, *a, **k))
    assert Counter((r.item_id, r.pub) for r in routing.routes(kept, filters, pubs).collect()) == want and want[1, "q"] == 2
    assert not any("filter_ids" in columns for columns in looked_up)


def test_unknown_sources(spark):
    items = spark.createDataFrame([(1, "a", "t", "l", [], START), (2, "b", "t", "l", [], START)], ITEMS)
    sources = spark.createDataFrame([("a",)], "name string")
    assert [r.item_id for r in routing.item_source(items, sources).collect()] == [1]
    assert [r.item_id for r in routing.unknown_source_items(items, sources).collect()] == [2]


def test_config_files(spark, tmp_path):
    (tmp_path / "filters.json").write_text('{"filter_id":1,"cond":"ABC; DAP","sources":["main"]}\n')
    (tmp_path / "sources.json").write_text('{"name":"main.news","links":["l"]}\n{"name":"other.x","cooldown_seconds":90}\n')
    (tmp_path / "pubs.json").write_text('{"name":"main","url_format":"u?%s"}\n{"name":"main","url_format":"u?%s"}\n')
    filters, sources, pubs = read_config(spark, str(tmp_path))
    assert filters.first().pubs == []
    got = {r.name: (r.cooldown, r.agency) for r in sources.collect()}
    assert got == {"main.news": (timedelta(minutes=15), "main"), "other.x": (timedelta(seconds=90), "other")}
    report = {tuple(r) for r in dimensions.config_check(sources, filters, pubs).collect()}
    assert report == {("pubs", "main", "duplicate"), ("sources", "other.x", "no links"), ("sources", "other.x", "no filter")}
    with pytest.raises(ValueError, match="repeated publisher names: main"):
        read_config(spark, str(tmp_path), strict=True)


def test_config_without_anything(spark):
    empty = spark.createDataFrame([], FILTERS)
    sources = spark.createDataFrame([], "name string, links array<string>")
    pubs = spark.createDataFrame([], "name string")
    report = {tuple(r) for r in dimensions.config_check(sources, empty, pubs).collect()}
    assert report == {("filters", "", "no filters"), ("sources", "", "no sources"), ("pubs", "", "no publishers")}
