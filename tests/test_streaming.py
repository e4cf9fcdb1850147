"""Streams in several micro-batches against the batch operators."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from compare import duck, spark_rows, sql_rows
from pyspark.sql import functions as F

from tidewire.catalog import subscriptions as subs
from tidewire.catalog.oracle import ORACLE
from tidewire.catalog.queries import QUERIES
from tidewire.functions.hours import is_muted
from tidewire.operators import dedup, routing, throttle
from tidewire.session import shared_dir
from tidewire.sources import feeds, sinks, tables
from tidewire.streaming import jobs, ordered, state


def in_files(df, path, order, parts=4):
    """``df`` in ``parts`` files that a stream reads one by one in ``order``."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture(scope="module")
def items(spark, folder):
    return tables.document_items(spark, folder).cache()


def test_throttle_over_batches(spark, folder, tmp_path):
    pulls = tables.pulls(spark, folder)
    got = jobs.drain(state.throttle_stream(in_files(pulls, tmp_path / "in", "ts"), "user_id", timedelta(hours=6)), "t")
    want = throttle.throttle(pulls, "user_id", timedelta(hours=6))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_fifo_over_batches(spark, items, tmp_path):
    keyed = tables.with_key(tables.prepared(items)).select("item_id", F.lit("all").alias("src"), "key", "published")
    stream = in_files(keyed, tmp_path / "in", "published")
    got = jobs.drain(state.dedup_fifo_stream(stream, "src", 5), "f")
    assert sorted(r.item_id for r in got.collect()) == sorted(r.item_id for r in dedup.dedup_fifo(keyed, "src", 5).collect())


@pytest.mark.parametrize("order", ["published", "item_id"])
@pytest.mark.parametrize("many", [False, True])
def test_route_over_batches(spark, items, tmp_path, monkeypatch, many, order):
    """Several micro-batches, in the order of time and not, and both ways to match, deliver what the batch delivers."""
    filters, pubs = subs.desk_filters(spark), subs.desk_pubs(spark)
    want = sorted((r.key, r.pub) for r in routing.route_items(items, filters, pubs).collect())
    if many:
        monkeypatch.setattr(routing, "compile_rules", lambda filters: None)
        monkeypatch.setattr(routing, "MAX_PLAN_PAIRS", 1)
    query = jobs.start_route(in_files(items, tmp_path / "in", order, parts=3), filters, pubs, str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.key, r.pub) for r in got.collect()) == want
    assert {"batch", "pub", "message", "url", "key"} <= set(got.columns)


def undated(spark):
    """Repeats without a time, and old items that come late."""
    rows = [(1, "s", "one two", "l", [], None), (2, "s", "three", "l", [], datetime(2024, 5, 1)), (3, "s", "one two", "l", [], None),
            (4, "s", "four", "l", [], datetime(2001, 1, 1)), (5, "s", "three!", "l", [], datetime(1999, 1, 1)), (6, "s", "one two", "l", [], datetime(2030, 1, 1)),
            (7, "s", "five", "l", [], None), (8, "s", "four", "l", [], None)]
    return spark.createDataFrame(rows, "item_id long, src string, title string, link string, categories array<string>, published timestamp_ntz")


def test_undated_and_old_items_are_sent_once(spark, tmp_path):
    items = undated(spark)
    filters = spark.createDataFrame([(1, "*", [], [])], "filter_id int, cond string, sources array<string>, pubs array<string>")
    pubs = subs.desk_pubs(spark).filter("name = 'main'")
    jobs.start_route(in_files(items, tmp_path / "in", "item_id", parts=4), filters, pubs, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 7]
    keyed = tables.with_key(tables.prepared(in_files(items, tmp_path / "in2", "item_id", parts=4)))
    assert sorted(r.item_id for r in jobs.drain(jobs.dedup_stream(keyed), "d").collect()) == [1, 2, 4, 7]


def test_memory_forgets_after_its_time(spark, tmp_path):
    found = tables.with_key(tables.prepared(undated(spark)))
    forever, never = jobs.ArrivalMemory(spark, str(tmp_path / "a")), jobs.ArrivalMemory(spark, str(tmp_path / "b"), timedelta(0))
    assert [m(found, b).count() for m in (forever, never) for b in (0, 1)] == [4, 0, 4, 4]
    assert forever(found, 0).count() == 4  # a repeated batch replaces itself


def test_a_layout_and_a_deduplicator_of_ones_own(spark, items, tmp_path):
    filters, pubs = subs.desk_filters(spark), subs.desk_pubs(spark)
    jobs.start_route(in_files(items, tmp_path / "in", "published", parts=2), filters, pubs, str(tmp_path / "out"), str(tmp_path / "log"), scoped=True,
                     dedup=lambda found, batch: found, layout=lambda: F.upper("title")).awaitTermination()
    want = routing.route_items(items, filters, pubs, scoped=True, dedup=lambda found: found)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.item_id, r.message) for r in got.collect()) == sorted((r.item_id, r.title.upper()) for r in want.collect())


@pytest.mark.parametrize("name", ["stream_route", "stream_dedup", "stream_dedup_fifo", "stream_throttle", "stream_source_throttle", "stream_outbox",
                                  "stream_throttle_late", "stream_delivery_cap", "stream_delivery_report", "stream_capacity", "stream_outbox_errors"])
def test_streams_over_folder_tables(spark, folder, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
        spark.range(5).write.parquet(str(tmp_path / f"{table}_old.parquet"))  # a sibling that isn't the table
    want = sql_rows(duck(folder), ORACLE[name])
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == want


def test_feeds_as_a_stream(spark, items, tmp_path):
    path = str(tmp_path / "feed")
    feeds.write_rss(items, path, ["src"])
    got = jobs.drain(feeds.stream_feeds(spark, f"{path}/*"), "feeds")
    assert sorted(r.title for r in got.collect()) == sorted(r.title for r in items.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_ordered_throttle_over_late_files(spark, folder, tmp_path, parts):
    pulls = tables.pulls(spark, folder)
    for stream in jobs.arriving(pulls, "ts", str(tmp_path / "in"), timedelta(hours=6), parts):
        kept = ordered.throttle_ordered(stream, "user_id", timedelta(hours=6), delay=timedelta(hours=12), begin=20, end=5)
        got = jobs.drain(kept, "t", str(tmp_path)).filter("id is not null")
    want = throttle.throttle(pulls, "user_id", timedelta(hours=6)).filter(~is_muted(F.col("ts"), 20, 5))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordered_throttle_keeps_the_first_row_without_a_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5), (1, None, 6), (1, datetime(2024, 1, 1), 7), (2, datetime(2024, 1, 1), 2 ** 53 + 1), (None, None, 9)],
                                 "k long, ts timestamp_ntz, id long")
    for stream in jobs.arriving(rows, "ts", str(tmp_path / "in"), timedelta(hours=1), 1):
        got = jobs.drain(ordered.throttle_ordered(stream, "k", timedelta(hours=1), delay=timedelta(hours=2)), "t", str(tmp_path)).filter("id is not null")
    assert sorted(r.id for r in got.collect()) == [5, 7, 9, 2 ** 53 + 1]


@pytest.fixture(scope="module")
def routed(spark, folder):
    rows = routing.route_items(tables.document_items(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark))
    return rows.select("item_id", "pub", "published").cache()


@pytest.mark.parametrize("parts", [1, 5])
def test_ordered_cap_over_late_files(spark, routed, tmp_path, parts):
    late = timedelta(hours=3)
    hourly = routed.withColumn("published", F.date_trunc("day", "published").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(item_id % 90 as int))"))
    for stream in jobs.arriving(hourly, "published", str(tmp_path / "in"), late, parts):
        got = jobs.drain(ordered.cap_ordered(stream, 2, delay=2 * late), "c", str(tmp_path)).filter("pub is not null")
    want = routing.delivery_cap(hourly, 2)
    assert sorted(map(tuple, got.select("item_id", "pub", "event").collect())) == sorted(map(tuple, want.select("item_id", "pub", "event").collect()))
    assert got.filter("event = 'pub_full'").count() > 3
    # the hours are freed: what is left is the closing row's
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "log"))
    assert held.count() <= 1


def test_cap_of_rows_without_a_time(spark, tmp_path):
    rows = spark.createDataFrame([(i, "p", None) for i in range(5)], "item_id long, pub string, published timestamp_ntz")
    got = jobs.drain(ordered.cap_ordered(in_files(rows, tmp_path / "in", "item_id", parts=3), 3), "c", str(tmp_path)).collect()
    assert sorted((r.item_id, r.event) for r in got) == [(0, "pub_send"), (1, "pub_send"), (2, "pub_send"), (3, "pub_full"), (4, "pub_full")]


def test_remembered_keys_grow_by_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame([(i, "g", f"k{i % 30 if i < 60 else i % 5}", datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(120)],
                                 "item_id long, src string, key string, published timestamp_ntz")
    for capacity in (3, 10, 1000):
        path = tmp_path / str(capacity)
        got = jobs.drain(state.dedup_fifo_stream(in_files(rows, path / "in", "published", parts=6), "src", capacity), "f", str(path))
        assert sorted(r.item_id for r in got.collect()) == sorted(r.item_id for r in dedup.dedup_fifo(rows, "src", capacity).collect())
        assert [tuple(r) for r in state.remembered_keys(spark, str(path / "log")).collect()] == [("g", min(capacity, 30))]


def test_remembered_keys_with_a_ttl(spark, tmp_path):
    rows = spark.createDataFrame([(1, "g", "a", datetime(2024, 1, 1)), (2, "g", "a", datetime(2024, 1, 2))], "item_id long, src string, key string, published timestamp_ntz")
    stream = in_files(rows, tmp_path / "in", "published", parts=2)
    # a stream with processing time never runs out of batches without data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        assert jobs.drain(state.dedup_fifo_stream(stream, "src", 5, ttl=timedelta(days=1)), "f").count() == 1
        assert jobs.drain(state.dedup_fifo_stream(stream, "src", 5, ttl=timedelta(milliseconds=1)), "f").count() == 2
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(state.PROVIDER)
    with state.rocksdb(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKSDB
    assert spark.conf.get(state.PROVIDER) == before


def test_a_long_stream_keeps_few_folders(spark, tmp_path):
    """Fifty micro-batches: the memory stays a few folders, and nothing of a batch is left behind."""
    items = spark.createDataFrame([(i, "s", f"title {i % 40}", "l", [], datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(50)],
                                  "item_id long, src string, title string, link string, categories array<string>, published timestamp_ntz")
    filters = spark.createDataFrame([(1, "title", [], [])], "filter_id int, cond string, sources array<string>, pubs array<string>")
    memory = jobs.ArrivalMemory(spark, str(tmp_path / "keys"), every=8)
    shared = Path(shared_dir(spark))
    before, most = {p.name for p in shared.iterdir()} if shared.exists() else set(), 0

    def publish(rows, batch_id):
        nonlocal most
        rows.select("item_id").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
        most = max(most, len(list((tmp_path / "keys").iterdir())))

    jobs.start_route(in_files(items, tmp_path / "in", "published", parts=50), filters, subs.desk_pubs(spark).filter("name = 'main'"), publish, str(tmp_path / "log"),
                     dedup=memory).awaitTermination()
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
    assert most <= 10
    assert {p.name for p in shared.iterdir()} <= before


def test_names_that_repeat_are_refused(spark, items, tmp_path):
    pubs = subs.desk_pubs(spark)
    with pytest.raises(ValueError, match="repeated publisher names: main"):
        jobs.start_route(items, subs.desk_filters(spark), pubs.union(pubs.filter("name = 'main'")), "out", str(tmp_path))
    sources = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    with pytest.raises(ValueError, match="repeated source names: b"):
        jobs.start_route(items, subs.desk_filters(spark), pubs, "out", str(tmp_path), sources=sources)


def test_a_failing_row_stops_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("p", f"m{i}", "u", i) for i in range(6)], "pub string, message string, url string, item_id long")

    def send(pub, message, url):
        if message in ("m2", "m4"):
            raise OSError(f"no {message}")

    for _ in range(2):  # a repeated batch replaces itself
        sinks.sending_publisher(str(tmp_path), send)(rows, 3)
    assert spark.read.parquet(str(tmp_path)).count() == 6
    assert sorted((r.item_id, r.error) for r in sinks.failed(spark, str(tmp_path)).collect()) == [(2, "OSError: no m2"), (4, "OSError: no m4")]


def test_a_killed_task_leaves_no_partial_output(spark, tmp_path):
    rows = spark.range(0, 8, numPartitions=4).select(F.lit("p").alias("pub"), F.col("id").cast("string").alias("message"), F.lit("u").alias("url"))

    def send(pub, message, url):
        if message == "7":
            raise SystemExit("the worker goes")  # not an error of the row

    with pytest.raises(Exception):  # noqa: B017
        sinks.sending_publisher(str(tmp_path), send)(rows, 0)
    assert not [p for p in tmp_path.rglob("part-*.parquet") if "_temporary" not in str(p)]
    sinks.sending_publisher(str(tmp_path), lambda *row: None)(rows, 0)
    assert spark.read.parquet(str(tmp_path)).count() == 8


class FakeState:
    """A processor's state by plain dictionaries, counting the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, name, *schemas):
        state, held = self, {}

        class Map:
            def __getattr__(self, call):
                state.calls += 1
                return {"containsKey": held.__contains__, "getValue": held.get, "updateValue": held.__setitem__, "removeKey": held.pop,
                        "keys": lambda: list(held), "exists": lambda: bool(held)}[call]

        return Map()

    def getValueState(self, name, schema):
        state, held = self, []

        class Value:
            def __getattr__(self, call):
                state.calls += 1
                return {"exists": lambda: bool(held), "get": lambda: held[-1], "update": held.append, "clear": held.clear}[call]

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


@pytest.mark.parametrize("loose", [0, 3, 60, 10_000])
def test_a_batch_costs_a_key_few_calls(monkeypatch, loose):
    """Rows of many hours are judged as in the batch operator, and the calls to the state don't grow with the hours while rows are few."""
    import random

    import pandas as pd

    monkeypatch.setattr(ordered, "LOOSE", loose, raising=False)
    draw, hour = random.Random(3), 3_600_000
    rows = sorted((draw.randrange(300 * hour * 1000), i) for i in range(400))
    want, due = [], 0
    for at, i in rows:
        if at >= due:
            want.append(str(i))
            due = at + 6 * hour * 1000
    state, processor, got = FakeState(), ordered.OrderedCooldown(hour), []
    processor.init(state)
    key = ("k", 6 * hour * 1000)
    for watermark, low, high in ((0, 0, 150), (100, 150, 301), (290, 301, 301), (400, 301, 301)):
        part = [(at, i) for at, i in rows if low * hour * 1000 <= at < high * hour * 1000]
        draw.shuffle(part)
        if part:
            frame = pd.DataFrame({"at": [a for a, _ in part], "tie": [i for _, i in part], "row": [str(i) for _, i in part], "late": False})
            got += [r for f in processor.handleInputRows(key, iter([frame[:90], frame[90:]]), None) for r in f["row"]]
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self, at=watermark: at * hour})()
        for timer in sorted(t for t in state.timers if t <= watermark * hour):
            state.timers.discard(timer)
            got += [r for f in processor.handleExpiredTimer(key, now, None) for r in f["row"]]
    assert got == want and not state.timers
    assert loose < 10_000 or state.calls < 60
