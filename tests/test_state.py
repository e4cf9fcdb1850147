"""Dedup and throttle against row-by-row brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedup, throttle
from tidewire.operators.dedup import KeyMemory
from tidewire.session import durable

ITEMS = "item_id long, src string, key string, published timestamp_ntz"
START = datetime(2024, 1, 1)


def keep_flags(keys, capacity):
    memory = KeyMemory(capacity)
    return [memory.keep(k) for k in keys]


def test_memory_vectors():
    assert keep_flags("k k l m n o m".split(), 4) == [True, False, True, True, True, True, False]
    assert keep_flags("abaca", 2) == [True, True, False, True, True]


def stream_of(keys, src="s", start=0):
    return [(start + i, src, k, START + timedelta(seconds=i)) for i, k in enumerate(keys)]


def brute_fifo(rows, capacity):
    kept, seen = set(), {}
    for item_id, src, key, published in sorted(rows, key=lambda r: (r[3] or datetime.min, r[0])):
        if seen.setdefault(src, KeyMemory(capacity)).keep(key):
            kept.add(item_id)
    return kept


@pytest.mark.parametrize("chunk_rows", [1_000_000, 60])
def test_fifo(spark, chunk_rows):
    rng = random.Random(7)
    rows = stream_of([rng.choice("abcdefghij") for _ in range(700)], "hot")
    rows += stream_of([rng.choice("abcdef") for _ in range(50)], "mild", 10_000)
    rows += stream_of([rng.choice("abc") for _ in range(80)], "few", 20_000)
    rows += [(30_000 + i, "hot", rng.choice("abcdefghij"), None) for i in range(30)]  # without a time: first of all
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ITEMS)
    got = [r.item_id for r in dedup.dedup_fifo(df, "src", 4, chunk_rows=chunk_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_fifo(rows, 4)


def test_fifo_chunks_that_stay_unsettled(spark):
    """A strict cycle one longer than the memory: every chunk depends on the one before."""
    rows = stream_of([str(i % 5) for i in range(203)] + list("44321"), "hot")
    df = spark.createDataFrame(rows, ITEMS)
    got = {r.item_id for r in dedup.dedup_fifo(df, "src", 4, chunk_rows=40).collect()}
    assert got == brute_fifo(rows, 4)


def test_first(spark):
    rows = [(3, "s", "a", START), (1, "s", "a", START), (2, "s", "b", START - timedelta(days=1)), (4, "s", "b", None)]
    got = {r.item_id for r in dedup.dedup_first(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {1, 4}  # an item without a time comes first


def test_capacity(spark):
    df = spark.range(9000).select(F.col("id").cast("string").alias("key"))
    assert tuple(dedup.distinct_keys(df).first()) == (9000, False)


def brute_throttle(rows, cooldown):
    kept, last = set(), {}
    for user, ts, ident in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if user not in last or ts - last[user] >= cooldown:
            last[user] = ts
            kept.add(ident)
    return kept


def pulls(seed, users, count, span):
    rng = random.Random(seed)
    return [(rng.choice(users), START + timedelta(seconds=rng.randrange(span)), i) for i in range(count)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 60, 0])
@pytest.mark.parametrize("cooldown", [timedelta(seconds=1), timedelta(seconds=37), timedelta(hours=2)])
def test_throttle(spark, cooldown, hot_rows):
    rows = pulls(3, [1, 1, 1, 1, 2, 3, None], 400, 4000)
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz, id long")
    got = [r.id for r in throttle.throttle(df, "user", cooldown, hot_rows=hot_rows, cell_rows=5).collect()]
    want = brute_throttle(rows, cooldown)
    assert len(got) == len(set(got)) and set(got) == want


def test_throttle_edges(spark):
    hour = timedelta(hours=1)
    rows = [("a", START, 1), ("a", START, 0), ("a", START + hour, 2), ("a", START + 2 * hour - timedelta(microseconds=1), 3)]
    df = spark.createDataFrame(rows, "user string, ts timestamp_ntz, id long")
    for hot_rows in (100, 0):
        assert {r.id for r in throttle.throttle(df, "user", hour, hot_rows=hot_rows).collect()} == {0, 2}
    with pytest.raises(ValueError):
        throttle.throttle(df, "user", timedelta(0))


def test_throttle_cooldown_per_key(spark):
    rows = [(u, START + timedelta(minutes=m), 100 * u + m) for u in (1, 2) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz, id long")
    cooldown = F.when(F.col("user") == 1, F.lit(timedelta(minutes=15))).otherwise(F.lit(timedelta(minutes=20)))
    want = {100 + m for m in range(0, 60, 15)} | {200 + m for m in range(0, 60, 20)}
    for hot_rows in (1000, 0):
        assert {r.id for r in throttle.throttle(df, "user", cooldown, hot_rows=hot_rows).collect()} == want


def test_muted_rows_spend_the_cooldown(spark):
    rows = [(1, START.replace(hour=h), h) for h in (4, 5, 10)]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz, id long")
    got = throttle.throttle_then_mute(df, "user", timedelta(hours=3), 20, 5)
    assert {r.id for r in got.collect()} == {10}


def test_task_functions_travel_with_the_job(tmp_path):
    """Workers do not need the package on their path."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((KeyMemory, throttle._cooldown_stream("k", "ts"))))
    code = "import pickle; memory, _ = pickle.load(open('f', 'rb')); assert memory(2).keep('a')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_fifo_keeps_rows_without_a_group(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", ""]), rng.choice("abcdefg"), rng.choice([None, START + timedelta(seconds=i)])) for i in range(300)]
    df = spark.createDataFrame(rows, ITEMS)
    for capacity in (2, 100):
        for chunk_rows in (1_000_000, 40):
            got = {r.item_id for r in dedup.dedup_fifo(df, "src", capacity, chunk_rows=chunk_rows).collect()}
            assert got == brute_fifo(rows, capacity)


@pytest.mark.parametrize("hot_rows", [1_000_000, 0])
def test_throttle_without_times(spark, hot_rows):
    """Rows without a time come first, so each key keeps one of them, by the smallest id."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, START + timedelta(minutes=rng.randint(0, 500))])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, user_id long, ts timestamp_ntz")
    due, want = {}, set()
    for i, user, ts in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        if ts is None:
            if user not in due:
                due[user] = datetime.min
                want.add(i)
        elif user not in due or ts >= due[user]:
            due[user] = ts + timedelta(minutes=45)
            want.add(i)
    assert {r.id for r in throttle.throttle(df, "user_id", timedelta(minutes=45), hot_rows=hot_rows).collect()} == want


def test_hot_throttle_has_no_window_over_all_cells(spark):
    rows = spark.range(3000).select("id", F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    assert throttle.throttle(rows, "user_id", timedelta(seconds=2), hot_rows=0, cell_rows=1).count() == 1500
    cells = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("_cell"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("_low"))
    later = {r._cell: r._later for r in throttle._later_lows(cells, "k").collect()}
    assert all(later[c] == (c // 7 * 7 + 7 if c // 7 * 7 + 7 < 10_000 else None) for c in range(10_000))


def test_a_repetitive_group_settles_in_few_rounds(spark, monkeypatch):
    """Twenty keys, then four of them again and again over fifty chunks."""
    keys = [str(i) for i in range(20)] + [str(i % 4) for i in range(980)]
    df = spark.createDataFrame(stream_of(keys, "hot"), ITEMS)
    written = []
    monkeypatch.setattr(dedup, "durable", lambda frame, *name: written.append("stale" in frame.columns) or durable(frame, *name))
    got = {r.item_id for r in dedup.dedup_fifo(df, "src", 8, chunk_rows=20).collect()}
    assert got == brute_fifo(stream_of(keys, "hot"), 8)
    assert sum(written) <= 3
