"""Repeated items: first seen wins, and its bounded form with a fixed number of remembered keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.sizing import lookup_join
from tidewire.session import durable

ORDER = ["published", "item_id"]
# Fixed value: remembered keys of the default setup.
CAPACITY = 8192
CHUNK_ROWS = 1_000_000


def dedup_first(items: DataFrame, keys: Iterable[str] = ("key",), order: Iterable[str] = ORDER) -> DataFrame:
    """The first row of each key in ``order``.

    The rank filter is applied before the shuffle as well, so each task sends one row per key
    and a key repeated a billion times costs its receiver one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def distinct_keys(items: DataFrame) -> DataFrame:
    """Number of distinct keys, and whether ``CAPACITY`` remembered keys make dedup exact."""
    count = items.agg(F.count_distinct("key").alias("keys"))
    return count.select("keys", (F.col("keys") <= CAPACITY).alias("fits"))


class KeyMemory:
    """The last ``capacity`` kept keys, oldest out first; a repeat does not renew its key."""

    def __init__(self, capacity: int, kept: Iterable[str] = ()):
        self.capacity = capacity
        self.queue = deque(kept)
        self.known = set(self.queue)

    def keep(self, key: str) -> bool:
        if key in self.known:
            return False
        if len(self.queue) == self.capacity:
            self.known.discard(self.queue.popleft())
        self.queue.append(key)
        self.known.add(key)
        return True


def dedup_fifo(items: DataFrame, group: str, capacity: int = CAPACITY, key: str = "key",
               order: Iterable[str] = ORDER, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per group, drop a row iff its key is among the group's last ``capacity`` kept keys.

    Groups that never hold more keys than fit need no memory: first seen wins, any size. Of the
    others, groups up to ``chunk_rows`` rows stream through one task each in order. A larger
    group is cut into ordered chunks that run at once, see :func:`_dedup_chunks`.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    order = list(order)
    # as text a missing group is a group like any other to the joins and tasks below
    source, items, group = items, items.withColumn("_group", F.to_json(F.struct(group))), "_group"
    per_key = items.groupBy(group, key).agg(F.count("*").alias("n"))
    sizes = durable(
        per_key.groupBy(group).agg(F.sum("n").alias("_rows"), F.count("*").alias("_keys"))
        .select(group, F.when(F.col("_keys") <= capacity, "first")
                .when(F.col("_rows") <= chunk_rows, "stream").otherwise("chunks").alias("_way"))
    )
    ways = {r._way for r in sizes.select("_way").distinct().collect()}
    tagged = lookup_join(items, sizes, group)
    if len(ways) > 1:
        tagged = durable(tagged)  # read once per way
    kept = []
    for way in sorted(ways):
        rows = tagged.filter(F.col("_way") == way).drop("_way")
        if way == "first":
            rows = dedup_first(rows, (group, key), order)
        elif way == "stream":
            ordered = rows.repartition(group).sortWithinPartitions(group, *order)
            rows = ordered.mapInArrow(_fifo_stream(group, key, capacity), ordered.schema)
        else:
            rows = _dedup_chunks(rows, group, key, order, capacity, chunk_rows)
        kept.append(rows.select(*source.columns))
    return reduce(DataFrame.unionByName, kept) if kept else source


def _fifo_stream(group: str, key: str, capacity: int):
    """Rows sorted by (group, order) through one :class:`KeyMemory` per group, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory = object(), None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (g, k) in enumerate(zip(batch.column(group).to_pylist(), batch.column(key).to_pylist())):
                if g != current:
                    current, memory = g, KeyMemory(capacity)
                keep[i] = memory.keep(k)
            yield batch.filter(pa.array(keep))

    return run


def _dedup_chunks(items: DataFrame, group: str, key: str, order: list[str], capacity: int, chunk_rows: int) -> DataFrame:
    """Large groups in ordered chunks, repeated until the memories agree.

    Every chunk first runs from an empty memory. Then the chunks of a group are walked in order, as
    rows of their start and end memories: a chunk that started from what the one before it ended with is
    settled, and so is one whose keys all lie in that memory, which it leaves as it is. All others run again
    from there, until none is left: every round settles at least one more, so the end is exact. A feed that
    repeats few keys settles in two or three rounds, and so does one whose chunks are much longer than the
    memory. A chunk holds about ``chunk_rows`` rows, a memory at most ``capacity`` keys.
    """
    total = items.count()
    chunks = max(1, -(-total // chunk_rows))
    # the cut points are sampled, so the chunk numbers must be written down before use
    pinned = durable(items.repartitionByRange(chunks, group, *order).withColumn("_chunk", F.spark_partition_id()))
    at = [group, "_chunk"]
    group_type = items.schema[group].dataType.simpleString()
    state_schema = f"{group} {group_type}, _chunk int, started array<string>, ended array<string>, keys array<string>"

    def in_order(rows: pa.Table) -> pa.Table:
        return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in order], null_placement="at_start"))

    def end_state(rows: pa.Table, start: pa.Table) -> pa.Table:
        memory, ordered = KeyMemory(capacity, start["started"][0].as_py()), in_order(rows)[key]
        for k in ordered.to_pylist():
            memory.keep(k)
        keys = pc.unique(ordered).to_pylist()
        lists = pa.list_(pa.string())
        return start.append_column("ended", pa.array([list(memory.queue)], lists)).append_column(
            "keys", pa.array([keys if len(keys) <= capacity else None], lists))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory = object(), []
        for batch in batches:
            states = batch.to_pylist()
            for state in states:
                if state[group] != current:
                    current, memory = state[group], []
                state["stale"] = False
                if state["started"] != memory:
                    if state["keys"] is not None and set(state["keys"]) <= set(memory):
                        state["ended"] = memory
                    else:
                        state["stale"] = True
                    state["started"] = memory
                memory = state["ended"]
            yield pa.RecordBatch.from_pylist(states, batch.schema.append(pa.field("stale", pa.bool_())))

    def survivors(rows: pa.Table, start: pa.Table) -> pa.Table:
        memory, rows = KeyMemory(capacity, start["started"][0].as_py()), in_order(rows)
        return rows.filter(pa.array([memory.keep(k) for k in rows[key].to_pylist()], pa.bool_()))

    def run(starts: DataFrame, function, schema) -> DataFrame:
        rows = pinned if schema is pinned.schema else pinned.select(*dict.fromkeys([*at, key, *order]))
        rows = lookup_join(rows, starts.select(*at), at, "left_semi")
        starts = starts.select(*[F.col(c).alias(c) for c in starts.columns])  # columns apart from those of rows
        return rows.groupBy(*at).cogroup(starts.groupBy(*at)).applyInArrow(function, schema)

    empty = F.array().cast("array<string>")
    states = run(pinned.select(*at).distinct().withColumn("started", empty), end_state, state_schema)
    while True:
        states = durable(states.repartition(group).sortWithinPartitions(*at).mapInArrow(walk, f"{state_schema}, stale boolean"))
        stale = states.filter("stale").select(*at, "started")
        if stale.isEmpty():
            break
        states = states.filter("not stale").drop("stale").unionByName(run(stale, end_state, state_schema))
    return run(states.select(*at, "started"), survivors, pinned.schema).drop("_chunk")
