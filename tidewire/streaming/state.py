"""Keyed state of the streaming jobs: cooldown per key, remembered keys per group.

A micro-batch hands a key's rows over in no order, so they are put in time order first; what
one key brings per batch is bounded by the trigger's file or byte limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.functions.hours import is_muted
from tidewire.operators.throttle import NO_TIME, interval_micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store these processors need, for queries started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Cooldown(StatefulProcessor):
    """Pass a row when the last passed row of its key is a cooldown ago, which is the last part of the key, in microseconds.

    A row without a time comes before all others, as in the batch operator.
    """

    def __init__(self, ts: str, tie: str, columns: list[str]):
        self.ts, self.tie, self.columns = ts, tie, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.ts, self.tie], ignore_index=True, na_position="first")
        times = np.where(batch[self.ts].isna(), NO_TIME, batch[self.ts].to_numpy("datetime64[us]").astype("int64"))
        at = int(np.searchsorted(times, self.due.get()[0])) if self.due.exists() else 0
        kept, due = [], None
        while at < len(times):
            kept.append(at)
            due = int(times[at]) + int(key[-1])
            at = int(np.searchsorted(times, due))
        if due is not None:
            self.due.update((due,))
        yield batch.iloc[kept][self.columns]

    def close(self) -> None:
        pass


class RememberedKeys(StatefulProcessor):
    """Drop a row whose key is among the last ``capacity`` kept keys of its group.

    The keys are a ring: by slot, to know which one goes, and by name, to know which ones are there. A new key
    changes its own slot and names, so what a micro-batch writes grows with its new keys and not with what is remembered. With a
    ``ttl`` keys are forgotten that long after they were kept, too.
    """

    def __init__(self, capacity: int, key: str, order: list[str], ttl: timedelta | None = None):
        self.capacity, self.key, self.order, self.ttl = capacity, key, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.ttl.total_seconds() * 1000) if self.ttl else None
        name, slot = (T.StructType([T.StructField(n, t)]) for n, t in (("name", T.StringType()), ("slot", T.LongType())))
        self.ring = handle.getMapState("ring", slot, name, ttl)
        self.names = handle.getMapState("names", name, slot, ttl)
        self.next = handle.getValueState("next", slot)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, ignore_index=True, na_position="first")
        at = self.next.get()[0] if self.next.exists() else 0
        start, known, fresh = at, {}, {}
        mask = []
        for name in batch[self.key]:
            if name not in known:
                known[name] = self.names.containsKey((name,))
            mask.append(not known[name])
            if known[name]:
                continue
            slot = at % self.capacity
            gone = fresh.get(slot)
            if gone is None and at >= self.capacity and self.ring.containsKey((slot,)):
                gone = self.ring.getValue((slot,))[0]
            if gone is not None:
                known[gone] = False
            fresh[slot], known[name] = name, True
            at += 1
        if at > start:
            for slot, name in fresh.items():
                if start > slot or start >= self.capacity:
                    before = self.ring.getValue((slot,)) if self.ring.containsKey((slot,)) else None
                    if before is not None and not known.get(before[0], False):
                        self.names.removeKey(before)
                self.ring.updateValue((slot,), (name,))
                self.names.updateValue((name,), (slot,))
            self.next.update((at,))
        yield batch[mask]

    def close(self) -> None:
        pass


def throttle_stream(rows: DataFrame, key: str, cooldown: timedelta | Column, ts: str = "ts", tie: str = "id",
                    begin: int | Column | None = None, end: int | Column | None = None) -> DataFrame:
    """One cooldown for all, or one per key as a column; then the mute hours, which may be columns too. To be started under :func:`rocksdb`."""
    cooldown = F.lit(cooldown) if isinstance(cooldown, timedelta) else cooldown
    keyed = rows.withColumn("_cool", interval_micros(cooldown)).groupBy(key, "_cool")
    kept = keyed.transformWithStateInPandas(Cooldown(ts, tie, rows.columns), rows.schema, "Append", "None")
    return kept.filter(~is_muted(F.col(ts), begin, end))


def dedup_fifo_stream(rows: DataFrame, group: str, capacity: int, key: str = "key", order=("published", "item_id"), ttl: timedelta | None = None) -> DataFrame:
    """To be started under :func:`rocksdb`. With a ``ttl`` the stream goes by the clock, so run it all the time, or without batches that have no data."""
    processor = RememberedKeys(capacity, key, list(order), ttl)
    return rows.groupBy(group).transformWithStateInPandas(processor, rows.schema, "Append", "ProcessingTime" if ttl else "None")


def remembered_keys(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """``(group, keys)``: how many keys a stream of :func:`dedup_fifo_stream` remembers for each group, as of its last micro-batch.

    Read from the checkpoint, whether or not the stream runs.
    """
    held = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "names").load(checkpoint)
    return held.groupBy("key").agg(F.count("*").alias("keys")).select("key.*", "keys")
