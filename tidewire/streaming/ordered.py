"""Streams judged in the order of the rows' own times, whatever order they arrive in.

Rows wait in state until the watermark has passed them, and are then judged in order. The result is that of the batch operator for every
arrival order and every cut into micro-batches, as long as no row is later than ``delay``. Rows that are later are dropped by Spark and
counted in the progress of the query. Rows without a time have no place in that order and don't wait.

A row waits as JSON beside its time, so every column type comes out as it went in.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.functions.hours import is_muted
from tidewire.operators.routing import CHANNEL_SLOTS
from tidewire.operators.throttle import interval_micros

HOUR = 3_600_000
# Times in JSON keep their microseconds.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
WAITING = T.StructType([T.StructField("at", T.ArrayType(T.LongType())), T.StructField("tie", T.ArrayType(T.LongType())), T.StructField("row", T.ArrayType(T.StringType()))])
NO_TIE = -(1 << 63)
# Waiting rows of a key that are kept as one value.
LOOSE = 10_000


def frame(waiting: tuple | None) -> pd.DataFrame:
    """Waiting rows from state."""
    at, tie, row = waiting if waiting is not None else ([], [], [])
    return pd.DataFrame({"at": np.array(at, np.int64), "tie": np.array(tie, np.int64), "row": np.array(row, object)})


def waiting(rows: pd.DataFrame) -> tuple:
    return rows["at"].tolist(), rows["tie"].tolist(), rows["row"].tolist()


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at", "tie", "row"], ignore_index=True)


class OrderedCooldown(StatefulProcessor):
    """Pass a row when the last passed row of its key is a cooldown ago, which is the last part of the key, in microseconds.

    The waiting rows of a key are one value with one timer while they are few: a batch costs a key a few calls to its state, however many hours its
    rows are of. More than ``LOOSE`` rows go to buckets of time, so that of a crowded key one that arrives touches its own bucket only, and a
    bucket is judged and freed when the watermark has passed its end.
    """

    def __init__(self, bucket: int):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loose = handle.getValueState("loose", WAITING)
        self.held = handle.getMapState("held", T.StructType([T.StructField("bucket", T.LongType())]), WAITING)
        self.due = handle.getValueState("due", T.StructType([T.StructField("at", T.LongType())]))
        self.undated = handle.getValueState("undated", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.loose.exists()
        loose = self.waiting_loose() if known else []
        for batch in rows:
            if batch["late"].any():
                timeless = batch[batch["late"]]
                if not self.undated.exists():
                    self.undated.update((True,))
                    yield in_order(timeless)[["row"]].head(1)
                batch = batch[~batch["late"]]
            loose += zip(batch["at"].tolist(), batch["tie"].tolist(), batch["row"].tolist())
            if len(loose) > LOOSE:
                self.shelve(loose)
                loose = []
        self.keep(loose, known)

    def waiting_loose(self) -> list[tuple]:
        return list(zip(*self.loose.get(), strict=True))

    def keep(self, loose: list[tuple], known: bool) -> None:
        """Few rows as one value, which is looked at when the first of their buckets has passed."""
        if loose:
            self.loose.update(tuple(map(list, zip(*loose, strict=True))))
            self.handle.registerTimer((min(loose)[0] // (1000 * self.bucket) + 1) * self.bucket)
        elif known:
            self.loose.clear()

    def shelve(self, rows: list[tuple]) -> None:
        parts = pd.DataFrame(rows, columns=["at", "tie", "row"])
        for bucket, part in parts.groupby(parts["at"] // (1000 * self.bucket)):
            name = (int(bucket),)
            known = self.held.containsKey(name)
            if not known:
                self.handle.registerTimer((int(bucket) + 1) * self.bucket)
            self.held.updateValue(name, waiting(pd.concat([frame(self.held.getValue(name) if known else None), part])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers may come in any order, buckets may not
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket
        loose = self.waiting_loose() if self.loose.exists() else []
        ready = sorted(r for r in loose if r[0] // (1000 * self.bucket) < passed)
        if ready:
            self.keep([r for r in loose if r[0] // (1000 * self.bucket) >= passed], True)
        crowded = sorted(b for (b,) in self.held.keys() if b < passed) if self.held.exists() else []
        for bucket in crowded:
            until = bisect.bisect_left(ready, ((bucket + 1) * 1000 * self.bucket,))
            yield self.judged(key, sorted([*ready[:until], *zip(*self.held.getValue((bucket,)), strict=True)]))
            self.held.removeKey((bucket,))
            ready = ready[until:]
        if ready:
            yield self.judged(key, ready)

    def judged(self, key, rows: list[tuple]) -> pd.DataFrame:
        """Those of the rows, which are in order, that pass."""
        times = [r[0] for r in rows]
        at = bisect.bisect_left(times, self.due.get()[0]) if self.due.exists() else 0
        kept, due = [], None
        while at < len(times):
            kept.append(rows[at][2])
            due = times[at] + int(key[-1])
            at = bisect.bisect_left(times, due, at)
        if due is not None:
            self.due.update((due,))
        return pd.DataFrame({"row": np.array(kept, object)})

    def close(self) -> None:
        pass


class HourlyCap(StatefulProcessor):
    """The first ``cap`` rows of a publisher's hour, which is the last part of the key.

    State holds the rows that may still be among them, ``cap`` at most, until the watermark has passed the hour. A row
    that ``cap`` earlier ones are known of is full at once.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", WAITING)
        self.sent = handle.getValueState("sent", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[-1]):
            yield from self.timeless(rows)
            return
        if not self.held.exists():
            self.handle.registerTimer(int(key[-1]) + HOUR)
        held = frame(self.held.get() if self.held.exists() else None)
        for batch in rows:
            held = in_order(pd.concat([held, batch[["at", "tie", "row"]]]))
            yield held.iloc[self.cap:][["row"]].assign(event="pub_full")
            held = held.iloc[:self.cap]
        self.held.update(waiting(held))

    def timeless(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """There is no hour to wait for: the first to arrive are sent, and stay counted."""
        sent = self.sent.get()[0] if self.sent.exists() else 0
        for batch in rows:
            free = max(0, self.cap - sent)
            batch = in_order(batch)
            yield batch.iloc[:free][["row"]].assign(event="pub_send")
            yield batch.iloc[free:][["row"]].assign(event="pub_full")
            sent += len(batch)
        self.sent.update((sent,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield frame(self.held.get())[["row"]].assign(event="pub_send")
        self.held.clear()

    def close(self) -> None:
        pass


def packed(rows: DataFrame, ts: str, tie: str, delay: timedelta, *keys: Column) -> DataFrame:
    """``keys``, at (microseconds), tie, late (no time), row (JSON) of every row, with the watermark on its time."""
    timed = rows.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", f"{int(delay.total_seconds())} seconds")
    return timed.select(
        *keys, F.coalesce(F.unix_micros("_time"), F.lit(0)).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(NO_TIE)).alias("tie"),
        F.col("_time").isNull().alias("late"), F.to_json(F.struct(*rows.columns), FORMATS).alias("row"), "_time")


def unpacked(found: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    return found.select(F.from_json("row", schema, FORMATS).alias("_r"), *more).select("_r.*", *more)


def throttle_ordered(rows: DataFrame, key: str, cooldown: timedelta | Column, ts: str = "ts", tie: str = "id", delay: timedelta = timedelta(hours=1),
                     bucket: timedelta = timedelta(hours=1), begin: int | Column | None = None, end: int | Column | None = None) -> DataFrame:
    """The batch ``throttle``, then the mute hours, over a stream whose rows may be ``delay`` late; a row comes out once nothing before it can come.

    Of the rows without a time the first to arrive is kept for each key.
    """
    cooldown = F.lit(cooldown) if isinstance(cooldown, timedelta) else cooldown
    keyed = packed(rows, ts, tie, delay, F.col(key).alias("_key"), interval_micros(cooldown).alias("_cool"))
    kept = keyed.groupBy("_key", "_cool").transformWithStateInPandas(
        OrderedCooldown(int(bucket.total_seconds() * 1000)), "row string", "Append", "EventTime")
    return unpacked(kept, rows.schema).filter(~is_muted(F.col(ts), begin, end))


def cap_ordered(rows: DataFrame, cap: int = CHANNEL_SLOTS, delay: timedelta = timedelta(hours=1), ts: str = "published", tie: str = "item_id") -> DataFrame:
    """The batch ``delivery_cap`` over a stream of routed rows: ``pub_full`` as soon as it is known, ``pub_send`` when the hour is over.

    Of a publisher's rows without a time the first ``cap`` to arrive are sent.
    """
    hour = F.unix_millis(F.date_trunc("hour", F.col(ts).cast("timestamp")))
    keyed = packed(rows, ts, tie, delay, F.col("pub").alias("_pub"), hour.alias("_hour"))
    capped = keyed.groupBy("_pub", "_hour").transformWithStateInPandas(HourlyCap(cap), "row string, event string", "Append", "EventTime")
    return unpacked(capped, rows.schema, "event")
