"""Cooldown per key: a row passes when the last passed row of its key is a cooldown ago."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.hours import is_muted
from tidewire.plans.sizing import lookup_join
from tidewire.session import durable

HOT_ROWS = 5_000_000
# The place of a missing time, in microseconds.
NO_TIME = -(1 << 62)
CELL_ROWS = 100_000


def throttle(rows: DataFrame, key: str, cooldown: timedelta | Column, ts: str = "ts", tie: str = "id",
             hot_rows: int = HOT_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Keep a row iff ``ts`` is at least ``cooldown`` after the key's last kept row.

    The first row of a key is always kept; equal times go by ``tie``. A row without a time comes
    before all others, so one such row of a key is kept. The cooldown is positive and one value per key. Keys with up to ``hot_rows`` rows are sorted and streamed, a task
    holding one batch at a time. Hotter keys are resolved by joins alone, see :func:`_hot_kept`.
    """
    if isinstance(cooldown, timedelta):
        if cooldown <= timedelta(0):
            raise ValueError("cooldown must be positive")
        cooldown = F.lit(cooldown)
    # inside a struct a missing key is a key like any other to the joins below
    timed = rows.withColumn("_cool", cooldown).withColumn("_key", F.struct(key))
    hot = durable(timed.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select("_key"))
    none_hot = hot.isEmpty()
    calm = (timed if none_hot else lookup_join(timed, hot, "_key", "left_anti")).drop("_key")
    ordered = calm.repartition(key).sortWithinPartitions(key, ts, tie)
    kept = ordered.mapInArrow(_cooldown_stream(key, ts), ordered.schema).drop("_cool")
    if none_hot:
        return kept
    burning = lookup_join(timed, hot, "_key", "left_semi")
    return kept.unionByName(_hot_kept(burning, "_key", ts, tie, cell_rows).drop("_key", "_cool"))


def throttle_then_mute(rows: DataFrame, key: str, cooldown: timedelta | Column, begin: int | None, end: int | None,
                       ts: str = "ts", tie: str = "id") -> DataFrame:
    """A muted row still uses up its key's cooldown, so the throttle comes first."""
    return throttle(rows, key, cooldown, ts, tie).filter(~is_muted(F.col(ts), begin, end))


def _cooldown_stream(key: str, ts: str):
    """Rows sorted by (key, time): jump from kept row to kept row by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, due = object(), None
        for batch in batches:
            size = batch.num_rows
            if size == 0:
                continue
            codes = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy()
            times = batch.column(ts).cast(pa.int64()).fill_null(NO_TIME).to_numpy()
            cools = batch.column("_cool").cast(pa.int64()).to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            keep = np.zeros(size, dtype=bool)
            for start, stop in zip(starts, np.r_[starts[1:], size]):
                at = start
                if start == 0 and batch.column(key)[0].as_py() == last_key:
                    at += np.searchsorted(times[start:stop], due)
                while at < stop:
                    keep[at] = True
                    due = times[at] + cools[at]
                    at += np.searchsorted(times[at:stop], due)
            last_key = batch.column(key)[size - 1].as_py()
            yield batch.filter(pa.array(keep))

    return run


def micros(ts: Column) -> Column:
    """Wall-clock microseconds of a zone-less timestamp."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    return days * 86_400_000_000 + minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def interval_micros(span: Column) -> Column:
    """A day-time interval in microseconds."""
    span = span.cast("interval day to second")
    parts = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
    return sum(((F.extract(F.lit(part), span) * F.lit(size).cast("bigint")).cast("bigint") for part, size in parts.items()), F.lit(0))


def _hot_kept(rows: DataFrame, key: str, ts: str, tie: str, cell_rows: int) -> DataFrame:
    """The kept rows of keys too large for one task, without any per-key task.

    Each instant of a key links to the first instant a cooldown later; the kept rows are the
    chain of links from the key's first instant. Links are squared until no chain is that long
    (links, links of two, of four, ...), then the chain is filled in from the longest links
    down. For a span of T that is log2(T / cooldown) joins each way, every one spread over
    (key, instant).
    """
    at = micros(F.col(ts)) if rows.schema[ts].dataType.typeName() == "timestamp_ntz" else F.unix_micros(ts)
    rows = rows.withColumn("_at", F.coalesce(at, F.lit(NO_TIME)))
    instants = durable(
        rows.groupBy(key, "_at").agg(F.min(tie).alias(tie), F.min(interval_micros(F.col("_cool"))).alias("_cool")))
    links = [durable(_links(instants, key, cell_rows))]
    while True:
        once, again = links[-1], links[-1].select(key, F.col("_at").alias("_next"), F.col("_next").alias("_after"))
        longer = durable(once.join(again, [key, "_next"]).select(key, "_at", F.col("_after").alias("_next")))
        if longer.isEmpty():
            break
        links.append(longer)
    chain = instants.groupBy(key).agg(F.min("_at").alias("_at"))
    for step in reversed(links):
        chain = durable(chain.unionByName(chain.join(step, [key, "_at"]).select(key, F.col("_next").alias("_at"))))
    kept = instants.join(chain, [key, "_at"], "left_semi").select(key, "_at", tie)
    return rows.join(kept, [key, "_at", tie], "left_semi").drop("_at")


def _links(instants: DataFrame, key: str, cell_rows: int) -> DataFrame:
    """``(key, _at, _next)``: the first instant of the key at or after ``_at`` + cooldown.

    Instants and the times asked for meet in small cells of time (about ``cell_rows`` rows); what
    a cell cannot answer is the first instant of the next cell that has one.
    """
    fullest = instants.groupBy(key, F.floor(F.col("_at") / F.col("_cool")).alias("_b")).count().agg(F.max("count")).first()[0]
    slices = max(1, -(-(fullest or 0) // cell_rows))
    width = F.greatest(F.lit(1), F.floor(F.col("_cool") / slices)).cast("bigint")
    here = instants.select(key, F.col("_at").alias("_x"), F.lit(None).cast("bigint").alias("_at"), width.alias("_w"))
    asked = instants.select(key, (F.col("_at") + F.col("_cool")).alias("_x"), "_at", width.alias("_w"))
    cell = F.expr("_x div _w")
    points = here.unionByName(asked).select(
        key, "_x", "_at", cell.alias("_cell"), F.when(F.col("_at").isNull(), F.col("_x")).alias("_row"))
    # latest first; at equal times rows come before the questions they answer
    in_cell = Window.partitionBy(key, "_cell").orderBy(F.desc("_x"), F.desc_nulls_last("_row")).rowsBetween(Window.unboundedPreceding, 0)
    cells = _later_lows(points.groupBy(key, "_cell").agg(F.min("_row").alias("_low")), key)
    answered = points.withColumn("_near", F.last("_row", ignorenulls=True).over(in_cell)).filter(F.col("_at").isNotNull())
    return (
        answered.join(cells, [key, "_cell"])
        .select(key, "_at", F.coalesce("_near", "_later").alias("_next")).filter(F.col("_next").isNotNull())
    )


def _later_lows(cells: DataFrame, key: str) -> DataFrame:
    """``(key, _cell, _later)``: the lowest instant of the cells after each one.

    Cells go in blocks, about as many as a block has cells: each block looks inside itself, and what
    it cannot answer is the first instant of the next block. No window holds all cells of a key.
    """
    spread = cells.agg(F.min(F.when(F.col("_cell") > -(1 << 40), F.col("_cell"))), F.max("_cell")).first()
    low, high = spread[0] or 0, spread[1] or 0
    width = max(1, math.isqrt(max(0, high - low)))
    blocked = cells.withColumn("_block", F.expr(f"_cell div {width}"))
    inside = Window.partitionBy(key, "_block").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(key, "_block").agg(F.min("_low").alias("_first")).select(
        key, "_block", F.last("_first", ignorenulls=True).over(across).alias("_beyond"))
    near = blocked.withColumn("_near", F.last("_low", ignorenulls=True).over(inside))
    return near.join(blocks, [key, "_block"]).select(key, "_cell", F.coalesce("_near", "_beyond").alias("_later"))
