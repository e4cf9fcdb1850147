"""Mute hours: a cyclic half-open interval of day hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_hour(hour: int) -> int:
    if not 0 <= hour <= 23:
        raise ValueError(f"hour must be in 0..23, got {hour}")
    return hour


def is_muted(ts: Column, begin: int | Column | None, end: int | Column | None) -> Column:
    """``begin`` included, ``end`` not; equal hours mute the whole day, a missing pair mutes nothing."""
    if begin is None or end is None:
        return F.lit(False)
    begin, end = (F.lit(check_hour(h)) if isinstance(h, int) else h for h in (begin, end))
    hours_in = F.pmod(F.hour(ts) - begin, F.lit(24)) < F.pmod(end - begin, F.lit(24))
    return F.coalesce((begin == end) | hours_in, F.lit(False))
