"""Joins that broadcast only what was measured to be small, and spread hot keys otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (at most ``max_rows`` + 1 rows of it): row count and text size within bounds?"""
    probe = df.limit(max_rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = probe.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner",
                small_fits: bool | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join a large table with a lookup table whose keys may be hot on the large side.

    A lookup table that measures small is broadcast, the large side stays where it is. A larger
    one is copied once per salt and joined on (key, salt): a key holding a third of all rows is
    then spread over ``SALTS`` tasks. ``how`` is inner, left, left_semi or left_anti.
    """
    fits = is_small(small, max_rows) if small_fits is None else small_fits
    keys = [on] if isinstance(on, str) else list(on)
    if fits:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns]), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def power_of(count: str) -> Column:
    """Counts by powers of two."""
    return F.floor(F.log2(F.greatest(F.col(count), F.lit(1))))


def frequent_power(index: DataFrame, count: str, max_rows: int) -> int:
    """The lowest power of two of ``count`` from which on the rows measure small; 0 if all of them do."""
    sizes = index.groupBy(power_of(count).alias("power")).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).collect()
    rows, size = 0, 0
    for found in sorted(sizes, key=lambda r: -r.power):
        rows, size = rows + found.n, size + found["size"]
        if rows > max_rows or size > BROADCAST_BYTES:
            return found.power + 1
    return 0


def frequent_join(big: DataFrame, index: DataFrame, on: str | list[str], count: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with an index that grows with ``big``: ``count`` says how many rows of ``big`` have the row's key, one value per key.

    An index of up to ``max_rows`` rows that measures small is broadcast whole. Of a larger one the rows of the most frequent keys
    are, as many as are always small; the other keys are rare, so their rows are dealt out by the key and no task gets many. Nothing is copied.
    """
    if is_small(index, max_rows):
        return big.join(F.broadcast(index.drop(count)), on)
    power, least = power_of(count), frequent_power(index, count, BROADCAST_ROWS)
    frequent = index.filter(power >= least).drop(count)
    rest = big.join(F.broadcast(frequent.select(on).distinct()), on, "left_anti")
    return big.join(F.broadcast(frequent), on).unionByName(rest.join(index.filter(power < least).drop(count).hint("merge"), on))
