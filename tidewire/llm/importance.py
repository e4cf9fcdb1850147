"""Target-distribution importance resampling: documents drawn by how much more likely they are in a target corpus.

Features of a text are its runs of 1 to ``longest`` words, counted in hashed buckets. A bucket's gain is the logarithm of its share
in the target over its share in the documents, an array entry; a document's weight is the mean gain of its features. Weight
plus Gumbel noise, seeded by doc_id, is the score, and the documents with the highest scores are a sample without replacement.

The cutoff is selected, not sorted for, by weighted median of medians: each partition names the median of its keys that are left, and
the median of these, weighted by how many are left, splits all keys. A fourth of them at least falls on either side, so that every round
discards a guaranteed fraction, until the cutoff is met. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common
from tidewire.session import durable

# Words of a text whose A-Z are lower-cased, as bytes of UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
# Features whose bucket a task remembers; keys left that are simply sorted; and the share of its table that is written anew.
REMEMBERED, FEW, SHRUNK = 500_000, 10_000, 16
# A null doc_id's place in the order.
NO_ID = -(1 << 63)
KEY = ["loss", "doc_id", "row"]


class Buckets(dict):
    """The bucket of a feature, remembered for the features seen first."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def features(text: str, longest: int, known: Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    runs = list(words)
    for k in range(2, longest + 1):
        runs += [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))


def counted(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; at most ``buckets`` rows reach the driver."""
    common.text_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"].dropna():
                total += np.bincount(features(text, longest, known)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the documents, rounded down."""
    rest = len(raw)
    s_all, t_all = float(raw.sum() + rest), float(target.sum() + rest)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | str, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score. A null text has no words; a null doc_id is ``NO_ID`` and hashed as an empty one."""
    common.text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets(len(gain))
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                n, found = features(text or "", longest, known)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((key, n, len(found), weight, weight + noise("" if key == NO_ID else key, seed)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_features", "weight", "score"], dtype="int64")

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return narrow.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long, score long")


@dataclass
class Side:
    """Keys on one side of a pivot, as the partitions report them: how many, and their medians with weights."""

    n: int
    medians: list[tuple[tuple[int, ...], int]]

    def pivot(self) -> tuple[int, ...]:
        """The median of the medians, each as often as its partition has keys."""
        seen = 0
        for key, n in sorted(self.medians):
            seen += n
            if 2 * seen >= self.n:
                return key
        raise ValueError("no keys")


def median(keys: np.ndarray) -> tuple[int, ...]:
    """The lower median of keys (rows), compared column by column: each column narrows down to the rows that tie."""
    at, out = (len(keys) - 1) // 2, []
    for c in range(keys.shape[1]):
        column = keys[:, c]
        value = int(np.partition(column, at)[at])
        out.append(value)
        at -= int((column < value).sum())
        keys = keys[column == value]
    return tuple(out)


def compared(keys: np.ndarray, pivot: tuple[int, ...]) -> np.ndarray:
    """-1, 0 or 1 for each key that is less than, equal to or greater than ``pivot``."""
    out = np.zeros(len(keys), np.int8)
    for c, value in enumerate(pivot):
        open_ = out == 0
        column = keys[open_, c]
        out[open_] = (column > value).astype(np.int8) - (column < value)
    return out


def parted(keys: DataFrame, names: list[str], low: tuple | None, high: tuple | None, pivot: tuple | None) -> tuple[Side, int, Side]:
    """The keys between ``low`` and ``high`` on either side of ``pivot``, and how many equal it; without one all are on the right.

    A task holds the keys of its partition that are left, and one row of it comes to the driver.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            part = batch[names].to_numpy(np.int64)
            if low is not None:
                part = part[compared(part, low) > 0]
            if high is not None:
                part = part[compared(part, high) < 0]
            held.append(part)
        held = np.concatenate(held) if held else np.zeros((0, len(names)), np.int64)
        place = compared(held, pivot) if pivot is not None else np.ones(len(held), np.int8)
        sides = [held[place < 0], held[place > 0]]
        if len(held):
            yield pd.DataFrame({"equal": [int((place == 0).sum())], **{
                k: [v] for name, side in zip(("left", "right"), sides, strict=True)
                for k, v in ((name, len(side)), (f"{name}_median", list(median(side)) if len(side) else []))}})

    near = keys.select(*names)
    first = F.col(names[0])
    if low is not None:  # reaches the scan
        near = near.where(first >= low[0])
    if high is not None:
        near = near.where(first <= high[0])
    rows = near.mapInPandas(run, "equal long, left long, left_median array<long>, right long, right_median array<long>").collect()
    left, right = (Side(sum(r[s] for r in rows), [(tuple(r[s + "_median"]), r[s]) for r in rows if r[s]]) for s in ("left", "right"))
    return left, sum(r["equal"] for r in rows), right


def select(keys: DataFrame, names: list[str], place: int, few: int = FEW) -> tuple[int, ...]:
    """The key (columns ``names``, integers, compared in this order) at ``place``, from 1, of all rows in ascending order."""
    low = high = pivot = None
    written = None
    while True:
        left, equal, right = parted(keys, names, low, high, pivot)
        if pivot is None:
            written = right.n
            side = right
            if not 0 < place <= side.n:
                raise ValueError("no such place")
        elif place <= left.n:
            high, side = pivot, left
        elif place <= left.n + equal:
            return pivot
        else:
            place -= left.n + equal
            low, side = pivot, right
        if side.n <= few:
            return sorted(tuple(r) for r in between(keys, names, low, high).collect())[place - 1]
        if side.n * SHRUNK <= written:
            keys, written = durable(between(keys, names, low, high), "keys"), side.n
        pivot = side.pivot()


def ordered_before(names: list[str], key: tuple[int, ...], equal: bool = False) -> Column:
    """Is a row's key less than ``key`` (or equal to it)?"""
    out = F.lit(equal)
    for name, value in zip(reversed(names), reversed(key), strict=True):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def between(keys: DataFrame, names: list[str], low: tuple | None, high: tuple | None) -> DataFrame:
    keys = keys.select(*names)
    if low is not None:
        keys = keys.where(~ordered_before(names, low, equal=True))
    return keys.where(ordered_before(names, high)) if high is not None else keys


def ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 1, by their unique keys: ranges are sorted by themselves, and follow one another."""
    dealt = durable(rows.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*names)
    return dealt.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(starts), "_range").withColumn(
        "rank", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has a column text too.

    Of the documents with at least ``least_words`` words ``percent`` in a hundred are drawn, rounded down: the highest scores, ties
    to the smaller doc_id (null first); rows that repeat an id are drawn each by itself. ``rank`` is null for all others. A null text has no
    features, its weight is 0. Without documents or target texts all shares are equal or smoothed, and nothing fails.
    """
    gain = gains(counted(docs, longest, buckets), counted(target, longest, buckets))
    table = durable(scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "scores") \
        .withColumn("loss", -F.col("score"))
    enough = F.col("n_words") >= least_words
    places = table.where(enough).count() * percent // 100
    if places:
        wins = enough & ordered_before(KEY, select(table.where(enough), KEY, places), equal=True)
    else:
        wins = F.lit(False)
    drawn = ranked(table.where(wins), KEY)
    out = drawn.unionByName(table.where(~wins).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
