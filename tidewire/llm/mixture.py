"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Each document has an expected number of copies. Within its source, documents are put in an order,
their expected copies are prefix-summed, one random offset per source is added, and a document is
emitted once for each integer boundary its interval crosses. So the number of copies of any stretch of the order
is within one of what is expected; the order goes by size class first, which keeps the words taken near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import common
from tidewire.session import durable

# Weights repeat over the sources in order; the mix holds this share of all words; no source is
# taken more often than this.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mixture"
# Expected copies are whole numbers of this unit, so that prefix sums are exact in any order.
UNIT = 1 << 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table with one row per source (``source``, ``source_size``).

    Sources by code point, null last, get the weights in turn; the total is ``share`` of all sizes. A source stops
    at ``most`` times its size and its excess goes to the others by weight. That is one level for all: target =
    min(most * size, weight * level). With sources in order of the level at which they stop, the first that
    doesn't stop fixes it. Works on one row per source, in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    ordered = sizes.select(
        "*", (F.row_number().over(order) - 1).alias("_at"), F.sum("source_size").over(every).alias("_all"),
        (F.col("source_size") * most).alias("_stop"))
    weighted = ordered.withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")).cast("long"))
    stops = Window.orderBy(F.col("_stop") / F.col("_weight"), "_at")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    stepped = weighted.select(
        "*", F.row_number().over(stops).alias("_turn"),
        ((F.col("_all") * share - F.coalesce(F.sum("_stop").over(before), F.lit(0)))
         / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))).alias("_level"))
    holds = F.when(F.col("_level") * F.col("_weight") <= F.col("_stop"), F.struct("_turn", "_level"))
    final = stepped.withColumn("_final", F.min(holds).over(every)["_level"])
    stop = F.col("_stop").cast("double")
    return final.select("source", "source_size", F.coalesce(F.least(stop, F.col("_weight") * F.col("_final")), stop).alias("target"))


def size_class(size: Column) -> Column:
    """Twice the binary logarithm of the size, as a whole number: 0 for no words."""
    return F.floor(2 * F.log2(size + 1)).cast("int")


def copies(docs: DataFrame, size: Column, seed: str = SEED, **shares) -> DataFrame:
    """Add size, source_size, target and copies (0 to ``MOST``) to documents (doc_id, source, text).

    Null sources are one source. Documents without words have expectations like others and take nothing. Equal
    rows are interchangeable. Reruns agree: everything random is a hash. Columns of the added names are replaced.
    """
    sized = docs.withColumn("_size", size).drop("size", "source_size", "target", "copies").withColumnRenamed("_size", "size")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    wanted = targets(sizes.drop("_rows"), **shares).join(
        sizes.select(F.col("source").alias("_source"), "_rows"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rates = wanted.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
        .cast("long").alias("_rate"),
        F.sqrt("_rows").alias("_width"))
    offset = F.conv(F.substring(common.digest("_source", seed=seed), 1, 6), 16, 10).cast("long") % UNIT
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_offset", offset).drop("_source")
    mixed = rated.select(
        "*", size_class(F.col("size")).alias("_class"),
        common.digest(F.col("doc_id").cast("string"), F.col("size").cast("string"), seed=seed).alias("_draw"))
    # cells of about the square root of a source's rows
    slot = F.floor(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") / F.lit(1 << 32) * F.greatest(
        F.lit(1.0), F.least(F.col("_width"), F.pow("_width", 2) / 128))).cast("long")
    summed = common.running(mixed.withColumn("_slot", slot), ["source"], ["_class", "_slot"], [F.col("size"), F.col("_draw")],
                            F.col("_rate"), "_before")
    start = F.col("_offset") + F.col("_before")
    crossed = F.shiftright(start + F.col("_rate"), 24) - F.shiftright(start, 24)
    return summed.withColumn("copies", crossed).drop(
        "_rate", "_width", "_offset", "_class", "_draw", "_slot", "_before")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size (words), source_size, target, taken: the words the mix takes of each document.

    A null text has size 0. ``docs`` may have any further columns.
    """
    sized = durable(docs.select("doc_id", "source", common.word_count("text").alias("words")), "sizes")
    return copies(sized, F.col("words"), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
