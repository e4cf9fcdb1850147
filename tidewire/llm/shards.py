"""Sharding by proportional stratified interleaving, with built-in functions only.

Rows of a source are put in a seeded random order; a row's rank, as a fraction of its source, is its place in
the corpus. Sorted by that fraction, every stretch of the corpus has the mixture of the whole, and
the sorted rows are cut into shards of equal counts. Two ranks are needed, within a source and in the
corpus. Neither is taken in one task: rows are counted in cells, the cells' counts are summed up, and each
cell ranks its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common
from tidewire.session import durable

SHARDS = 16
SEED = "shards"


def assign(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard) to rows with doc_id and source.

    Counts of shards differ by one at most. Null sources are one source; rows that repeat a doc_id are
    told apart by their other columns, and equal rows are interchangeable. ``rows`` is read several times: give a
    table of narrow rows. Row order is a hash of the seed, the doc_id and the other columns, so reruns agree.
    """
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    drawn = rows.withColumn("_draw", common.digest(*[F.col(c).cast("string") for c in columns], seed=seed))
    counts = drawn.groupBy("source").agg(F.count("*").alias("_rows")).select(F.col("source").alias("_source"), "_rows")
    counted = drawn.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wide = F.greatest(F.lit(1.0), F.least(F.sqrt("_rows"), F.col("_rows") / 128))
    celled = counted.withColumn("_cell", F.floor(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") / F.lit(1 << 32) * wide))
    ranked = common.running(celled, ["source"], ["_cell"], [F.col("_draw")], F.lit(1), "_rank").drop("_cell")
    fraction = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_rows")))
    total = rows.count()
    spread = fraction.withColumn("_total", F.lit(total)).withColumn("_all", F.lit(0))
    stretched = spread.withColumn("_stretch", F.floor(F.col("_fraction") * common.cells(total)))
    placed = common.running(stretched, ["_all"], ["_stretch"], [F.col("_fraction"), F.col("source"), F.col("_draw")], F.lit(1), "_place")
    shard = F.expr(f"_place * {shards} div _total")
    start = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_place") - start).select(*columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is ``rows``: counts at most one apart.

    The method knows no groups: copies of a text go where their draws put them. A null text counts as no bytes.
    """
    narrow = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return assign(durable(narrow, "sizes"), shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
