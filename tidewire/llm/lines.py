"""Line dedup by how many sites a line is spread over.

A line's sites are sketched: one HyperLogLog per line hash, merged by the aggregation itself. Lines clearly
above the threshold are boilerplate, lines clearly below are not, and only for those near it are the
distinct sites counted exactly. A boilerplate line stays in one document, the first to have it, and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.plans.sizing import lookup_join
from tidewire.session import durable

# A line on so many sites is boilerplate. Every line with a word counts.
SITES = 3
# The owner among rows without a doc_id.
NO_ID = -(1 << 63)
# Size of a sketch, and how many standard errors around the threshold are counted exactly.
LOG_K = 10
MARGIN = 5


def line_key(line: Column) -> Column:
    """Lines are equal if they are equal without white space at the ends."""
    return F.xxhash64(trimmed(line))


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))


def has_word(line: Column) -> Column:
    return F.translate(line, " \t\x0b\x0c\r", "") != ""


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of lines (columns key, site, doc_id) on at least ``sites`` distinct sites, with ``owner``, the smallest doc_id.

    A null site is a site of its own. ``NO_ID`` owns a line only if no other doc_id has it.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit(""))
    sketched = durable(lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(site, F.lit(LOG_K))).alias("about"), F.min(F.nullif("doc_id", F.lit(NO_ID))).alias("owner")).where("about > 1"), "lines") \
        .withColumn("owner", F.coalesce("owner", F.lit(NO_ID)))
    error = MARGIN * 1.04 / 2 ** (LOG_K / 2)
    near = F.col("about").between(int(sites * (1 - error)) - 1, int(sites * (1 + error)) + 1)
    counted = lines.join(sketched.where(near).select("key"), "key", "left_semi").select("key", site.alias("site")).distinct() \
        .groupBy("key").agg(F.count("*").alias("n"))
    clear = sketched.where(~near & (F.col("about") >= sites)).select("key", "owner")
    return clear.unionByName(sketched.join(counted.where(F.col("n") >= sites), "key").select("key", "owner"))


def dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and how many as ``n_removed``.

    A line keeps its place in the smallest doc_id that has it, once. Documents without such lines, and null
    texts, stay as they are; a document all of whose lines go stays with an empty text. Rows without a doc_id own a line only if no
    other row has it; then each of them keeps it. Rows that repeat a doc_id lose the same lines. Other columns stay.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # rows without a doc_id are told apart by their texts, so that they don't become one group
    row = F.struct(key.alias("doc_id"), F.when(key == NO_ID, F.xxhash64("text")).otherwise(0).alias("text"))
    cut = docs.select(row.alias("row"), F.col("source").alias("site"), F.explode(F.filter(F.split("text", "\n"), has_word)).alias("line"))
    lines = durable(cut.select("row", "row.doc_id", "site", line_key(F.col("line")).alias("key")), "keys")
    gone = durable(boilerplate(lines, sites), "boilerplate")
    # each document's own boilerplate keys: those that it gives up, and those of which it keeps the first
    marks = lookup_join(lines.drop("site"), gone, "key").groupBy("row").agg(
        F.collect_set(F.when(F.col("owner") != F.col("doc_id"), F.col("key"))).alias("_gone"),
        F.collect_set(F.when(F.col("owner") == F.col("doc_id"), F.col("key"))).alias("_owned"))
    marked = docs.withColumn("_row", row).join(marks.withColumnRenamed("row", "_row").hint("merge"), "_row", "left").drop("_row")
    split = F.split("text", "\n")
    keys = F.transform(split, lambda x: F.when(has_word(x), line_key(x)))
    stays = F.filter(split, lambda x, i: F.coalesce(~(
        F.array_contains("_gone", F.get("_keys", i))
        | (F.array_contains("_owned", F.get("_keys", i)) & (F.array_position("_keys", F.get("_keys", i)) <= i))), F.lit(True)))
    hit = F.col("_gone").isNotNull()
    out = marked.withColumn("_keys", F.when(hit, keys)).withColumn("_stays", F.when(hit, stays))
    return out.withColumn("n_removed", F.when(hit, F.size(split) - F.size("_stays")).otherwise(0).cast("long")) \
        .withColumn("text", F.when(hit, F.array_join("_stays", "\n")).otherwise(F.col("text"))) \
        .drop("_gone", "_owned", "_keys", "_stays")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_removed."""
    return dedup(docs.select("doc_id", "source", "text")).select("doc_id", "text", "n_removed")
