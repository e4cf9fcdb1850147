"""A training corpus from ``documents``: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet to the shared folder
and read again as the next stage's docs. All stages but the last return the columns of
documents (doc_id, text, lang, source, n_chars); columns that documents may have besides are left out.

Mixing may take a document twice: its copies are equal rows, and packing gives each a place of its own. Null texts have no words, so the
quality rules reject them. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import common, lines, mixture, packing, quality, shingle_join
from tidewire.session import durable
from tidewire.sources.tables import once

TOKENIZER = "byte_bpe_50k.json"
# Near duplicates: shingles of five words, similar by four fifths or more.
NEAR_WORDS, NEAR_SIMILAR = 5, 80


def documents_of(docs: DataFrame) -> DataFrame:
    return docs.select(*common.DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees, trained on ``labels``, and the base rules keep."""
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return documents_of(quality.with_statistics(documents_of(docs), forest).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share; n_chars is that of the new text.

    A document that loses all its words goes: each of its lines stays in the document that owns it. Of whole copies on
    many sources one stays so. Documents that had no words before stay as they are.
    """
    cut = lines.dedup(documents_of(docs))
    # a filter on the cut text itself would be pushed down with the whole cut in it
    new = cut.select("doc_id", "lang", "source", "n_chars", once(F.struct("text", "n_removed")).alias("_new")).select("*", "_new.*")
    emptied = (F.col("n_removed") > 0) & (common.word_count("text") == 0)
    return documents_of(new.where(~emptied).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the group's smallest doc_id, null last.

    Of rows that repeat a doc_id, or have none, one stays too if they are in one group: the smallest by a hash of the row. Such rows
    get numbers of their own, for which all rows are written once more.
    """
    docs = documents_of(docs)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        rows = docs.withColumn("_row", F.col("doc_id"))
    else:
        rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = shingle_join.link(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_SIMILAR)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*common.DOCUMENT_COLUMNS), "_row").alias("_order")
    grouped = durable(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    grouped = grouped.union(grouped.select("_group", "_group").distinct())
    firsts = rows.select("_row", order).join(grouped.hint("merge"), "_row").groupBy("_group").agg(F.min("_order")["_row"].alias("_row"))
    others = grouped.select("_row").join(firsts.select("_row").hint("merge"), "_row", "left_anti")
    return rows.join(others.hint("merge"), "_row", "left_anti").select(*common.DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times."""
    taken = mixture.copies(documents_of(docs), common.word_count("text"))
    return documents_of(taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("best-fit packing", best_fit_packing),
]

# Trained trees and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
