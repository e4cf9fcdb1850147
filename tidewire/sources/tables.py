"""Item views over tables, and how an item is made ready for matching.

Item schema: ``item_id, src, title, link, categories array<string>, published`` (nullable). An item may
also have a ``text``: that is matched and deduplicated then, in place of the title, which is what is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import dedup_key, is_blank, token_line

# Fixed value: where the links of table items point.
LINK_BASE = "http://example.org/doc/"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, by: str) -> DataFrame:
    """Use all cores on an input of a few large row groups; an input with splits enough stays as it is.

    ``by`` is a column without hot values, an id.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores, by)


def once(column: Column) -> Column:
    """Pin a costly column to one evaluation per row.

    Catalyst copies a column's expression into every filter it pushes down; it does not copy
    through a generator, so a one-element explode keeps the column computed once. Use it alone
    in a ``select`` next to plain columns.
    """
    return F.explode(F.array(column))


def first_line(text: Column | str) -> Column:
    return F.substring_index(text, "\n", 1)


def document_titles(documents: DataFrame) -> DataFrame:
    """Documents as items: the whole text counts, its first line is what is shown, as a headline is."""
    return documents.select(
        F.col("doc_id").alias("item_id"),
        F.concat_ws(".", "lang", "source").alias("src"),
        first_line("text").alias("title"),
        "text",
        F.concat(F.lit(LINK_BASE), F.col("doc_id").cast("string")).alias("link"),
    )


def document_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Category and time of each document, from its row in ``events``."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("item_id"),
        F.array("event_type").alias("categories"),
        F.col("ts").alias("published"),
    )


def titled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(document_titles(table(spark, folder, "documents")), "item_id")


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as whole items."""
    return titled_documents(spark, folder).join(document_stamps(spark, folder), "item_id")


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` titled by their title tag; no categories, no time."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("item_id"),
        F.lit("web.pages").alias("src"),
        F.regexp_extract("html", TITLE_TAG, 1).alias("title"),
        F.col("url").alias("link"),
        F.array().cast("array<string>").alias("categories"),
        F.lit(None).cast("timestamp_ntz").alias("published"),
    )


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every document as a headline of its own, blank ones included."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("part", "title"))


def pulls(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a log of requests: who, when."""
    return table(spark, folder, "events").select("user_id", "ts", F.col("event_id").alias("id"))


def valid_items(items: DataFrame) -> DataFrame:
    """Items need a title."""
    return items.filter(~is_blank("title"))


def rejected_items(items: DataFrame) -> DataFrame:
    return items.filter(is_blank("title"))


def prepared(items: DataFrame) -> DataFrame:
    """Valid items with the token line of their text (or else title), computed once."""
    body = "text" if "text" in items.columns else "title"
    return valid_items(items).select(*[c for c in items.columns if c != "text"], once(token_line(body)).alias("line"))


def with_key(items: DataFrame) -> DataFrame:
    """The dedup key in place of the token line, which may be long."""
    return items.withColumn("key", dedup_key(F.col("line"))).drop("line")
