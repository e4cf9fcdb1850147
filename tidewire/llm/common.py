"""What several operators share: table access, words, distributed ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Stands for a null id where a column must not have nulls: pandas would turn its numbers into doubles.
NO_ID = -(1 << 63)
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def without_null(name: str) -> Column:
    """An id column with ``NO_ID`` for null, under its name; :func:`with_null` turns it back."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def with_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def shown_document(url: Column | str) -> Column:
    """The number that ends a url's path, which is the document that the page shows; null if there is none."""
    found = F.regexp_extract(url, r"://[^/?#]*[^?#]*?/([0-9]{1,18})(?:[.][a-z]+)?/?(?:[?#].*)?$", 1)
    return F.nullif(found, F.lit("")).cast("long")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: whole texts are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(texts: list, most: int = 2_000_000):
    """Ranges of ``texts`` of at most ``most`` characters each, or of one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_count(text: Column | str) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(*parts: Column | str, seed: str) -> Column:
    """A seeded, portable hash that orders rows at random: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]))


def running(df: DataFrame, group: list[str], cell: list[str], order: list[Column], amount: Column,
            name: str = "before") -> DataFrame:
    """Add the sum of ``amount`` over the rows that come earlier in the group: an exclusive prefix sum.

    Rows are ordered by the ``cell`` columns, then by ``order``. Cells split a group that is too large for
    one task: their sums are prefix-summed first (one row per cell), then each cell is summed by itself.
    ``amount`` must be an integer, so that the result doesn't depend on the order of execution. Null
    groups are groups. Choose cells so that none holds more than a task can.
    """
    # a struct with null fields equals itself, and the join finds rows where the window has dealt them
    rows = df.withColumn("_amount", amount.cast("long")).withColumn("_key", F.struct(*group, *cell))
    totals = rows.groupBy("_key").agg(F.sum("_amount").alias("_total"))
    along = Window.partitionBy(*[F.col("_key")[g] for g in group]).orderBy(*[F.col("_key")[c] for c in cell])
    starts = totals.select("_key", (F.sum("_total").over(along) - F.col("_total")).alias("_start"))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_inside", F.sum("_amount").over(inside) - F.col("_amount"))
    return summed.join(starts, "_key").withColumn(name, F.col("_start") + F.col("_inside")).drop("_key", "_amount", "_inside", "_start")


def cells(rows: int, least: int = 128) -> int:
    """How many cells to split a group of ``rows`` into: about as many as each has rows."""
    return max(1, -(-rows // max(least, math.isqrt(rows))))
