"""Writers: the outbox table, and publishers for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import durable, tables_freed

Publisher = Callable[[DataFrame, int], None]
#: Sends one rendered row: (publisher, message, url). What it raises is the row's error.
Sender = Callable[[str, str, str], None]


def write_outbox(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Outbox rows in one folder per publisher, rebalanced so that a busy publisher is written by many tasks."""
    rows.hint("rebalance", "pub").write.mode(mode).partitionBy("pub").parquet(path)


def outbox_publisher(path: str) -> Publisher:
    """Write each micro-batch under its own id, so a repeated batch replaces itself."""

    def publish(rows: DataFrame, batch_id: int) -> None:
        write_outbox(rows, f"{path}/batch={batch_id}", mode="overwrite")

    return publish


def sent(rows: DataFrame, send: Sender) -> DataFrame:
    """Rendered rows with ``error``: what ``send`` raised for a row, null if it went out. To be written down once, since each evaluation sends."""
    def attempt(pub: str, message: str, url: str) -> str | None:
        try:
            send(pub, message, url)
        except Exception as error:  # whatever a receiver raises concerns its own row
            return f"{type(error).__name__}: {error}"
        return None

    return rows.withColumn("error", F.udf(attempt, "string").asNondeterministic()("pub", "message", "url"))


def sending_publisher(path: str, send: Sender) -> Publisher:
    """Send each row of a micro-batch, and write the rows with what became of them under the batch's id.

    One failing row does not stop the others. The table of a batch appears as a whole when all its tasks are done; a task or batch that is repeated
    sends its rows again, so receivers should know a row by its key.
    """
    def publish(rows: DataFrame, batch_id: int) -> None:
        write_outbox(sent(rows, send), f"{path}/batch={batch_id}", mode="overwrite")

    return publish


def failed(spark: SparkSession, path: str) -> DataFrame:
    """The rows under ``path`` that a :func:`sending_publisher` could not send."""
    return spark.read.parquet(path).filter(F.col("error").isNotNull())


def counting_publisher(path: str, by: tuple[str, ...] = ("pub", "event")) -> Publisher:
    """Write each micro-batch to ``path/rows`` and its number of rows for each ``by`` to ``path/counts``, both under its id."""
    def publish(rows: DataFrame, batch_id: int) -> None:
        with tables_freed(rows.sparkSession):
            rows = durable(rows, "batch")
            write_outbox(rows, f"{path}/rows/batch={batch_id}", mode="overwrite")
            rows.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return publish


def counted(spark: SparkSession, path: str, by: tuple[str, ...] = ("pub", "event")) -> DataFrame:
    """The sums of what a :func:`counting_publisher` counted so far."""
    return spark.read.parquet(f"{path}/counts").groupBy(*by).agg(F.sum("n").alias("n"))


def log_publisher(rows: DataFrame, batch_id: int) -> None:
    """Print a micro-batch; for looking at a stream by hand."""
    rows.select("pub", "title", "link", "src", "published").show(truncate=80)
