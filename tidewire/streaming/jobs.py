"""Streaming jobs over the same column functions as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.dedup import dedup_first
from tidewire.operators.dimensions import refuse_repeats
from tidewire.operators.routing import category_prefilter, default_layout, matched_items, rendered, routes
from tidewire.session import durable, tables_freed, temporary_dir
from tidewire.sources.sinks import Publisher, outbox_publisher
from tidewire.sources.tables import document_stamps, document_titles
from tidewire.streaming.state import rocksdb

#: A deduplicator of micro-batches: (matched rows, batch id) to the rows to go on with.
BatchDeduplicator = Callable[[DataFrame, int], DataFrame]
REMEMBERED = timedelta(days=30)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of one table as a stream, be it a file or a folder; files added to a folder later are picked up."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # file streams read folders: this one is held to the file of this very name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def dedup_stream(items: DataFrame, within: timedelta = REMEMBERED, key: str = "key") -> DataFrame:
    """First of each key to arrive; a key is remembered for ``within`` of its arrival at least.

    What the rows say about their own time plays no part: rows without a time are sent once, and old rows are not late.
    """
    arrived = items.withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", f"{int(within.total_seconds())} seconds").dropDuplicatesWithinWatermark([key]).drop("_arrived")


class ArrivalMemory:
    """Remembers the keys of what went out, by arrival, in tables beside the stream's checkpoint.

    Each micro-batch writes its own part under its id, so a repeated batch replaces itself, and sees the parts of
    the batches before it that are younger than ``within``. A part holds a key and a time for each row that went out. Every ``every`` batches all
    that is still remembered is written as one base, and what it covers goes: as many folders are read after a year as after a day.
    """

    SCHEMA = "key string, arrived timestamp"

    def __init__(self, spark: SparkSession, path: str, within: timedelta = REMEMBERED, every: int = 32):
        self.path, self.within, self.every = path.rstrip("/"), within, every
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.system = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.system.mkdirs(self.hadoop.Path(self.path))

    def parts(self, kind: str) -> dict[int, str]:
        """The finished folders of a kind by batch id."""
        found = {}
        for status in self.system.listStatus(self.hadoop.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith(kind + "=") and self.system.exists(self.hadoop.Path(status.getPath(), "_SUCCESS")):
                found[int(name.split("=")[1])] = f"{self.path}/{name}"
        return found

    def known(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What the batches before ``batch_id`` sent, as far as it is remembered."""
        bases = {b: p for b, p in self.parts("base").items() if b <= batch_id}
        base = max(bases, default=-1)
        paths = [bases[base]] if bases else []
        paths += [p for b, p in sorted(self.parts("batch").items()) if base <= b < batch_id]
        if not paths:
            return spark.createDataFrame([], self.SCHEMA)
        return spark.read.schema(self.SCHEMA).parquet(*paths).filter(F.col("arrived") >= F.current_timestamp() - F.lit(self.within))

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        if batch_id % self.every or batch_id in self.parts("base"):
            return
        self.known(spark, batch_id).coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
        # no batch before this one is repeated any more
        for kind in ("base", "batch"):
            for old, path in self.parts(kind).items():
                if old < batch_id:
                    self.system.delete(self.hadoop.Path(path), True)

    def __call__(self, found: DataFrame, batch_id: int) -> DataFrame:
        spark = found.sparkSession
        self.compact(spark, batch_id)
        fresh = durable(dedup_first(found).join(self.known(spark, batch_id).select("key"), "key", "left_anti"), "fresh")
        fresh.select("key", F.current_timestamp().alias("arrived")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return fresh


def start_route(items: DataFrame, filters: DataFrame, pubs: DataFrame, publish: Publisher | str, checkpoint: str,
                within: timedelta = REMEMBERED, sources: DataFrame | None = None, scoped: bool = False,
                dedup: BatchDeduplicator | None = None, layout: Callable[[], Column] = default_layout, **trigger) -> StreamingQuery:
    """Route a stream of items to ``publish``: a path for an outbox by micro-batch and publisher, or a batch function.

    Each micro-batch takes the way of the batch operators, whatever the number of rules: sources, match, dedup,
    publishers, message and link. A source or publisher that is named twice is refused. ``dedup`` defaults to an :class:`ArrivalMemory` beside the checkpoint. Rows come with
    all item columns, ``key``, ``pub``, ``message`` and ``url``.
    """
    spark = items.sparkSession
    refuse_repeats(pubs, sources)
    dedup = dedup or ArrivalMemory(spark, f"{checkpoint.rstrip('/')}-keys", within)
    publish = outbox_publisher(publish) if isinstance(publish, str) else publish

    def route(batch: DataFrame, batch_id: int) -> None:
        with tables_freed(spark):
            rows = durable(batch, "batch")
            if sources is not None:
                rows = category_prefilter(rows, sources)
            fresh = dedup(matched_items(rows, filters, scoped), batch_id)
            publish(rendered(routes(fresh, filters, pubs), pubs, layout), batch_id)

    writer = items.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def start_deliveries(rows: DataFrame, publish: Publisher, checkpoint: str, **trigger) -> StreamingQuery:
    """Hand the micro-batches of a stream of rows to ``publish``."""
    with rocksdb(rows.sparkSession):
        writer = rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def arriving(rows: DataFrame, ts: str, path: str, late: timedelta, parts: int = 3) -> Iterator[DataFrame]:
    """``rows`` as a stream that grows by ``parts`` deliveries of files, about in order of ``ts``: each row comes up to ``late`` after its time.

    Gives the stream after each delivery, to be run on from one checkpoint. A last delivery is one row of nulls but for a
    time well after all others, so that everything before it can be settled.
    """
    spark = rows.sparkSession
    at, wait = F.unix_micros(F.col(ts).cast("timestamp")), int(late.total_seconds() * 1e6)
    first, last = rows.select(at.alias("at")).agg(F.min("at"), F.max("at")).first()
    first, last = first or 0, last or 0
    came = F.coalesce(at, F.lit(first)) - first + F.pmod(F.xxhash64(*rows.columns), F.lit(wait))
    numbered = durable(rows.withColumn("_part", F.floor(came * parts / (last - first + wait + 1)).cast("int")), "arriving")
    end = F.timestamp_micros(F.lit(last + 2 * wait + 7_200_000_000)).cast(rows.schema[ts].dataType)
    nulls = [end.alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    deliveries = [numbered.filter(F.col("_part") == part).drop("_part") for part in range(parts)]
    for delivery in [*deliveries, spark.range(1).select(*nulls)]:
        delivery.write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


def drain(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over all input there is into a table under ``path`` (or the shared folder), and read that back.

    The table is ``path/table``, the checkpoint ``path/log``, from which a second call goes on.
    """
    spark = rows.sparkSession
    path = path or temporary_dir(spark, name)
    with rocksdb(spark):
        query = (
            rows.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/log")
            .outputMode("append").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


def document_item_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as a stream of items, category and time looked up in ``events``."""
    return document_titles(stream_table(spark, folder, "documents")).join(document_stamps(spark, folder), "item_id")
