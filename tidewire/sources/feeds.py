"""Feed documents (RSS, Atom) as item rows, with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.render import parse_feed_time
from tidewire.functions.text import is_blank
from tidewire.plans.sizing import lookup_join
from tidewire.sources.tables import once

# Only what an item keeps is in the schemas; descriptions are never read.
RSS = ("item", "title string, link string, category array<string>, pubDate string, `dc:date` string, _broken string")
ATOM = ("entry", "title string, link array<struct<_href: string, _rel: string>>, category array<struct<_term: string>>, "
        "published string, updated string, _broken string")


def _reader(source, kind: tuple[str, str]):
    tag, schema = kind
    return (
        source.format("xml").schema(schema).option("rowTag", tag).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken").option("ignoreCorruptFiles", "true")
        .option("recursiveFileLookup", "true")
    )


def _scanned(raw: DataFrame, kind: tuple[str, str]) -> DataFrame:
    """Every row of the feeds with its ``status``: item, rejected (its title is blank) or broken (it does not parse)."""
    # the reader refuses to be asked for the broken mark alone, so the row is pinned as a whole
    pinned = raw.select(once(F.struct(*raw.columns)).alias("_row"), F.col("_metadata.file_path").alias("file")).select("_row.*", "file")
    none = F.array().cast("array<string>")
    if kind is RSS:
        link, categories, time = F.col("link"), F.col("category"), F.coalesce(parse_feed_time(F.col("pubDate")), parse_feed_time(F.col("`dc:date`")))
    else:
        page = F.filter("link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
        link = F.try_element_at(page, F.lit(1))["_href"]
        categories = F.transform("category", lambda c: c["_term"])
        time = parse_feed_time(F.coalesce("published", "updated"))
    status = F.when(F.col("_broken").isNotNull(), "broken").when(is_blank("title"), "rejected").otherwise("item")
    return pinned.select(
        F.col("title"), link.alias("link"), F.coalesce(categories, none).alias("categories"), time.alias("published"),
        "file", status.alias("status"), F.col("_broken").alias("broken"),
    )


def _items(raw: DataFrame, kind: tuple[str, str]) -> DataFrame:
    """A feed row that does not parse gives no item and does not stop the others."""
    return _scanned(raw, kind).filter("status <> 'broken'").drop("status", "broken")


def scan_feeds(spark: SparkSession, paths: str | list[str], kind: tuple[str, str] = RSS) -> DataFrame:
    """All rows of the feeds, unfit ones included: items with ``file``, ``status`` and the text of a ``broken`` row.

    Written down once, it gives items, reject tables and :func:`receive_report` without another scan.
    """
    return _scanned(_reader(spark.read, kind).load(paths), kind)


def receive_report(scanned: DataFrame, link: Column | str = "file") -> DataFrame:
    """``(link, received, rejected, broken)``: rows that parsed, those of them without a title, and rows that did not parse, for each link."""
    link = F.col(link) if isinstance(link, str) else link
    return scanned.groupBy(link.alias("link")).agg(
        F.count_if(F.col("status") != "broken").alias("received"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "broken").alias("broken"))


def read_feeds(spark: SparkSession, paths: str | list[str], kind: tuple[str, str] = RSS) -> DataFrame:
    """``(title, link, categories, published, file)`` of all items under ``paths``."""
    return _items(_reader(spark.read, kind).load(paths), kind)


def stream_feeds(spark: SparkSession, path: str, kind: tuple[str, str] = RSS) -> DataFrame:
    return _items(_reader(spark.readStream, kind).load(path), kind)


def stream_scanned_feeds(spark: SparkSession, path: str, kind: tuple[str, str] = RSS) -> DataFrame:
    return _scanned(_reader(spark.readStream, kind).load(path), kind)


def _bare_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")


def of_sources(feed_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed rows of the links (files or folders) each source names, with ``src``.

    A row meets its source by an equi-join on its file or folder, as a full URI or as a bare
    path; files nobody names drop out.
    """
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    names = F.array_distinct(F.array("file", folder, _bare_path(F.col("file")), _bare_path(folder)))
    places = feed_rows.withColumn("_place", F.explode(names))
    links = sources.select(F.col("name").alias("src"), F.explode("links").alias("_link"))
    local = F.when(F.col("_link").startswith("file:"), _bare_path(F.col("_link"))).otherwise(F.col("_link"))
    return lookup_join(places, links.select("src", local.alias("_place")).distinct(), "_place").drop("_place", "file")


def write_rss(items: DataFrame, path: str, by: list[str]) -> None:
    """Items as RSS files in one folder per value of ``by``."""
    stamp = F.concat(F.date_format("published", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    rows = items.select(*by, "title", "link", F.col("categories").alias("category"), stamp.alias("pubDate"))
    # rebalanced, a folder gets few files and a hot one is still written by many tasks
    rows.hint("rebalance", *by).write.format("xml").option("rootTag", "channel").option("rowTag", "item").partitionBy(*by).save(path)
