"""Rule, source and publisher tables used by the registered queries.

The *desk* rules are a handful of fixed conditions for the titles of ``documents``. The *watch*
rules are derived from data: every ``benchmark`` text becomes a condition (sentences are
alternatives, commas all-of, words consecutive patterns), its publishers are suppliers. They
grow with the tables.
"""

from __future__ import annotations

from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.dimensions import effective_cooldown
from tidewire.sources.tables import table

# The desk rules, publishers and source settings.
DESK_RULES = [
    (1, "the & of; and *tion$", ["en"], ["main"]),
    (2, "der & und; Keit", ["de"], ["main", "info"]),
    (3, "de la; *ción & los", ["es"], ["info"]),
    (4, "pour & par$", ["fr.src1"], []),
    (5, "th(at|is)$", ["en", "de"], ["ops"]),
]
DESK_PUBS = ["main", "info", "ops", "archive"]
URL_FORMAT = "http://example.org/send?text=%s"
COOLDOWN = timedelta(hours=6)
MUTE = (20, 5)

_STRINGS = pa.list_(pa.string())


def desk_filters(spark: SparkSession) -> DataFrame:
    ids, conds, sources, pubs = zip(*DESK_RULES)
    return spark.createDataFrame(pa.table({
        "filter_id": pa.array(ids, pa.int32()), "cond": pa.array(conds),
        "sources": pa.array(sources, _STRINGS), "pubs": pa.array(pubs, _STRINGS),
    }))


def desk_pubs(spark: SparkSession) -> DataFrame:
    names = pa.array(DESK_PUBS)
    return spark.createDataFrame(pa.table({
        "name": names, "url_format": pa.array([URL_FORMAT] * len(names)), "template": pa.array([""] * len(names)),
    }))


def document_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per language and source name of ``documents``; two categories by language."""
    names = table(spark, folder, "documents").select("lang", "source").distinct()
    return names.select(
        F.concat_ws(".", "lang", "source").alias("name"),
        F.when(F.col("lang") == "en", F.array(F.lit("click"), F.lit("up")))
        .when(F.col("lang") == "de", F.array(F.lit("err"))).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.array(F.concat_ws("/", F.lit("feeds"), "lang", "source")).alias("links"),
        F.lit(COOLDOWN).alias("cooldown"),
        F.lit(MUTE[0]).alias("mute_begin"),
        F.lit(MUTE[1]).alias("mute_end"),
    )


def pull_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The sources with settings of their own: every third has the default cooldown, every other one is muted at night."""
    number = F.regexp_extract("name", r"([0-9]+)$", 1).cast("int")
    hours = F.when(number % 3 == 1, F.expr("INTERVAL '6' HOUR")).when(number % 3 == 2, F.expr("INTERVAL '36' HOUR"))
    return document_sources(spark, folder).select(
        "name", effective_cooldown(hours).alias("cooldown"),
        F.when(number % 2 == 0, MUTE[0]).alias("mute_begin"), F.when(number % 2 == 0, MUTE[1]).alias("mute_end"))


def spoiled_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The watch rules, some with a faulty pattern, a repeated part or no condition."""
    third = F.col("filter_id") % 5
    spoiled = F.when(third == 0, F.concat("cond", F.lit("; ends$$ here"))).when(third == 1, F.concat("cond", F.lit("; a & b\\(; a"))) \
        .when(third == 2, F.lit(None).cast("string")).when(third == 3, F.concat("cond", F.lit("; x y & x y; x")))
    return watch_filters(spark, folder).withColumn("cond", F.when(third == 4, F.col("cond")).otherwise(spoiled))


def widened_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The watch rules, each with alternatives made of its first two words: their beginnings, the inside of one, and one as a whole."""
    first, second = (F.regexp_extract("cond", r"^(\p{L}+) (\p{L}+)", n) for n in (1, 2))
    wider = F.concat("cond", F.lit("; "), F.left(first, F.lit(2)), F.lit(" "), F.left(second, F.lit(2)), F.lit("; *"), F.substring(first, 2, 100),
                     F.lit("; "), first, F.lit("$ & "), first)
    return watch_filters(spark, folder).withColumn("cond", F.when(first != "", wider).otherwise(F.col("cond")))


def watch_filters(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "benchmark")
    cond = F.translate(F.translate("text", ".\n", ";;"), ",", "&")
    number = F.col("item_id").cast("string")
    digits = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return texts.select(
        F.col("item_id").cast("int").alias("filter_id"),
        cond.alias("cond"),
        F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))).alias("sources"),
        F.array(digits, F.concat(F.lit("Supplier#00000"), F.reverse(digits))).alias("pubs"),
    )


def supplier_pubs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"),
        F.lit(URL_FORMAT).alias("url_format"),
        F.lit("").alias("template"),
    )
