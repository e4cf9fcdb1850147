"""Rule, source and publisher tables from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.render import agency_of
from tidewire.operators.dimensions import effective_cooldown, refuse_repeats

SCHEMAS = {
    "filters": "filter_id int, cond string, sources array<string>, pubs array<string>",
    "sources": "name string, categories array<string>, links array<string>, cooldown_seconds long, mute_begin int, mute_end int",
    "pubs": "name string, url_format string, template string",
}


def read_config(spark: SparkSession, folder: str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``filters``, ``sources`` and ``pubs`` from ``<folder>/<name>.json``; absent lists are empty.

    Items are joined to sources and publishers by name, and a name that stands twice multiplies them: ``strict`` refuses such tables, otherwise ``config_check`` reports it.
    """
    tables = {}
    for name, schema in SCHEMAS.items():
        df = spark.read.schema(schema).json(f"{folder}/{name}.json")
        for column, kind in df.dtypes:
            if kind == "array<string>":
                df = df.withColumn(column, F.coalesce(column, F.array().cast(kind)))
        tables[name] = df
    if strict:
        refuse_repeats(tables["pubs"], tables["sources"])
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("cooldown_seconds").cast("decimal(18,6)"))
    sources = tables["sources"].withColumn("cooldown", effective_cooldown(span)).drop("cooldown_seconds")
    return tables["filters"], sources.withColumn("agency", agency_of(F.col("name"))), tables["pubs"]
