"""Sources, filters and publishers against each other: affix joins and their reports.

``sources(name, categories, links, cooldown, ...)``, ``filters(filter_id, cond, sources, pubs)``,
``pubs(name, url_format, template)``. Names match globs by an equi-join on their prefixes and
suffixes, so no pair that does not match is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.affix import affixes, glob_keys
from tidewire.functions.text import is_blank
from tidewire.plans.rules import rule_terms
from tidewire.plans.sizing import lookup_join

# Fixed value: the cooldown of a source that names none.
DEFAULT_COOLDOWN = "INTERVAL '15' MINUTE"


def _name_keys(names: DataFrame) -> DataFrame:
    return names.select("name", F.explode(affixes(F.col("name"))).alias("_glob"))


def _glob_keys(filters: DataFrame, globs: str) -> DataFrame:
    return filters.select("filter_id", F.explode(glob_keys(F.col(globs))).alias("_glob"))


def affix_pairs(names: DataFrame, filters: DataFrame, globs: str) -> DataFrame:
    """Distinct ``(name, filter_id)`` with the name matching the filter's globs."""
    # "match everything" is one hot key here
    return lookup_join(_name_keys(names), _glob_keys(filters, globs), "_glob").select("name", "filter_id").distinct()


def _named(names: DataFrame, filters: DataFrame, globs: str) -> DataFrame:
    used = _glob_keys(filters, globs).select("_glob").distinct()
    return _name_keys(names).join(used, "_glob", "left_semi").select("name").distinct()


def active_sources(sources: DataFrame, filters: DataFrame) -> DataFrame:
    """Sources at least one filter names."""
    return sources.join(_named(sources, filters, "sources"), "name", "left_semi")


def orphan_sources(sources: DataFrame, filters: DataFrame) -> DataFrame:
    return sources.join(_named(sources, filters, "sources"), "name", "left_anti")


def orphan_pubs(pubs: DataFrame, filters: DataFrame) -> DataFrame:
    return pubs.join(_named(pubs, filters, "pubs"), "name", "left_anti")


def filter_pubs(pubs: DataFrame, filters: DataFrame) -> DataFrame:
    """``(filter_id, pub)``: the publishers each filter resolves to."""
    return affix_pairs(pubs, filters, "pubs").select("filter_id", F.col("name").alias("pub"))


def effective_cooldown(cooldown: Column) -> Column:
    default = F.expr(DEFAULT_COOLDOWN)
    return F.when(cooldown.isNull() | (cooldown == F.expr("INTERVAL '0' SECOND")), default).otherwise(cooldown)


def refuse_repeats(pubs: DataFrame, sources: DataFrame | None = None) -> None:
    """Raise if a name stands twice in a table that items are joined to by name."""
    for kind, table_ in (("publisher", pubs), ("source", sources)):
        names = [] if table_ is None else [r["name"] for r in table_.groupBy("name").count().where("count > 1").orderBy("name").limit(5).collect()]
        if names:
            raise ValueError(f"repeated {kind} names: {', '.join(map(str, names))}")


def config_check(sources: DataFrame, filters: DataFrame, pubs: DataFrame) -> DataFrame:
    """What is wrong with the tables, as ``(table, name, problem)``."""

    def rows(df: DataFrame, name: str, problem: str, key: Column | str = "name") -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        return df.select(F.lit(name).alias("table"), key.cast("string").alias("name"), F.lit(problem).alias("problem"))

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy("name").agg(F.count("*").alias("_n")).filter("_n > 1")

    def none_left(df: DataFrame, name: str, problem: str) -> DataFrame:
        return rows(df.agg(F.count("*").alias("_n")).filter("_n = 0"), name, problem, F.lit(""))

    reports = [
        rows(repeated(sources), "sources", "duplicate"),
        rows(repeated(pubs), "pubs", "duplicate"),
        rows(sources.filter(is_blank("name")), "sources", "name required"),
        rows(sources.filter(F.coalesce(F.size("links"), F.lit(0)) <= 0), "sources", "no links"),
        rows(orphan_sources(sources, filters), "sources", "no filter"),
        rows(orphan_pubs(pubs, filters), "pubs", "no filter"),
        none_left(filters, "filters", "no filters"),
        none_left(active_sources(sources, filters), "sources", "no sources"),
        none_left(_named(pubs, filters, "pubs"), "pubs", "no publishers"),
        rows(filters.join(rule_terms(filters).select("filter_id").distinct(), "filter_id", "left_anti"),
             "filters", "never matches", "filter_id"),
    ]
    found = reports[0]
    for report in reports[1:]:
        found = found.unionByName(report)
    return found
