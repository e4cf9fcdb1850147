"""From items to (item, publisher) rows, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.affix import any_affix_match, glob_keys, affixes
from tidewire.functions.render import build_url, item_slots, render_each
from tidewire.operators.dedup import dedup_first
from tidewire.operators.dimensions import filter_pubs
from tidewire.operators.matching import match_by_columns, match_by_vocabulary, match_column, match_rows, numbered_rows
from tidewire.plans.rules import Rule, compile_rules
from tidewire.plans.sizing import lookup_join
from tidewire.session import durable
from tidewire.sources.tables import once, prepared, with_key

# Fixed value: slots of a publisher's channel.
CHANNEL_SLOTS = 1024
CAP_SALTS = 32
MAX_PLAN_PAIRS = 1_000

Deduplicator = Callable[[DataFrame], DataFrame]


def item_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with the columns of their source; items of unknown sources are left out."""
    return lookup_join(items, sources.withColumnRenamed("name", "src"), "src")


def unknown_source_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    return lookup_join(items, sources.select(F.col("name").alias("src")), "src", "left_anti")


def category_prefilter(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of which some category matches some category of their source; empty lists pass."""
    wanted = sources.select(F.col("name").alias("src"), F.col("categories").alias("_wanted"))
    joined = lookup_join(items, wanted, "src")
    return joined.filter(any_affix_match(F.col("categories"), F.col("_wanted"))).drop("_wanted")


def from_active_sources(items: DataFrame, filters: DataFrame, rules: list[Rule] | None) -> DataFrame:
    """Items whose source at least one filter names.

    With few rules that is a predicate on the source name, which reaches the scan; otherwise a
    semi-join on the affixes of the distinct source names.
    """
    if rules is not None:
        return items.filter(reduce(lambda a, b: a | b, [r.covers(F.col("src")) for r in rules], F.lit(False)))
    globs = filters.select(F.explode(glob_keys(F.col("sources"))).alias("_glob")).distinct()
    names = items.select("src").distinct()
    known = lookup_join(names.select("src", F.explode(affixes(F.col("src"))).alias("_glob")), globs, "_glob", "left_semi")
    return lookup_join(items, known.select("src").distinct(), "src", "left_semi")


def scoped_pairs(items: DataFrame, filters: DataFrame) -> DataFrame:
    """``(src, filter_id)`` for the documented meaning: a filter only sees the sources it names."""
    names = items.select("src").distinct().select("src", F.explode(affixes(F.col("src"))).alias("_glob"))
    globs = filters.select("filter_id", F.explode(glob_keys(F.col("sources"))).alias("_glob"))
    # "" is one hot key here
    return lookup_join(names, globs, "_glob").select("src", "filter_id").distinct()


def item_matches(items: DataFrame, filters: DataFrame, scoped: bool = False, by_vocabulary: bool | None = None,
                 rules: list[Rule] | None = None) -> DataFrame:
    """``(item_id, filter_id)`` over items with a token line, by columns when the rules are few.

    ``by_vocabulary`` asks for one of the two ways; they give the same rows, one for each row of ``items`` and satisfied
    filter, and too many rules for columns go through the vocabulary in any case.
    """
    if rules is None and not by_vocabulary:
        rules = compile_rules(filters)
    if rules is not None and not by_vocabulary:
        return match_by_columns(items, rules, scoped).select("item_id", "filter_id")
    if not scoped:
        return match_by_vocabulary(items, filters)
    rows = numbered_rows(items.select("item_id", "src", "line"))
    return scoped_matches(rows, filters).join(rows.select("_row", "item_id"), "_row").select("item_id", "filter_id")


def scoped_matches(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """``(_row, filter_id)`` of rows with ``src``, each filter by the sources it names."""
    placed = match_rows(rows, filters).join(rows.select("_row", "src"), "_row")
    return lookup_join(placed, scoped_pairs(rows, filters), ["src", "filter_id"], "left_semi").select("_row", "filter_id")


def active_item_matches(items: DataFrame, filters: DataFrame, scoped: bool = False, by_vocabulary: bool | None = None) -> DataFrame:
    """:func:`item_matches` over raw items, of active sources only."""
    rules = compile_rules(filters)
    active = prepared(from_active_sources(items, filters, rules))
    return item_matches(active, filters, scoped, by_vocabulary, rules)


def matched_items(items: DataFrame, filters: DataFrame, scoped: bool = False, by_vocabulary: bool | None = None) -> DataFrame:
    """Items of active sources with at least one satisfied filter: ``filter_ids`` the satisfied ones, and their dedup ``key``.

    Rows that repeat an id each get their own filters.
    """
    rules = compile_rules(filters)
    items = prepared(from_active_sources(items, filters, rules))
    if rules is not None and not by_vocabulary:
        found = items.select("*", once(match_column(rules, scoped)).alias("filter_ids"))
        return with_key(found.filter(F.size("filter_ids") > 0))
    rows = numbered_rows(items)
    found = scoped_matches(rows, filters) if scoped else match_rows(rows, filters)
    sets = found.groupBy("_row").agg(F.array_sort(F.collect_set("filter_id")).alias("filter_ids"))
    return with_key(rows).join(sets, "_row").drop("_row")


def survivors(items: DataFrame, filters: DataFrame, scoped: bool = False, details: DataFrame | None = None,
              sources: DataFrame | None = None, dedup: Deduplicator = dedup_first, by_vocabulary: bool | None = None) -> DataFrame:
    """Matched items that ``dedup`` leaves; only matched items count as seen.

    ``sources`` lets in only items of known sources, and of those the ones that pass their
    source's categories. ``details`` holds more item columns by ``item_id``, such as
    ``published``. They are joined to the matches only, so unmatched texts never cross the network.
    """
    if sources is not None:
        items = category_prefilter(items, sources)
    found = matched_items(items, filters, scoped, by_vocabulary)
    if details is not None:
        found = found.join(details, "item_id")
    return dedup(found)


def routes(kept: DataFrame, filters: DataFrame, pubs: DataFrame) -> DataFrame:
    """Survivors to one row per item and publisher, the union over the satisfied filters.

    While the resolved publishers are few they go into the plan as a map and no shuffle is
    needed; otherwise rows meet publishers by the filters that name both, and nothing is compared across rows. Rows that repeat an item stay rows.
    """
    pairs = filter_pubs(pubs, filters)
    few = pairs.limit(MAX_PLAN_PAIRS + 1).collect()
    if len(few) <= MAX_PLAN_PAIRS:
        resolved: dict[int, list[str]] = {}
        for pair in few:
            resolved.setdefault(pair.filter_id, []).append(pair.pub)
        if not resolved:
            return kept.filter(F.lit(False)).withColumn("pub", F.lit("")).drop("filter_ids")
        id_type = filters.schema["filter_id"].dataType
        by_filter = F.create_map(*[c for f, names in resolved.items() for c in (F.lit(f).cast(id_type), F.array(*map(F.lit, sorted(names))))])
        none = F.array().cast("array<string>")
        union = F.array_distinct(F.flatten(F.transform("filter_ids", lambda f: F.coalesce(F.try_element_at(by_filter, f), none))))
        return kept.select("*", F.explode(union).alias("pub")).drop("filter_ids")
    # publishers that the same filters name are one class, so a row's publishers are whole classes, each given by the first of its filters that the row satisfies
    named = pairs.groupBy("pub").agg(F.array_sort(F.collect_set("filter_id")).alias("_named"))
    named = durable(named, "named")
    classes = durable(named.select("_named").distinct().withColumn("_class", F.monotonically_increasing_id()), "classes")
    members = named.join(classes, "_named").select("_class", "pub")
    by_filter = classes.select(F.explode("_named").alias("_filter"), "_named", "_class")
    each = lookup_join(kept.select("*", F.explode("filter_ids").alias("_filter")), by_filter, "_filter")
    given = each.filter(F.col("_filter") == F.array_min(F.array_intersect("_named", "filter_ids"))).drop("_filter", "_named", "filter_ids")
    return lookup_join(given, members, "_class").drop("_class")


def route_items(items: DataFrame, filters: DataFrame, pubs: DataFrame, scoped: bool = False, details: DataFrame | None = None,
                sources: DataFrame | None = None, dedup: Deduplicator = dedup_first, by_vocabulary: bool | None = None) -> DataFrame:
    """The whole way: known and wanted by their source, active sources, match, dedup, publishers of each survivor."""
    return routes(survivors(items, filters, scoped, details, sources, dedup, by_vocabulary), filters, pubs)


def item_pub_sets(routed: DataFrame) -> DataFrame:
    return routed.groupBy("item_id").agg(F.array_sort(F.collect_set("pub")).alias("pubs"))


def default_layout() -> Column:
    """The message of a row by its publisher's template."""
    return render_each(F.col("template"), item_slots())


def rendered(routed: DataFrame, pubs: DataFrame, layout: Callable[[], Column] = default_layout) -> DataFrame:
    """Routed rows with the message and link of their publisher; ``layout`` makes the message from item and publisher columns."""
    dims = pubs.select(F.col("name").alias("pub"), "url_format", "template")
    full = lookup_join(routed, dims, "pub")
    return full.withColumn("message", layout()).withColumn(
        "url", build_url(F.col("url_format"), F.col("message")))


def delivery_cap(routed: DataFrame, cap: int = CHANNEL_SLOTS) -> DataFrame:
    """Mark each row ``pub_send``, or ``pub_full`` beyond the publisher's first ``cap`` of the hour, by time and item id.

    Only the boundary row of an overfull (publisher, hour) is looked for: salted ranks keep at
    most ``cap`` rows per salt before the final rank, so no task sees a whole hot publisher. The
    boundaries are then looked up by every row. The routed rows are written down first, with numbers that tell rows apart
    which are equal in time and id, so exactly ``cap`` of an hour pass.
    """
    routed = durable(routed.withColumn("_number", F.monotonically_increasing_id()))
    # in a struct, rows without a time share a slot like any other
    timed = routed.withColumn("_slot", F.struct("pub", F.date_trunc("hour", F.col("published")).alias("hour")))
    if cap <= 0:
        return timed.withColumn("event", F.lit("pub_full")).drop("_slot", "_number")
    place = F.struct(F.col("published").alias("p"), F.col("item_id").alias("i"), F.col("_number").alias("n"))
    slots = timed.select("_slot", place.alias("_at"), F.pmod(F.xxhash64("_number"), F.lit(CAP_SALTS)).alias("_salt"))
    salted = Window.partitionBy("_slot", "_salt").orderBy("_at")
    whole = Window.partitionBy("_slot").orderBy("_at")
    heads = slots.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= cap)
    last = heads.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") == cap).select("_slot", F.col("_at").alias("_last"))
    full = F.coalesce(place > F.col("_last"), F.lit(False))
    marked = lookup_join(timed, last, "_slot", "left").withColumn("event", F.when(full, "pub_full").otherwise("pub_send"))
    return marked.drop("_slot", "_last", "_number")


def outbox(routed: DataFrame, pubs: DataFrame, cap: int = CHANNEL_SLOTS, layout: Callable[[], Column] = default_layout) -> DataFrame:
    """What would be sent: ``(pub, item_id, message, url, event)``."""
    return rendered(delivery_cap(routed, cap), pubs, layout).select("pub", "item_id", "message", "url", "event")


def audit_log(routed: DataFrame) -> DataFrame:
    return routed.select("pub", "item_id", "title", "link", "src", "published")


def delivery_report(capped: DataFrame) -> DataFrame:
    return capped.groupBy("pub", "event").agg(F.count("*").alias("n"))


def receive_counts(items: DataFrame) -> DataFrame:
    """Received items per source, blank titles included."""
    return items.groupBy("src").agg(F.count("*").alias("n"))
