"""The registered queries: ``name -> (spark, folder) -> DataFrame``.

Arrays leave as ``|``-joined text, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.catalog import subscriptions as subs
from tidewire.functions import render, sql, text
from tidewire.functions.affix import affix_match
from tidewire.functions.hours import is_muted
from tidewire.operators import dedup, dimensions, matching, routing, subsumption, throttle
from tidewire.plans import rules as rule_tables
from tidewire.plans.patterns import translate
from tidewire.session import durable, temporary_dir
from tidewire.sources import feeds, sinks, tables
from tidewire.streaming import jobs, ordered, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIFO_CAPACITY = 4
HOURLY_CAP = 2
LATE = timedelta(hours=6)
LONGEST_MESSAGE = 100


def query(function: Query | None = None, *, name: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        return function

    return register(function) if function else register


def joined(column: Column | str) -> Column:
    return F.array_join(column, "|")


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as items with the token line of their text."""
    rows = tables.titled_documents(spark, folder)
    return rows.select("item_id", "src", tables.once(text.token_line("text")).alias("line"))


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All document texts with the token line of the whole text."""
    rows = tables.spread(tables.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("*", tables.once(text.token_line("text")).alias("line"))


def title_words(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).select("item_id", text.line_words(F.col("line")).alias("words"))


def desk_routes(spark: SparkSession, folder: str, scoped: bool = False) -> DataFrame:
    return routing.route_items(tables.titled_documents(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                               scoped, tables.document_stamps(spark, folder))


# --- scans ---------------------------------------------------------------------------------


@query
def scan_items(spark, folder):
    return tables.document_items(spark, folder).drop("text").withColumn("categories", joined("categories"))


@query
def scan_page_items(spark, folder):
    return tables.page_items(spark, folder).select("item_id", "src", "title", "link")


@query
def scan_feed_xml(spark, folder):
    """Items written as RSS by source, and read back as a feed."""
    path = temporary_dir(spark, "feed")
    feeds.write_rss(tables.document_items(spark, folder), path, ["src"])
    rows = feeds.read_feeds(spark, path)
    return rows.select("title", "link", joined("categories").alias("categories"), "published")


@query
def scan_multi_link(spark, folder):
    """Sources with two links each: the items under every link, with their source."""
    path = temporary_dir(spark, "feeds")
    items = tables.document_items(spark, folder).withColumn("half", F.col("item_id") % 2)
    feeds.write_rss(items, path, ["src", "half"])
    links = F.array(*[F.concat(F.lit(f"{path}/src="), F.col("name"), F.lit(f"/half={half}")) for half in (0, 1)])
    sources = subs.document_sources(spark, folder).withColumn("links", links)
    return feeds.of_sources(feeds.read_feeds(spark, path), sources).select("src", "title", "link", "published")


@query
def receive_counts(spark, folder):
    return routing.receive_counts(tables.document_titles(tables.table(spark, folder, "documents")))


@query
def parse_pubdate(spark, folder):
    """Event times written the ways feeds do, with weekday and zone or in ISO form, and parsed back."""
    stamps = tables.table(spark, folder, "events").select("event_id", "ts")
    day = F.concat(F.element_at(F.array(*map(F.lit, ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"])), F.dayofweek("ts")), F.lit(", "))
    forms = [
        F.concat(day, F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0300")),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(day, F.date_format("ts", "dd MMM yy HH:mm"), F.lit(" GMT")),
        F.concat(F.date_format("ts", "dd MMM yy HH:mm:ss"), F.lit(" EST")),
        F.concat(F.date_format("ts", "dd MMMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"),
    ]
    written = F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int"))
    return stamps.select("event_id", render.parse_feed_time(written).alias("published"))


# --- words and strings -----------------------------------------------------------------------


@query
def tokenize(spark, folder):
    return title_words(spark, folder).select("item_id", joined("words").alias("words"))


@query
def tokenize_text(spark, folder):
    """Words of whole texts: their number and a digest of them in order."""
    words = text.line_words(F.col("line"))
    return whole_texts(spark, folder).select(
        "doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, "|")).alias("digest"))


@query
def is_blank(spark, folder):
    return tables.headlines(spark, folder).select("doc_id", "part", text.is_blank("title").alias("blank"))


@query
def split_trim(spark, folder):
    rows = tables.spread(tables.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", tables.once(text.split_trim("text", ",")).alias("parts")).select(
        "doc_id", F.size("parts").alias("n_parts"), F.md5(joined("parts")).alias("digest"))


@query
def dedup_key(spark, folder):
    return titles(spark, folder).select("item_id", text.dedup_key(F.col("line")).alias("key"))


@query
def dedup_capacity(spark, folder):
    keyed = titles(spark, folder).select(text.dedup_key(F.col("line")).alias("key"))
    return dedup.distinct_keys(keyed)


@query
def set_index_of(spark, folder):
    return title_words(spark, folder).select("item_id", text.index_of(F.col("words"), "of").alias("at"))


@query
def set_contains(spark, folder):
    return title_words(spark, folder).select("item_id", text.contains(F.col("words"), "the").alias("found"))


@query
def set_append(spark, folder):
    return title_words(spark, folder).select(
        "item_id", joined(text.append_absent(F.col("words"), F.lit("the"))).alias("words"))


@query
def valid_items(spark, folder):
    return tables.valid_items(tables.headlines(spark, folder))


@query
def rejected_items(spark, folder):
    return tables.rejected_items(tables.headlines(spark, folder))


# --- patterns and conditions -----------------------------------------------------------------


@query
def pattern_match(spark, folder):
    """Every distinct word against the patterns of the desk rules."""
    words = titles(spark, folder).select(F.explode(text.line_words(F.col("line"))).alias("word")).distinct()
    patterns = sorted({p for _, cond, _, _ in subs.DESK_RULES for p in cond.replace(";", " ").replace("&", " ").split()})
    hits = F.array_compact(F.array(*[F.when(F.col("word").rlike(translate(p).regex), F.lit(p)) for p in patterns]))
    return words.select("word", F.explode_outer(hits).alias("pattern")).filter("pattern is not null")


@query
def seq_match(spark, folder):
    """Whole texts holding words for ``de la`` or ``and *tion$`` in a row."""
    tests = [F.when(rule_tables.sequence_matches(seq.split(), F.col("line")), F.lit(seq)) for seq in ("de la", "and *tion$")]
    return whole_texts(spark, folder).select("doc_id", F.explode_outer(F.array_compact(F.array(*tests))).alias("seq")).filter("seq is not null")


@query
def conj_match(spark, folder):
    """Whole texts holding all of ``the``, ``of`` and ``with the``."""
    rule = rule_tables.Rule(0, [], [[["the"], ["of"], ["with", "the"]]])
    return whole_texts(spark, folder).filter(rule.matches(F.col("line"))).select("doc_id")


@query
def dnf_match(spark, folder):
    """The desk conditions on whole texts."""
    rules = rule_tables.compile_rules(subs.desk_filters(spark))
    rows = whole_texts(spark, folder).select("doc_id", F.explode_outer(matching.match_column(rules)).alias("filter_id"))
    return rows.filter("filter_id is not null")


@query
def rule_terms(spark, folder):
    return rule_tables.rule_terms(subs.watch_filters(spark, folder))


@query
def rule_lint(spark, folder):
    return rule_tables.rule_lint(subs.spoiled_filters(spark, folder))


@query
def rule_subsumed(spark, folder):
    return subsumption.rule_subsumed(subs.widened_filters(spark, folder))


@query
def conj_by_count(spark, folder):
    found = matching.conj_by_count(titles(spark, folder), subs.watch_filters(spark, folder))
    return found.select("item_id", "filter_id", "conj_id", "found")


# --- sources, filters, publishers ------------------------------------------------------------


@query
def affix_match_pairs(spark, folder):
    return dimensions.affix_pairs(subs.document_sources(spark, folder), subs.watch_filters(spark, folder), "sources")


@query(name="affix_match")
def affix_match_items(spark, folder):
    """Does the item's source match the globs of its category list (a column, not a constant)?"""
    rows = tables.document_items(spark, folder)
    globs = F.array(F.lit("en"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return rows.select("item_id", affix_match(F.col("src"), globs).alias("matches"))


@query
def category_prefilter(spark, folder):
    items = tables.document_items(spark, folder)
    return routing.category_prefilter(items, subs.document_sources(spark, folder)).select("item_id", "src")


@query
def source_agency(spark, folder):
    return subs.document_sources(spark, folder).select("name", render.agency_of(F.col("name")).alias("agency"))


@query
def active_sources(spark, folder):
    return dimensions.active_sources(subs.document_sources(spark, folder), subs.desk_filters(spark)).select("name")


@query
def orphan_sources(spark, folder):
    return dimensions.orphan_sources(subs.document_sources(spark, folder), subs.desk_filters(spark)).select("name")


@query
def filter_pubs(spark, folder):
    return dimensions.filter_pubs(subs.supplier_pubs(spark, folder), subs.watch_filters(spark, folder))


@query
def orphan_pubs(spark, folder):
    return dimensions.orphan_pubs(subs.supplier_pubs(spark, folder), subs.watch_filters(spark, folder)).select("name")


@query
def config_check(spark, folder):
    sources = subs.document_sources(spark, folder)
    # a second row for some sources, one without a name and one without links
    spoiled = sources.unionByName(sources.filter(F.col("name").endswith(".src7"))).unionByName(
        sources.filter("name = 'en.src1'").withColumn("name", F.regexp_replace("name", ".+", " ")).withColumn("links", F.array().cast("array<string>")))
    return dimensions.config_check(spoiled, subs.watch_filters(spark, folder).filter(F.size("sources") > 0), subs.supplier_pubs(spark, folder))


@query
def item_source(spark, folder):
    found = routing.item_source(tables.document_items(spark, folder), subs.document_sources(spark, folder).drop("categories"))
    return found.select("item_id", "src", joined("links").alias("links"), "mute_begin", "mute_end")


# --- matching and routing ----------------------------------------------------------------------


@query
def item_matches(spark, folder):
    return routing.active_item_matches(tables.titled_documents(spark, folder), subs.desk_filters(spark), by_vocabulary=False)


@query
def item_matches_vocab(spark, folder):
    return routing.active_item_matches(tables.titled_documents(spark, folder), subs.desk_filters(spark), by_vocabulary=True)


@query
def watch_matches(spark, folder):
    """Titles against the rules derived from ``benchmark``, through the vocabulary."""
    return routing.item_matches(titles(spark, folder), subs.watch_filters(spark, folder), by_vocabulary=True)


@query
def matched_items(spark, folder):
    return routing.matched_items(tables.titled_documents(spark, folder), subs.desk_filters(spark)).select("item_id")


@query
def dedup_first(spark, folder):
    """First of each title over all items, matched or not."""
    keyed = tables.with_key(tables.prepared(tables.document_items(spark, folder)))
    return dedup.dedup_first(keyed.select("item_id", "src", "key", "published"))


@query
def dedup_fifo(spark, folder):
    keyed = tables.with_key(tables.prepared(tables.document_items(spark, folder)))
    return dedup.dedup_fifo(keyed.select("item_id", "src", "key", "published"), "src", FIFO_CAPACITY)


@query
def route_items(spark, folder):
    return desk_routes(spark, folder).select("item_id", "pub")


@query
def route_items_scoped(spark, folder):
    return desk_routes(spark, folder, scoped=True).select("item_id", "pub")


def benchmark_routes(spark: SparkSession, folder: str, by_vocabulary: bool) -> DataFrame:
    routed = routing.route_items(tables.titled_documents(spark, folder), subs.watch_filters(spark, folder),
                                 subs.supplier_pubs(spark, folder), details=tables.document_stamps(spark, folder), by_vocabulary=by_vocabulary)
    return routed.select("item_id", "pub")


@query
def watch_routes(spark, folder):
    """Routing with the rules derived from ``benchmark`` to suppliers, through the vocabulary."""
    return benchmark_routes(spark, folder, True)


@query
def watch_routes_columns(spark, folder):
    """The same by columns, as far as there are few enough rules."""
    return benchmark_routes(spark, folder, False)


@query
def route_pipeline(spark, folder):
    """Known sources, their categories, matching by scope, dedup, publishers."""
    routed = routing.route_items(tables.document_items(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                                 scoped=True, sources=subs.document_sources(spark, folder))
    return routed.select("item_id", "pub")


@query
def route_fifo(spark, folder):
    """Routing with a bounded memory of titles per source."""
    routed = routing.route_items(tables.document_items(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                                 dedup=lambda found: dedup.dedup_fifo(found, "src", FIFO_CAPACITY))
    return routed.select("item_id", "pub")


@query
def route_pages(spark, folder):
    """Pages by their true titles, with the desk rules for any source."""
    rules = subs.desk_filters(spark).withColumn("sources", F.array().cast("array<string>"))
    return routing.route_items(tables.page_items(spark, folder), rules, subs.desk_pubs(spark)).select("item_id", "pub")


@query
def item_pub_sets(spark, folder):
    return routing.item_pub_sets(desk_routes(spark, folder)).select("item_id", joined("pubs").alias("pubs"))


@query
def audit_log(spark, folder):
    return routing.audit_log(desk_routes(spark, folder))


@query
def date_fmt(spark, folder):
    return tables.table(spark, folder, "events").select("event_id", render.date_text(F.col("ts")).alias("date_fmt"))


@query
def render_message(spark, folder):
    return tables.document_items(spark, folder).select("item_id", render.render(None, render.item_slots()).alias("message"))


@query
def url_escape(spark, folder):
    rows = tables.spread(tables.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", render.query_escape(F.col("text")).alias("escaped"))


@query
def outbox(spark, folder):
    return routing.outbox(desk_routes(spark, folder), subs.desk_pubs(spark), HOURLY_CAP)


@query
def delivery_cap(spark, folder):
    return routing.delivery_cap(desk_routes(spark, folder), HOURLY_CAP).select("item_id", "pub", "event")


@query
def delivery_report(spark, folder):
    return routing.delivery_report(routing.delivery_cap(desk_routes(spark, folder), HOURLY_CAP))


# --- hours and cooldowns ---------------------------------------------------------------------


@query
def mute_hours(spark, folder):
    return tables.pulls(spark, folder).filter(~is_muted(F.col("ts"), *subs.MUTE)).select("id", "user_id", "ts")


@query(name="throttle")
def throttled(spark, folder):
    return throttle.throttle(tables.pulls(spark, folder), "user_id", subs.COOLDOWN)


@query
def throttle_then_mute(spark, folder):
    return throttle.throttle_then_mute(tables.pulls(spark, folder), "user_id", subs.COOLDOWN, *subs.MUTE)


def source_pulls(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """Items as requests to their source, with its cooldown and mute hours."""
    requests = items.select("src", F.col("published").alias("ts"), F.col("item_id").alias("id"))
    return requests.join(subs.pull_sources(spark, folder).withColumnRenamed("name", "src"), "src")


@query
def source_throttle(spark, folder):
    """Each source with its own cooldown and mute hours."""
    rows = source_pulls(spark, folder, tables.document_items(spark, folder))
    kept = throttle.throttle_then_mute(rows, "src", F.col("cooldown"), F.col("mute_begin"), F.col("mute_end"))
    return kept.select("src", "ts", "id")


# --- SQL ---------------------------------------------------------------------------------------


@query
def sql_functions(spark, folder):
    """Words, keys, links and dates of the items, by functions named in SQL."""
    sql.register(spark)
    return spark.sql("""
        SELECT item_id, dedup_key(token_line(text)) AS key, size(tokenize(text)) AS n_words, is_blank(title) AS blank, size(split_trim(text, ',')) AS n_parts,
               affix_match(src, array('en', 'src1')) AS affix, agency(src) AS agency, date_text(published) AS date_fmt, muted(published, 20, 5) AS muted,
               build_url('http://example.org/send?text=%s', title) AS url
        FROM {items}""", items=tables.document_items(spark, folder))


@query
def sql_route(spark, folder):
    """The routing of ``route_items`` written in SQL; the desk rules are a function there. An exploded array of one has a costly value computed once."""
    sql.register(spark)
    sql.register_rules(spark, rule_tables.compile_rules(subs.desk_filters(spark)))
    return spark.sql("""
        WITH worded AS (SELECT item_id, array(token_line(text)) AS lines FROM {items} WHERE active(src) AND NOT is_blank(title)),
          matched AS (SELECT item_id, line, array(satisfied(line)) AS sets FROM worded LATERAL VIEW OUTER explode(lines) AS line),
          found AS (SELECT item_id, dedup_key(line) AS key, filter_ids FROM matched LATERAL VIEW OUTER explode(sets) AS filter_ids WHERE size(filter_ids) > 0),
          ranked AS (SELECT item_id, filter_ids, row_number() OVER (PARTITION BY key ORDER BY published, item_id) AS n FROM found JOIN {stamps} USING (item_id))
        SELECT DISTINCT item_id, pub FROM (SELECT item_id, explode(filter_ids) AS filter_id FROM ranked WHERE n = 1) JOIN {filter_pubs} USING (filter_id)""",
        items=tables.titled_documents(spark, folder), stamps=tables.document_stamps(spark, folder),
        filter_pubs=dimensions.filter_pubs(subs.desk_pubs(spark), subs.desk_filters(spark)))


@query
def sql_throttle(spark, folder):
    """The throttle as a table function."""
    sql.register(spark)
    return spark.sql("SELECT * FROM throttle(TABLE({pulls}) PARTITION BY user_id ORDER BY (ts, id), 'ts', 21600)", pulls=tables.pulls(spark, folder))


# --- streams -----------------------------------------------------------------------------------


@query
def stream_route(spark, folder):
    """The routing job over all input there is; titles and publishers it delivered."""
    path = temporary_dir(spark, "route")
    job = jobs.start_route(jobs.document_item_stream(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                           f"{path}/outbox", f"{path}/log")
    job.awaitTermination()
    return spark.read.parquet(f"{path}/outbox").select("key", "pub")


@query
def stream_dedup(spark, folder):
    keyed = tables.with_key(tables.prepared(jobs.document_item_stream(spark, folder))).select("key", "published")
    return jobs.drain(jobs.dedup_stream(keyed), "dedup").select("key")


@query
def stream_dedup_fifo(spark, folder):
    keyed = tables.with_key(tables.prepared(jobs.document_item_stream(spark, folder)))
    return jobs.drain(state.dedup_fifo_stream(keyed.select("item_id", "src", "key", "published"), "src", FIFO_CAPACITY), "fifo")


@query
def stream_throttle(spark, folder):
    pulls = jobs.stream_table(spark, folder, "events").select("user_id", "ts", F.col("event_id").alias("id"))
    return jobs.drain(state.throttle_stream(pulls, "user_id", subs.COOLDOWN), "throttle")


@query
def stream_source_throttle(spark, folder):
    return jobs.drain(state.throttle_stream(
        source_pulls(spark, folder, jobs.document_item_stream(spark, folder)), "src", F.col("cooldown"),
        begin=F.col("mute_begin"), end=F.col("mute_end")), "throttle").select("src", "ts", "id")


@query
def stream_outbox(spark, folder):
    """What the routing job delivers, rendered: which of two equal texts goes out depends on arrival, so the text's key stands for it."""
    path = temporary_dir(spark, "outbox")
    jobs.start_route(jobs.document_item_stream(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                     f"{path}/outbox", f"{path}/log", sources=subs.document_sources(spark, folder), scoped=True).awaitTermination()
    return spark.read.parquet(f"{path}/outbox").select("pub", "message", "url")


@query
def stream_throttle_late(spark, folder):
    """Pulls that arrive up to six hours late, throttled in the order of their own times."""
    path = temporary_dir(spark, "late")
    for stream in jobs.arriving(tables.pulls(spark, folder), "ts", f"{path}/in", LATE):
        kept = jobs.drain(ordered.throttle_ordered(stream, "user_id", subs.COOLDOWN, delay=2 * LATE), "throttle", path)
    return kept.filter("id is not null").select("user_id", "ts", "id")


def capped_streams(spark: SparkSession, folder: str, path: str) -> Iterator[DataFrame]:
    """Routed rows with the hourly cap, as they arrive late."""
    routed = desk_routes(spark, folder).select("item_id", "pub", "title", "published")
    for stream in jobs.arriving(routed, "published", f"{path}/in", LATE):
        yield ordered.cap_ordered(stream, HOURLY_CAP, delay=2 * LATE)


@query
def stream_delivery_cap(spark, folder):
    path = temporary_dir(spark, "cap")
    for stream in capped_streams(spark, folder, path):
        capped = jobs.drain(stream, "cap", path)
    return capped.filter("pub is not null").select("item_id", "pub", "event")


@query
def stream_delivery_report(spark, folder):
    """What a capped stream of deliveries wrote, counted as it went out."""
    path = temporary_dir(spark, "report")
    for stream in capped_streams(spark, folder, path):
        jobs.start_deliveries(stream.filter("pub is not null"), sinks.counting_publisher(path), f"{path}/log").awaitTermination()
    return sinks.counted(spark, path)


@query
def stream_capacity(spark, folder):
    """How many keys the FIFO stream remembers for each source, read from its state."""
    path = temporary_dir(spark, "fifo")
    keyed = tables.with_key(tables.prepared(jobs.document_item_stream(spark, folder))).select("item_id", "src", "key", "published")
    jobs.drain(state.dedup_fifo_stream(keyed, "src", FIFO_CAPACITY), "fifo", path)
    return state.remembered_keys(spark, f"{path}/log")


def short_only(pub: str, message: str, url: str) -> None:
    """A receiver that takes short messages only."""
    if len(message) > LONGEST_MESSAGE:
        raise ValueError(f"{len(message)} characters for {pub}")


@query
def stream_outbox_errors(spark, folder):
    """Routed rows that their receiver refused, with the reason; all others went out."""
    path = temporary_dir(spark, "errors")
    jobs.start_route(jobs.document_item_stream(spark, folder), subs.desk_filters(spark), subs.desk_pubs(spark),
                     sinks.sending_publisher(f"{path}/outbox", short_only), f"{path}/log", sources=subs.document_sources(spark, folder), scoped=True).awaitTermination()
    return sinks.failed(spark, f"{path}/outbox").select("pub", "message", "error")


def spoiled_feeds(spark: SparkSession, folder: str) -> list[str]:
    """Items written as RSS by source, every seventh without a title, and for sources with an item_id that ends in 3 a feed more that breaks off."""
    path = temporary_dir(spark, "feeds")
    items = tables.document_items(spark, folder)
    titled = items.withColumn("title", F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("title")))
    feeds.write_rss(titled, f"{path}/good", ["src"])
    broken = F.concat(F.lit("<channel><item><title>item "), F.col("item_id").cast("string"), F.lit("</titel></item></channel>"))
    firsts = items.filter("item_id % 10 = 3").groupBy("src").agg(F.min("item_id").alias("item_id"))
    firsts.select("src", broken.alias("value")).write.partitionBy("src").text(f"{path}/broken")
    return [f"{path}/good", f"{path}/broken"]


def link_of() -> Column:
    return F.regexp_extract("file", "/src=([^/]*)/", 1)


@query
def receive_report(spark, folder):
    """Received, rejected and broken rows of each feed link, from one scan."""
    scanned = durable(feeds.scan_feeds(spark, spoiled_feeds(spark, folder)).select("file", "status"), "scanned")
    return feeds.receive_report(scanned, link_of())


@query
def stream_receive_report(spark, folder):
    """The same over the feeds as a stream, counted by micro-batch."""
    path = temporary_dir(spark, "received")
    good, broken = spoiled_feeds(spark, folder)
    for name in (good, broken):
        rows = feeds.stream_scanned_feeds(spark, f"{name}/*").select(link_of().alias("link"), "status", F.lit("feed").alias("pub"))
        jobs.start_deliveries(rows, sinks.counting_publisher(f"{path}/{name[-4:]}", ("link", "status")), f"{path}/log-{name[-4:]}").awaitTermination()
    counts = [sinks.counted(spark, f"{path}/{name[-4:]}", ("link", "status")) for name in (good, broken)]
    n = F.col("n")
    return counts[0].union(counts[1]).groupBy("link").agg(
        F.sum(F.when(F.col("status") != "broken", n).otherwise(0)).alias("received"), F.sum(F.when(F.col("status") == "rejected", n).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("status") == "broken", n).otherwise(0)).alias("broken"))
