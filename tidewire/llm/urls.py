"""URL filters: fixed host and path rules, and association rules mined from labels, with built-in functions only.

FP-growth finds token combinations of labelled urls that go with a bad label often enough (support) and
reliably enough (confidence). Tokens that stand in exactly the same labelled urls are one item: whichever of them a combination names, it has the
same support and confidence, so that naming each would only multiply the rules. A url has an item if it has one of its tokens.
A mined rule is filed in an inverted index under its rarest item; a
url meets only the rules filed under its own items, and a rule fits if the url has all its items.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pages, shown_document
from tidewire.plans.sizing import lookup_join
from tidewire.session import durable

# Fixed values: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
# A mined rule holds for so many labelled urls, so reliably, whatever their number.
LEAST_COUNT, CONFIDENCE = 25, 0.75
BAD = "label=bad"


def part(url: Column | str, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))


def host(url: Column | str) -> Column:
    return F.translate(part(url, 1), UPPER, LOWER)


def path(url: Column | str) -> Column:
    return part(url, 2)


def fixed(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct with rule and verdict; null if none does."""
    found = F.array(*[
        F.when(((host_ == h) | host_.endswith("." + h)) & path_.startswith(p),
               F.struct(F.lit(len(h + p)).alias("length"), F.lit(len(h)).alias("of_host"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules])
    return F.array_max(F.array_compact(found))


def tokens(url: Column | str) -> Column:
    """What a url is made of: words of host (``h:``), path (``p:``) and the rest (``q:``), sorted; numbers count in the host only."""
    def words(text: Column, mark: str, least: str = r"\p{L}") -> Column:
        each = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(least))
        return F.transform(each, lambda w: F.concat(F.lit(mark), w))

    scheme = F.array(F.concat(F.lit("s:"), F.translate(F.coalesce(F.substring_index(url, "://", 1), F.lit("")), UPPER, LOWER)))
    return F.array_sort(F.array_distinct(F.concat(
        F.when(F.instr(url, "://") > 0, scheme).otherwise(F.array().cast("array<string>")),
        words(part(url, 1), "h:", "."), words(part(url, 2), "p:"), words(part(url, 3), "q:"))))


def items_of(held: DataFrame, least: int) -> DataFrame:
    """(token, item, n): tokens of at least ``least`` rows of ``held`` (row, token), and the item that those in the same rows make up."""
    # two hashes of the rows that a token is in, which don't depend on their order
    seen = held.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(2))).alias("b"))
    # no more tokens than one url has
    together = seen.where(F.col("n") >= least).groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return together.select(F.explode("tokens").alias("token"), F.array_join("tokens", " ").alias("item"), "n")


def mine(labelled: DataFrame, least: int = LEAST_COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent, confidence, support, filed) that point to a bad label; ``labelled`` has url and bad.

    Null labels and urls don't count. An item of the antecedent is its tokens, joined by spaces. ``filed`` is the antecedent's rarest item.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double, filed string")
    rows = durable(labelled.where("url is not null and bad is not null").select("bad", tokens("url").alias("tokens")).withColumn(
        "row", F.monotonically_increasing_id()), "labelled")
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    items = durable(items_of(held, least), "items")
    if items.isEmpty() or rows.where("bad").isEmpty():
        return none
    in_rows = lookup_join(held, items.select("token", "item"), "token").groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    baskets = durable(in_rows.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    n, known = rows.count(), baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / known), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * known / n).alias("support"))
    counts = items.select("item", "n").distinct()
    rarest = rules.select("antecedent", F.explode("antecedent").alias("item")).join(counts, "item").groupBy("antecedent").agg(
        F.min(F.struct("n", "item"))["item"].alias("filed"))
    return durable(rules.join(rarest, "antecedent"), "rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, mined, confidence) for each distinct set of url tokens that a mined rule fits, with its most confident rule.

    ``urls`` has key and tokens, one row per distinct set.
    """
    names = rules.select(F.explode("antecedent").alias("item")).distinct().select("item", F.explode(F.split("item", " ")).alias("token"))
    own = lookup_join(urls.select("key", F.explode("tokens").alias("token")), names, "token").groupBy("key").agg(F.collect_set("item").alias("items"))
    met = lookup_join(own.select("key", "items", F.explode("items").alias("filed")), rules, "filed")
    fits = met.where(F.size(F.array_except("antecedent", "items")) == 0)
    return fits.groupBy("key").agg(F.max(F.struct("confidence", F.array_join("antecedent", ", ").alias("mined"))).alias("_best")).select(
        "key", "_best.mined", "_best.confidence")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add host, path, rule, verdict, mined and confidence to rows with a url.

    A fixed rule decides; otherwise a url that a mined rule fits is blocked, and any other is allowed. A null url has no host, path or
    tokens and is allowed. Rows that repeat stay; columns of these names are replaced.
    """
    keyed = urls.withColumn("_tokens", F.coalesce(tokens("url"), F.array().cast("array<string>"))).withColumn("_key", F.array_join("_tokens", " "))
    distinct = keyed.groupBy(F.col("_key").alias("key")).agg(F.first("_tokens").alias("tokens"))
    found = matches(distinct, rules).withColumnRenamed("key", "_key")
    joined = lookup_join(keyed.drop("_tokens"), found, "_key", "left").drop("_key")
    placed = joined.withColumn("host", host("url")).withColumn("path", path("url"))
    ruled = placed.withColumn("_rule", fixed(F.col("host"), F.col("path")))
    return ruled.withColumn("rule", F.col("_rule.rule")).withColumn(
        "verdict", F.coalesce("_rule.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))).drop("_rule")


def labelled_pages(spark, sf_dir: str) -> DataFrame:
    """Urls labelled by the document they show: its number ends the path. Bad: low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    shown = pages(spark, sf_dir).select("url", shown_document("url").alias("doc_id"))
    return shown.join(labels, "doc_id").select("url", "bad")


def judge_pages(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence."""
    rules = mine(labelled_pages(spark, sf_dir))
    return judge(pages(spark, sf_dir).select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict", "mined", "confidence")
