"""Secret scans over an incremental ledger of blobs, with built-in functions only.

Every version of every path is addressed by the SHA-256 of its content, so equal versions are one blob. The ledger says which blob
was scanned by which version of which rule, and what was found. A scan looks at the pairs that the ledger lacks: new
blobs by all rules, known blobs by new or changed rules. Findings are kept by blob and joined back to all paths that have it.

The ledger is a folder of Parquet tables, one per scan, which appears as a whole when its job commits; a scan that was lost is done again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.plans.sizing import lookup_join
from tidewire.session import durable
from tidewire.sources.tables import once

# A null path's place in the order.
NO_ID = -(1 << 63)
LEDGER = "blob binary, scanned array<string>, spans array<struct<start: int, place: int, kind: string, end: int, rule: string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, and of which group at least how many characters there must be."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values. A run of one class is found at its full length either way, so its least length is in the pattern; a
# failing assignment takes its characters with it, so it is dropped afterwards.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Public formats of keys and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def address(text: Column | str) -> Column:
    """The address of a text's content; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def lengths(text: Column, rule: Rule) -> Column:
    """For each match of a rule: code points before it since the last one, of the match, and of the group that counts.

    Null if there is none. ``split`` gives what is between the matches that ``regexp_extract_all`` gives.
    """
    pattern = F.lit(rule.pattern)
    def each(texts: Column) -> Column:
        return F.transform(texts, lambda t: F.length(t))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counts = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.slice(each(F.split(text, rule.pattern, -1)), 1, F.size(matches)).alias("gap"), each(matches).alias("long"), each(counts).alias("counts"))
    return F.when(text.rlike(rule.pattern), parts)


def found(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of the ``texts`` (blob, text, missing) in which one of the ``missing`` rules finds something; spans in order of start, then rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"),
                 F.when(F.array_contains("missing", r.name), lengths(text, r)).alias("parts")) for i, r in enumerate(rules)])
    # one evaluation of the patterns; texts don't go further, and rows that repeat a blob have equal hits
    scanned = texts.select("blob", once(F.filter(hits, lambda h: h["parts"].isNotNull())).alias("hits")).where(F.size("hits") > 0).dropDuplicates(["blob"])
    numbered = scanned.select("blob", F.explode("hits").alias("h")).select(
        "blob", "h.place", "h.kind", "h.rule", "h.least", F.posexplode("h.parts").alias("at", "part"))
    # a text's own matches, summed up in order
    along = Window.partitionBy("blob", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.col("part.long")).over(along).cast("int")
    spans = numbered.withColumn("end", end).where(F.col("part.counts") >= F.col("least"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
        (F.col("end") - F.col("part.long")).alias("start"), "place", "kind", "end", "rule"))).alias("spans"))


class Ledger:
    """What was scanned by which rules, and what was found, in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        names = [c.split()[0] for c in ("blob binary", "scanned array", "spans array")]
        empty = spark.range(0).select(F.from_json(F.lit(None).cast("string"), LEDGER).alias("r")).select(*[f"r.{n}" for n in names])
        empty.write.mode("ignore").parquet(f"{self.folder}/scan=0")

    def table(self) -> DataFrame:
        return self.spark.read.schema(LEDGER + ", scan string").parquet(self.folder)

    def missing(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``blobs`` with the rules that the ledger lacks for them (``missing``), without those that it has by all rules."""
        # as many rows for a blob as there were scans that had something new for it
        seen = self.table().groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("_seen"))
        wanted = F.array(*[F.lit(r.name) for r in rules])
        none = F.array().cast("array<string>")
        return blobs.join(seen.hint("merge"), "blob", "left").withColumn(
            "missing", F.array_except(wanted, F.coalesce("_seen", none))).where(F.size("missing") > 0).drop("_seen")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what the ledger lacks of ``versions`` (path, text; a long path), and give (path, blob) of all rows.

        A null path is a path, a null text is empty. Rows may repeat.
        """
        rows = versions.select(F.coalesce(F.col("path").cast("long"), F.lit(NO_ID)).alias("path"), "text", address("text").alias("blob"))
        paths = durable(rows.select("path", "blob"), "paths")
        todo = durable(self.missing(paths.groupBy("blob").agg(F.min("path").alias("path")), rules), "todo")
        # of each blob one path's text is looked at, where it is
        texts = rows.join(todo.hint("merge"), ["path", "blob"])
        spans = durable(found(texts, rules), "found")
        done = lookup_join(todo.select("blob", F.col("missing").alias("scanned")), spans, "blob", "left")
        number = 1 + self.table().agg(F.coalesce(F.max(F.col("scan").cast("long")), F.lit(0))).first()[0]
        done.select("blob", "scanned", "spans").write.mode("overwrite").parquet(f"{self.folder}/scan={number}")
        return paths

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of all blobs in which one of ``rules`` found something; ``place`` is the rule's in the order of ``rules``."""
        places = F.create_map(*[c for i, r in enumerate(rules) for c in (F.lit(r.name), F.lit(i))])
        each = self.table().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin([r.name for r in rules]))
        return each.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
            F.col("s.start").alias("start"), F.try_element_at(places, "s.rule").alias("place"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end")))).alias("spans"))

    def report(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``paths`` (path, blob, ...) with the spans of their blob, an empty array if there are none."""
        found_ = durable(self.findings(rules), "findings")
        none = F.array().cast(found_.schema["spans"].dataType)
        return lookup_join(paths, found_, "blob", "left").withColumn("spans", F.coalesce("spans", none)).withColumn("path", F.nullif("path", F.lit(NO_ID)))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(reported: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of reported paths."""
    kinds = [r.kind for r in BASE]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, kinds)
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return reported.select(F.col("path").alias("doc_id"), *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def scan_documents(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`digest` of ``docs`` (doc_id, text), a version of each path, by the ledger in ``folder``."""
    ledger = Ledger(docs.sparkSession, folder)
    return digest(ledger.report(ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"), rules), rules))
