"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces, with built-in functions only.

A text is cut at blank lines into sections, at line ends into paragraphs, and a paragraph into pieces
of at most ``PIECE`` characters (``FINE`` in a paragraph below ``SHORT``) that don't run over the end of a sentence. A piece's hash is a leaf.
A paragraph's hash is the hash of its leaves' hashes, a section's that of its paragraphs' hashes, and the root that of the sections' hashes and of
what stands between sections. The fingerprint spells out the tree with shortened hashes: ``root/section:paragraph=leaf.leaf,paragraph=leaf;section:...``.

Equal roots mean equal texts. Where roots differ, both trees are walked from the top by their children. The children that both have at the beginning and at
the end are kept. Of those in between, the ones that both have were moved; of the others the first was replaced by the first, the second by the second
and so on, and what is over was deleted or inserted. Replaced branches are opened in turn, equal ones never are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import durable
from tidewire.sources.tables import once

PIECE = 48
SHORT, FINE = 64, 8
SECTIONS = r"\n[^\S\n]*\n"
# Hexadecimal digits of a leaf and of an inner node in a fingerprint; hashes of nodes are made of whole ones.
LEAF = 8
NODE = 16
# What follows the hash of a section or paragraph, and what parts its children.
OPENS, PARTS = (":", "="), (";", ",", ".")
# A null doc_id's place in the order.
NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def pieces(paragraph: Column) -> Column:
    """Cut a paragraph, a short one finer: nothing is lost, so equal pieces in order mean equal paragraphs."""
    def cut(n: int) -> Column:
        return F.regexp_extract_all(paragraph, F.lit(rf"(?s)[^.!?]{{0,{n - 1}}}(?:[.!?]+\s*|[^.!?]|$)"), F.lit(0))

    return F.filter(F.when(F.length(paragraph) < SHORT, cut(FINE)).otherwise(cut(PIECE)), lambda p: p != "")


def node(hashes: Column, spelled: Column, level: int) -> Column:
    """A node over its children: its hash, and how it is spelled."""
    return let(F.md5(F.array_join(hashes, "")), lambda h: F.struct(
        h.alias("hash"), F.concat(F.substring(h, 1, NODE), F.lit(OPENS[level]), F.array_join(spelled, PARTS[level + 1])).alias("spelled")))


def paragraph_node(paragraph: Column) -> Column:
    return let(F.transform(pieces(paragraph), F.md5), lambda leaves: node(leaves, F.transform(leaves, lambda x: F.substring(x, 1, LEAF)), 1))


def section_node(section: Column) -> Column:
    return let(F.transform(F.split(section, "\n"), paragraph_node), lambda inner: node(inner["hash"], inner["spelled"], 0))


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text; null counts as empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    gaps = F.transform(F.regexp_extract_all(whole, F.lit(SECTIONS), F.lit(0)), F.md5)
    return let(F.transform(F.split(whole, SECTIONS), section_node), lambda inner: F.concat(
        F.md5(F.concat_ws("|", F.array_join(inner["hash"], ""), F.array_join(gaps, ""))), F.lit("/"), F.array_join(inner["spelled"], PARTS[0])))


def root(print_: Column) -> Column:
    return F.substring_index(print_, "/", 1)


def children(branch: Column, level: int) -> Column:
    """The children, as they are spelled, of a fingerprint (level 0), a section (1) or a paragraph (2)."""
    skip = len("/") + (32 if level == 0 else NODE)
    parts = F.split(F.substring(branch, skip + 1, 1 << 30), "[" + PARTS[level] + "]")
    return F.filter(parts, lambda p: p != "") if level == 2 else parts


def alike(x: Column, y: Column) -> Column:
    """How many entries two arrays have in common at their beginning."""
    differ = F.array_position(F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size(x), F.size(y))).cast("int")


def walk(x: Column, y: Column, body: Callable[..., Column]) -> Column:
    """``body`` of what became of the children ``x`` in ``y``: kept at the beginning, kept at the end, moved, gone and new ones.

    Moved, gone and new ones are distinct, in order; the first gone ones were replaced by the first new ones.
    """
    def middle(of: Column, head: Column, tail: Column) -> Column:
        return F.slice(of, head + 1, F.size(of) - head - tail)

    def rest(of: Column, head: Column) -> Column:
        return F.reverse(F.slice(of, head + 1, F.size(of) - head))

    def split(head: Column, tail: Column, mx: Column, my: Column) -> Column:
        return body(F.slice(x, 1, head), F.slice(x, F.size(x) - tail + 1, tail), F.array_intersect(mx, my), F.array_except(mx, my), F.array_except(my, mx))

    return let(alike(x, y), lambda head: let(alike(rest(x, head), rest(y, head)), lambda tail: let(
        middle(x, head, tail), lambda mx: let(middle(y, head, tail), lambda my: split(head, tail, mx, my)))))


def paired(gone: Column, new: Column) -> Column:
    """The replaced branches with what replaced them."""
    n = F.least(F.size(gone), F.size(new))
    return F.arrays_zip(F.slice(gone, 1, n).alias("old"), F.slice(new, 1, n).alias("new"))


def leaves(branches: Column, level: int) -> Column:
    """How many leaves there are in branches."""
    return F.size(branches) if level == 2 else F.regexp_count(F.array_join(branches, ";"), F.lit("[=.][0-9a-f]"))


def shared(x: Column, y: Column, level: int = 0) -> Column:
    """Leaves in kept branches, twice, and in moved ones, once; of replaced branches what their own children share."""
    def count(head: Column, tail: Column, moved: Column, gone: Column, new: Column) -> Column:
        own = 2 * leaves(head, level) + 2 * leaves(tail, level) + leaves(moved, level)
        if level == 2:
            return own
        return own + F.aggregate(paired(gone, new), F.lit(0), lambda n, p: n + shared(children(p["old"], level + 1), children(p["new"], level + 1), level + 1))

    return let(x, lambda a: let(y, lambda b: walk(a, b, count)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the leaves that the walk finds kept, moved ones half, over the mean number of leaves; 1 only if the roots are equal."""
    def compared(x: Column, y: Column) -> Column:
        total = leaves(x, 0) + leaves(y, 0)
        return F.when(total > 0, F.least(shared(x, y) / total, 1 - 1 / (total + 1.0))).otherwise(0.0)

    return F.when(root(a) == root(b), 1.0).otherwise(let(children(a, 0), lambda x: let(children(b, 0), lambda y: compared(x, y))))


def edits(a: Column, b: Column) -> Column:
    """What became of the tree ``a`` in ``b``: an array of (kind, a, b).

    ``kind`` is replaced (leaves only: other replaced branches are opened), moved, deleted or inserted; ``a`` and ``b`` are the branch's places from
    the top, from 0: section, paragraph, leaf. Deleted ones have no ``b``, inserted ones no ``a``. Of branches that repeat, the first is named.
    """
    none = F.lit(None).cast("array<int>")

    def edit(kind: str, at_a: Column, at_b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at_a.alias("a"), at_b.alias("b"))

    def compared(x: Column, y: Column, above_a: Column, above_b: Column, level: int) -> Column:
        def at(above: Column, of: Column, branch: Column) -> Column:
            return F.array_append(above, (F.array_position(of, branch) - 1).cast("int"))

        def listed(head: Column, tail: Column, moved: Column, gone: Column, new: Column) -> Column:
            n = F.least(F.size(gone), F.size(new))

            def opened(p: Column) -> Column:
                here = at(above_a, x, p["old"]), at(above_b, y, p["new"])
                if level == 2:
                    return F.array(edit("replaced", *here))
                return compared(children(p["old"], level + 1), children(p["new"], level + 1), *here, level + 1)

            return F.concat(
                F.transform(moved, lambda m: edit("moved", at(above_a, x, m), at(above_b, y, m))), F.flatten(F.transform(paired(gone, new), opened)),
                F.transform(F.slice(gone, n + 1, F.size(gone)), lambda g: edit("deleted", at(above_a, x, g), none)),
                F.transform(F.slice(new, n + 1, F.size(new)), lambda g: edit("inserted", none, at(above_b, y, g))))

        return walk(x, y, listed)

    top = F.array().cast("array<int>")
    changed = let(children(a, 0), lambda x: let(children(b, 0), lambda y: compared(x, y, top, top, 0)))
    return F.when(root(a) == root(b), F.array().cast("array<struct<kind: string, a: array<int>, b: array<int>>>")).otherwise(changed)


def following(keys: DataFrame) -> DataFrame:
    """For each distinct ``_key`` the next one (``_next``); the first for the last.

    Keys are dealt out by ranges, so no task sees them all; where a range ends, the first key of the next
    range that has any follows.
    """
    dealt = durable(keys.select("_key").distinct().repartitionByRange("_key").withColumn("_range", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("_range").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    # one row per range
    along = Window.orderBy("_range")
    every = Window.partitionBy()
    after = ends.select("_range", "_last", F.coalesce(F.lead("_first").over(along), F.min("_first").over(every)).alias("_after"))
    inside = Window.partitionBy("_range").orderBy("_key")
    return dealt.withColumn("_lead", F.lead("_key").over(inside)).join(after, "_range").select(
        "_key", F.when(F.col("_key") == F.col("_last"), F.col("_after")).otherwise(F.col("_lead")).alias("_next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty, a null doc_id comes first. The edited text has its last quarter replaced by the beginning
    of the next document. Where a doc_id is repeated, the smallest beginning stands for it as the next document;
    every row is fingerprinted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    quarter = F.expr("cast(floor(length(text) / 4) as int)")
    lengths = durable(docs.select(key.alias("_key"), text.alias("text")).select("_key", quarter.alias("_need")), "lengths")
    needs = lengths.groupBy("_key").agg(F.max("_need").alias("_need")).join(following(lengths), "_key").select(
        F.col("_key").alias("_before"), F.col("_next").alias("_key"), "_need")
    # whole texts are dealt out once; both branches below read the same exchange
    rows = docs.select(key.alias("_key"), text.alias("text"))
    printed = rows.select("_key", "text", fingerprint("text").alias("fingerprint")).repartition("_key")
    passed = printed.join(needs, "_key").select(
        F.col("_before").alias("_key"), F.struct(F.expr("left(text, _need)").alias("head"), "fingerprint").alias("_one"))
    heads = passed.groupBy("_key").agg(F.min("_one").alias("_one"))
    edited = printed.join(heads, "_key").select(
        F.nullif(F.col("_key"), F.lit(NO_ID)).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "fingerprint",
        F.col("_one.fingerprint").alias("_next_print"),
        F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"),
                 F.expr("left(_one.head, cast(floor(length(text) / 4) as int))")).alias("_edited"))
    printed_twice = edited.select("doc_id", "n_chars", "fingerprint", "_next_print", F.sha2("_edited", 256).alias("edited_sha256"),
                                  once(fingerprint("_edited")).alias("edited_fingerprint"))
    return printed_twice.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"))
