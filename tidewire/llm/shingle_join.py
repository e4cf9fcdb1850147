"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

Two documents link when their shingle sets are similar enough. DivideSkip puts a query's longest inverted lists aside, merges the
short ones, and looks up what occurs there in the long ones. Here that is done twice: over all documents, to find who
may link with whom, and in cells of a bounded number of documents, to find the links.

Over all documents, exactly:

1. Equal sets are one node, the smallest doc_id of them.
2. Every shingle is counted in one of ``COUNTERS`` counters. The counts give all documents the same order of shingles, rare ones first:
   how long their lists are. A document of n shingles that needs an overlap of T keeps its first n - T + 1 + S of them, its
   short lists. Linked documents share at least 1 + S of these, whatever the order; a good order keeps shared passages out.
3. Only shingles that a second node kept too are looked at further. A node with no more than S of them links with nothing; of the others it
   drops the S most frequent ones, now by exact counts. Linked nodes still share one.
4. The smallest node of such a shingle is its hub. Each hub is a query against the nodes that share a shingle with it.
5. Links found so far give components. Two nodes of a hub's neighbourhood that are in one component need no
   comparison; the others still do. The nodes outside the neighbourhood's largest component are
   indexed, in cells, and all nodes of it are queries against them.
6. All links give the components.

Before texts are fetched into a cell, its documents meet as parity maps: each shingle flips one bit of its set's map, so the bits in which two
maps differ are no more than the shingles in which the sets differ. Documents with no possible partner in their cell leave it.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common
from tidewire.llm.components import components
from tidewire.session import durable

WORDS = 3
SIMILAR = 90
# Documents of one side of a cell, about: as maps, and as texts.
MAPS, CELL = 1024, 96
# Counters of shingles: what the tasks send and get, whatever the number of documents.
COUNTERS = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
# A null doc_id's place in the order.
NO_ID = -(1 << 63)
KNOWN: dict[bytes, int] = {}


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    A-Z are lower-cased, words end at ASCII white space; a text of fewer words is one shingle.
    """
    raw = text.encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hash, raw), np.uint64, len(raw))
    n = min(words, len(raw))
    with np.errstate(over="ignore"):
        out = np.full(len(raw) - n + 1, len(raw[:n]), np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(32))) * MIX + h[k:len(raw) - n + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def word_hash(word: bytes) -> int:
    found = KNOWN.get(word)
    if found is None:
        if len(KNOWN) > 500_000:
            KNOWN.clear()
        found = KNOWN[word] = xxhash.xxh3_64_intdigest(word)
    return found


def needed(a: int, b: int, similar: int) -> int:
    """The overlap at which sets of these sizes link: 100 * overlap >= similar * union."""
    return -(-similar * (a + b) // (100 + similar))


def spare(n: int, similar: int) -> int:
    """Shingles beyond those that a set must keep: half of the ones in which it may differ."""
    return n * (100 - similar) // 200


def kept(n: int, similar: int) -> int:
    """How many shingles a set keeps, its ``spare`` ones included."""
    return min(n, n - -(-similar * n // 100) + 1 + spare(n, similar))


def dropped(n: int, similar: int) -> int:
    """How many of them it may drop again: the spare ones of the smallest set that it may link with."""
    return spare(-(-similar * n // 100), similar)


def short_lists(hashes: np.ndarray, counts: np.ndarray, similar: int) -> np.ndarray:
    """The shingles that a set keeps: the least frequent ones by the counters, ties by hash."""
    order = np.argsort(counts[hashes & np.uint64(COUNTERS - 1)], kind="stable")
    return hashes[order[:kept(len(hashes), similar)]]


def parity(hashes: np.ndarray) -> bytes:
    """A map of a bit for each shingle or more, a power of two of them: whether an odd number of shingles falls on the bit."""
    size = max(64, 1 << (max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Maps (rows of 64-bit words) as maps of ``width`` words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (the set's hash), map (its parity map); and a row per task with its ``counts`` alone."""
    common.text_batches(docs.sparkSession)
    mask = np.uint64(COUNTERS - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = [shingles(text, words) for text in batch["text"].fillna("")]
            whole = [xxhash.xxh3_128_intdigest(f.tobytes()) for f in found]
            if found:
                counts += np.bincount((np.concatenate(found) & mask).astype(np.int64), minlength=COUNTERS)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(), "n": [len(f) for f in found], "k1": [(w >> 64) - (1 << 63) for w in whole],
                "k2": [(w & (1 << 64) - 1) - (1 << 63) for w in whole], "map": [parity(f) for f in found], "counts": None})
        if counts.any():
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": pd.array([None], "Int64"), "k1": pd.array([None], "Int64"),
                                "k2": pd.array([None], "Int64"), "map": [None], "counts": [counts.tobytes()]})

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return narrow.mapInPandas(run, "doc_id long, n long, k1 long, k2 long, map binary, counts binary")


def summed(counts: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters. The driver adds up about as many of them as the root of the number of tasks."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for one in batch["counts"]:
                total += np.frombuffer(one, np.int64)
        yield pd.DataFrame({"counts": [total.tobytes()]})

    total = np.zeros(COUNTERS, np.int64)
    for row in counts.repartition(max(1, math.isqrt(counts.count()))).mapInPandas(add, "counts binary").toLocalIterator():
        total += np.frombuffer(row["counts"], np.int64)
    return total


def keys(docs: DataFrame, words: int, similar: int, counts: np.ndarray) -> DataFrame:
    """doc_id, drop (how many keys it may drop), keys (its short lists)."""
    common.text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(text, words) for text in batch["text"].fillna("")]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "drop": [dropped(len(f), similar) for f in found],
                                "keys": [short_lists(f, counts, similar).view(np.int64) for f in found]})

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return narrow.mapInPandas(run, "doc_id long, drop int, keys array<long>")


class Index:
    """Inverted lists over a few sets: for each shingle, the sorted numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens = tokens[starts]
        self.bounds = np.append(starts, len(tokens)).tolist()
        self.owners = owners.tolist()

    def lists(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) in ``owners`` of the query's lists that aren't empty."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        hit = at[self.tokens[at] == query].tolist()
        return [(self.bounds[i], self.bounds[i + 1]) for i in hit]

    def search(self, query: np.ndarray, similar: int, skip: set[int]) -> list[int]:
        """The numbers of the sets that link with ``query``, without those in ``skip``: DivideSkip."""
        n = len(query)
        least = needed(n, -(-similar * n // 100), similar)  # T for the smallest set that may link
        found = sorted(self.lists(query), key=lambda b: b[1] - b[0])
        if len(found) < least:
            return []
        short = found[:len(found) - least + 1]
        long = found[len(found) - least + 1:]
        merged = heapq.merge(*[self.owners[a:b] for a, b in short])
        out = []
        for owner, run in groupby(merged):  # an owner's occurrences come one after the other
            if owner in skip:
                continue
            count = sum(1 for _ in run)
            enough = needed(n, self.sizes[owner], similar)
            # the longest lists last: they are the least telling
            for k, (a, b) in enumerate(long):
                if count + len(long) - k < enough:
                    break
                i = bisect_left(self.owners, owner, a, b)
                count += i < b and self.owners[i] == owner
            if count >= enough:
                out.append(owner)
        return out


def by_cell(cells: DataFrame, found: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``found`` makes of the rows of each cell, which a task holds at once."""
    common.text_batches(cells.sparkSession)
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "side", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            cell = held["cell"].to_numpy()
            ends = [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()]
            for a, b in zip([0, *ends], ends, strict=False):
                yield found(held.iloc[a:b])
            rest = held.iloc[ends[-1] if ends else 0:]  # its rows may go on in the next batch; a cell is small
        if rest is not None and len(rest):
            yield found(rest)

    return dealt.mapInPandas(run, schema)


def search_cells(cells: DataFrame, words: int, similar: int) -> DataFrame:
    """Links (a, b) between the index side (``side`` 0) and the queries (1) of each cell.

    ``cells``: cell, side, doc_id, label, text. A document links at most once to each label that it
    isn't in itself, which leaves components as they are.
    """
    def links(cell: pd.DataFrame) -> pd.DataFrame:
        found = [shingles(t, words) for t in cell["text"]]
        ids, labels = cell["doc_id"].tolist(), cell["label"].tolist()
        indexed = int((cell["side"] == 0).sum())
        out = []
        if 0 < indexed < len(ids):
            index = Index(found[:indexed])
            of: dict[int, set[int]] = {}
            for i in range(indexed):
                of.setdefault(labels[i], set()).add(i)
            for q in range(indexed, len(ids)):
                for i in index.search(found[q], similar, of.get(labels[q], set())):
                    out.append((ids[q], ids[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return by_cell(cells, links, "a long, b long")


def possible(n: np.ndarray, maps: list[bytes], label: np.ndarray, m: np.ndarray, others: list[bytes], other_label: np.ndarray, similar: int) -> np.ndarray:
    """Which sets (rows) may link with which others (columns), by sizes, maps and labels."""
    out = np.zeros((len(n), len(m)), bool)
    widths, other_widths = np.array([len(x) // 8 for x in maps]), np.array([len(x) // 8 for x in others])
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        mine = np.frombuffer(b"".join(maps[i] for i in rows), np.uint64).reshape(len(rows), w)
        for v in np.unique(other_widths):
            columns = np.flatnonzero(other_widths == v)
            theirs = np.frombuffer(b"".join(others[i] for i in columns), np.uint64).reshape(len(columns), v)
            a, b = folded(mine, min(w, v)), folded(theirs, min(w, v))
            step = max(1, 4_000_000 // (len(columns) * min(w, v)))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                size = n[part][:, None] + m[columns]
                need = -(-similar * size // (100 + similar))
                differ = np.bitwise_count(a[at:at + step, None, :] ^ b[None]).sum(axis=2, dtype=np.int64)
                out[part[:, None], columns] = ((differ <= size - 2 * need) & (need <= np.minimum(n[part][:, None], m[columns]))
                                               & (label[part][:, None] != other_label[columns]))
    return out


def sift(cells: DataFrame, known: DataFrame, similar: int) -> DataFrame:
    """Of the rows of ``cells`` (cell, side, doc_id, label) those that may have a partner there, in cells small enough for texts."""
    mapped = cells.join(known.select("doc_id", "n", "map").hint("merge"), "doc_id")

    def partners(cell: pd.DataFrame) -> pd.DataFrame:
        side = cell["side"].to_numpy()
        ids, labels, n, maps = cell["doc_id"].to_numpy(), cell["label"].to_numpy(), cell["n"].to_numpy(), cell["map"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        met = possible(n[left], list(maps[left]), labels[left], n[right], list(maps[right]), labels[right], similar)
        out = []
        left, met = left[met.any(axis=1)], met[met.any(axis=1)]
        for i in range(0, len(left), CELL):
            block = met[i:i + CELL]
            asked = np.flatnonzero(block.any(axis=0))
            for j in range(0, len(asked), CELL):
                mine = np.flatnonzero(block[:, asked[j:j + CELL]].any(axis=1))
                name = xxhash.xxh3_64_intdigest(f"{cell['cell'].iloc[0]}/{i}/{j}") - (1 << 63)
                out += [(name, 0, ids[k], labels[k]) for k in left[i:i + CELL][mine]] + [(name, 1, ids[k], labels[k]) for k in right[asked[j:j + CELL]]]
        return pd.DataFrame(out, columns=["cell", "side", "doc_id", "label"], dtype="int64")

    return by_cell(mapped, partners, "cell long, side long, doc_id long, label long")


def found_links(cells: DataFrame, known: DataFrame, text: DataFrame, words: int, similar: int) -> DataFrame:
    """Links in cells of maps; only texts with a possible partner are fetched."""
    sifted = durable(sift(cells, known, similar), "sifted")
    return durable(search_cells(sifted.join(text.hint("merge"), "doc_id"), words, similar), "links")


def pieces(count: str) -> Column:
    return F.ceil(F.col(count) / MAPS).cast("long")


def neighbours(docs: DataFrame, nodes: DataFrame, counts: np.ndarray, words: int, similar: int) -> DataFrame:
    """(hub, doc_id): the nodes of each hub's neighbourhood, without the hub."""
    # copies go before their keys are spread; hints keep what grows with the data from being broadcast
    listed = keys(docs, words, similar, counts).join(nodes.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    rows = durable(listed, "keys").select("doc_id", "drop", F.explode("keys").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    met = rows.join(often.hint("merge"), "key")
    # a document's own keys are as many as it has; the rarest come first
    rarest = met.groupBy("doc_id").agg(F.min("drop").alias("drop"), F.array_sort(F.collect_list(F.struct("often", "key"))).alias("_keys"))
    short = durable(rarest.where(F.size("_keys") > F.col("drop")).select(
        "doc_id", F.explode(F.slice("_keys", F.lit(1), F.size("_keys") - F.col("drop"))["key"]).alias("key")), "short")
    hubs = short.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return short.join(hubs.hint("merge"), "key").where("doc_id <> hub").select("hub", "doc_id").distinct()


def link(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A null text has no words; documents without words link with nothing. A null doc_id takes part as the smallest id and
    gets a null component where that is the smallest. Rows that repeat a doc_id count as linked with each other where a link reaches one of them.
    """
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    written = durable(sets(docs, words), "sets")
    known = written.where("doc_id is not null").drop("counts")
    counts = summed(written.where("counts is not null").select("counts"))
    nodes = durable(known.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "nodes")
    beside = durable(neighbours(docs, nodes, counts, words, similar), "beside")
    # only documents of some neighbourhood are looked at again
    wanted = beside.select("doc_id").union(beside.select("hub")).distinct()
    seen = durable(known.where("n > 0").join(wanted.hint("merge"), "doc_id", "left_semi"), "maps")
    sizes = beside.groupBy("hub").agg(F.count("*").alias("_n"))
    dealt = beside.join(sizes, "hub").withColumn("_cell", F.pmod(F.xxhash64("doc_id"), pieces("_n"))).drop("_n")
    members = dealt.select("hub", "_cell", F.lit(0).alias("side"), "doc_id")
    queries = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), pieces("_n") - 1)).alias("_cell")).select(
        "hub", "_cell", F.lit(1).alias("side"), F.col("hub").alias("doc_id"))
    first = members.union(queries).select(F.xxhash64("hub", "_cell").alias("cell"), "side", "doc_id", F.col("doc_id").alias("label"))
    edges = found_links(first, seen, text, words, similar)
    labels = durable(components(edges), "labels")

    known_label = beside.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "hub", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    per_label = known_label.groupBy("hub", "label").agg(F.count("*").alias("_n"))
    main = per_label.groupBy("hub").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "label")).alias("_main")).where("_main._n < _all").select(
        "hub", "_all", F.col("_main.label").alias("_label"), (F.col("_all") - F.col("_main._n")).alias("_others"))
    open_ = known_label.join(main, "hub").select(
        "*", F.pmod(F.xxhash64("doc_id"), pieces("_others")).alias("_i"), F.pmod(F.xxhash64("doc_id", F.lit(1)), pieces("_all")).alias("_j"))
    asked = open_.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), pieces("_others") - 1)).alias("_i"), "_j", F.lit(1).alias("side"), "doc_id", "label")
    indexed = open_.where("label <> _label").select("hub", "_i", F.explode(F.sequence(F.lit(0).cast("long"), pieces("_all") - 1)).alias("_j"), F.lit(0).alias("side"), "doc_id", "label")
    second = indexed.union(asked).select(F.xxhash64("hub", "_i", "_j").alias("cell"), "side", "doc_id", "label")
    more = found_links(second, seen, text, words, similar)
    final = labels if more.isEmpty() else components(edges.union(more))

    placed = nodes.join(final.select("node", F.col("component").alias("_to")), "node", "left").select(
        "k1", "k2", F.coalesce("_to", "node").alias("_component"))
    return known.join(placed, ["k1", "k2"], "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")), F.lit(NO_ID)).alias("component_id"))
