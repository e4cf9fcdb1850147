"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE, B a sentencepiece model. A token's bytes are a row of an incidence matrix of tokens and bytes, in
compressed sparse rows built here. The product of A's matrix with the transpose of B's, row by row as Gustavson does it, holds how many
bytes two tokens share: its entries are the overlap links. Offsets at which tokens of both end cut a text into groups, the smallest pieces
that both spell in whole tokens; the product of the two incidence matrices of tokens and groups holds the shared-group links.

Texts of a slice are one block-diagonal matrix, and products are made in blocks of rows, so memory is bounded by a slice or by one text. How many
documents link a pair of ids is counted by aggregation. The most frequent pairs, a fixed number of them, meet the documents'
pairs by broadcast, so that no task gets the rows of a pair that every document has; all other pairs meet them by a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common
from tidewire.llm.packing import WORDS
from tidewire.session import durable

# A null doc_id's place in the order.
NO_ID = -(1 << 63)
# Characters of a slice of texts, entries of a block of rows, and pairs that are broadcast.
SLICE, BLOCK, FREQUENT = 500_000, 1 << 20, 100_000
# Ids of B stay below the first, columns of a product below the second.
WIDTH, COLUMNS = 1 << 24, 1 << 31


@dataclass
class Rows:
    """A sparse matrix in compressed rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    def transposed(self, width: int) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=width))]), row[order])


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, as many as ``sizes`` says, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(first - before, sizes)


def incidence(ends: np.ndarray, sizes: np.ndarray) -> Rows:
    """Tokens and the bytes that they cover."""
    return Rows(np.concatenate([[0], np.cumsum(sizes)]), spread(ends - sizes, sizes))


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """How many terms each row of the product has: the row sizes of ``b`` that a row of ``a`` calls for."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return terms[a.starts[1:]] - terms[a.starts[:-1]]


def product(a: Rows, b: Rows, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (row, column, value) of ``a`` times ``b``, by blocks of rows of about ``block`` terms."""
    terms = np.cumsum(product_sizes(a, b))
    at, rows = 0, len(a.starts) - 1
    while at < rows:
        done = terms[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(terms, done + block, side="right")))
        called = a.columns[a.starts[at]:a.starts[end]]
        sizes = b.starts[called + 1] - b.starts[called]
        row = np.repeat(np.repeat(np.arange(at, end), np.diff(a.starts[at:end + 1])), sizes)
        column = b.columns[spread(b.starts[called], sizes)]
        key = row * COLUMNS + column
        if len(key) and (key[1:] < key[:-1]).any():
            key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        value = np.diff(np.append(heads, len(key)))
        yield key[heads] // COLUMNS, key[heads] % COLUMNS, value
        at = end


@dataclass
class Tokenizer:
    """Texts to ids, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    token: list[bytes]

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.token), np.int64, len(self.token))

    @functools.cached_property
    def spelled(self) -> list[np.ndarray]:
        """Every id in decimal, with each of the separators."""
        out = []
        for mark in (",", "|", ";", ""):
            names = np.empty(len(self.token), object)
            names[:] = [f"{i}{mark}" for i in range(len(self.token))]
            out.append(names)
        return out


@functools.cache
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file of ``tokenizers``, of texts with a space before them; special tokens in a text are plain text."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    added = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
    vocabulary = described["model"]["vocab"]
    token = [b""] * (1 + max([*vocabulary.values(), *added]))
    for name, i in vocabulary.items():
        token[i] = added[i] if i in added else bytes(letters[c] for c in name)
    ranks = {t: i for i, t in enumerate(token) if t and i not in added}
    plain = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer(lambda texts: [plain.encode_ordinary(" " + t) for t in texts], token)


@functools.cache
def pieces_of(path: str) -> Tokenizer:
    """A sentencepiece model, which adds the space itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        name = model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()

    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), [spelled(i) for i in range(model.get_piece_size())])


@dataclass
class Side:
    """One tokenizer's tokens of a slice of texts: ids, end offsets and sizes in the slice's bytes, and which text."""

    ids: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    group: np.ndarray = None


@dataclass
class Aligned:
    """A slice of texts, aligned: both sides, which text each group is of, and the overlap links by token places and shared bytes."""

    a: Side
    b: Side
    group_text: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def shared(self) -> tuple[Rows, Rows]:
        """The matrices of A's tokens and groups, and of groups and B's tokens."""
        one = [Rows(np.arange(len(s.group) + 1), s.group) for s in (self.a, self.b)]
        return one[0], one[1].transposed(len(self.group_text))


def tokens(texts: list[str], a: Tokenizer, b: Tokenizer) -> tuple[Side, Side]:
    """Both sides' tokens of the texts that both spell in full; the others have none."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    found = [x.encode(texts) for x in (a, b)]
    for i, text in enumerate(texts):
        if not text or any(b"".join(map(x.token.__getitem__, ids[i])) != raw[i] for x, ids in zip((a, b), found, strict=True)):
            for ids in found:
                ids[i] = []
    sides = []
    for x, ids in zip((a, b), found, strict=True):
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum()))
        sizes = x.sizes[flat]
        sides.append(Side(flat, np.cumsum(sizes), sizes, np.repeat(np.arange(len(ids)), counts)))
    return sides[0], sides[1]


def in_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of both ascending arrays, each once: found by search, there is nothing to hash or sort."""
    if not len(a) or not len(b):
        return a[:0]
    met = a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]
    return met[np.append(True, met[1:] != met[:-1])] if len(met) else met


def align(texts: list[str], a: Tokenizer, b: Tokenizer) -> Aligned:
    """Groups and overlap links of a slice of texts."""
    left, right = tokens(texts, a, b)
    common_ends = in_both(left.ends, right.ends)
    for side in (left, right):
        side.group = np.searchsorted(common_ends, side.ends)
    group_text = left.text[np.searchsorted(left.ends, common_ends)] if len(common_ends) else np.zeros(0, np.int64)
    width = int(left.ends[-1]) if len(left.ends) else 0
    entries = incidence(left.ends, left.sizes), incidence(right.ends, right.sizes).transposed(width)
    return Aligned(left, right, group_text, list(product(*entries)))


def spelled_groups(found: Aligned, a: Tokenizer, b: Tokenizer, texts: int) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    left, right, groups = found.a, found.b, len(found.group_text)
    before = [np.concatenate([[0], np.cumsum(np.bincount(s.group, minlength=groups))]) for s in (left, right)]
    parts = np.empty(len(left.ids) + len(right.ids), object)
    ends = np.ones(groups, bool)
    if groups:
        ends[:-1] = found.group_text[1:] != found.group_text[:-1]
    for side, x, other, shift, last in ((left, a, before[1], 0, np.full(groups, 1)), (right, b, before[0], 1, np.where(ends, 3, 2))):
        mark = np.zeros(len(side.ids), np.int64)
        closes = np.flatnonzero(np.append(side.group[1:] != side.group[:-1], True)) if len(side.ids) else np.zeros(0, np.int64)
        mark[closes] = last[side.group[closes]]
        place = np.arange(len(side.ids)) + other[side.group + shift]
        for k in range(4):
            mine = mark == k
            parts[place[mine]] = x.spelled[k][side.ids[mine]]
    counts = np.bincount(left.text, minlength=texts) + np.bincount(right.text, minlength=texts)
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    flat = parts.tolist()
    return ["".join(flat[i:j]) for i, j in zip(at, at[1:], strict=False)]


SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
          "pairs array<struct<pair: long, n: long>>")


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, the digest of the groups, and the distinct linked id pairs (pair: A's id times ``WIDTH`` plus B's) with their numbers, of every row.

    A null doc_id is ``NO_ID``. ``n_shared`` is the number of shared-group links, by the sizes of the product's rows alone.
    """
    common.text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces_of(b_path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, end in common.slices(texts, SLICE):
                part = texts[start:end]
                n = len(part)
                found = align(part, a, b)
                seen, pairs = [], []
                for i, j, _ in found.links:
                    seen.append(found.a.text[i])
                    pairs.append(found.a.ids[i] * WIDTH + found.b.ids[j])
                seen = np.concatenate([np.zeros(0, np.int64), *seen])
                pairs = np.concatenate([np.zeros(0, np.int64), *pairs])
                order = np.lexsort((pairs, seen))
                seen, pairs = seen[order], pairs[order]
                heads = np.flatnonzero(np.concatenate([[True], (seen[1:] != seen[:-1]) | (pairs[1:] != pairs[:-1])])) if len(seen) else np.zeros(0, np.int64)
                times = np.diff(np.append(heads, len(seen)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(seen[heads], minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pairs[heads]), pa.array(times)], ["pair", "n"]))
                shared = product_sizes(*found.shared()) if len(found.group_text) else np.zeros(0, np.int64)
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled_groups(found, a, b, n)]

                def counts(of: np.ndarray, weight: np.ndarray | None = None, n: int = n) -> pa.Array:
                    return pa.array(np.bincount(of, weight, n).astype(np.int64))

                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, end - start), counts(found.a.text), counts(found.b.text), counts(found.group_text), counts(seen), counts(found.a.text, shared),
                    pa.array(digests, pa.string()), lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs"])

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return narrow.mapInArrow(run, SCHEMA)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows each pair is, and whether no pair of its A id is in more."""
    counts = pairs.groupBy("pair").agg(F.count("*").alias("docs"))
    a = F.expr(f"pair div {WIDTH}")
    most = counts.groupBy(a.alias("_a")).agg(F.max("docs").alias("_most"))  # one row for each id of A
    return counts.withColumn("_a", a).join(F.broadcast(most), "_a").select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared of every row of ``docs`` (doc_id, text).

    A null or empty text, or one that a tokenizer changes, has no tokens: its numbers are 0, its digest is empty. Rows that
    repeat a doc_id, or a text, count each by itself.
    """
    found = durable(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "linked")
    pairs = found.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.n")
    counts = durable(pair_counts(pairs), "pairs")
    top = durable(counts.orderBy(F.desc("docs"), "pair").limit(frequent), "frequent")
    met = pairs.join(F.broadcast(top), "pair")
    parts = met.select("row", "n", "docs", "best")
    if counts.count() > frequent:
        rest = counts.join(F.broadcast(top.select("pair")), "pair", "left_anti")
        others = pairs.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(rest.hint("merge"), "pair")
        parts = parts.union(others.select("row", "n", "docs", "best"))
    sums = parts.groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    return found.drop("pairs").join(sums.hint("merge"), "row", "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "n_shared")


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per group of every text: doc_id, group, start and end (bytes of space and text), a_ids, b_ids.

    The tokens of a group are its shared-group links, each of A with each of B, which needn't be spelled out.
    """
    common.text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces_of(b_path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, end in common.slices(texts, SLICE):
                found = align(texts[start:end], a, b)
                groups = len(found.group_text)
                if not groups:
                    continue
                sides = []
                for side in (found.a, found.b):
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(side.group, minlength=groups))]).astype(np.int32)
                    sides.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(side.ids.astype(np.int32))))
                ends = found.a.ends[np.flatnonzero(np.append(found.a.group[1:] != found.a.group[:-1], True))]
                text = found.group_text
                opens = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                first = np.repeat(opens, np.diff(np.append(opens, groups)))
                begins = np.concatenate([[0], ends[:-1]])
                base = begins[first]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, end - start).take(pa.array(text)), pa.array((np.arange(groups) - first).astype(np.int32)),
                    pa.array(begins - base), pa.array(ends - base), *sides], ["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, group int, start long, end long, a_ids array<int>, b_ids array<int>")
