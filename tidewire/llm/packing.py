"""Best-fit packing by minimum bin slack.

Documents become token sequences of at most ``size`` tokens, each document closed by the id 0. Longer
ones are cut; the first piece takes the remainder, all others are full. Pieces are then packed by
length alone, so the plan needs the histogram of lengths (at most ``size`` rows, whatever the number
of documents) and no document. A plan is a list of patterns: which lengths share a bin, and how
many bins look like that. The k-th piece of a length finds its pattern, bin and place from k.

Minimum bin slack: a bin starts with the longest length left; a subset-sum dynamic program over the
other lengths left, with bits of one integer as the reachable sums, finds the fullest feasible bin.
It is taken out as often as the counts allow, and the next bin is planned from what remains.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewire.llm import common
from tidewire.session import durable

SIZE = 2048
# Fixed value: the word pattern of this family of byte-level BPE tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids as ``tokenizers`` gives them for a byte-level BPE file, several times faster.

    The merges run in tiktoken, over the file's own vocabulary; a text that spells out an added token goes
    through ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    added = [t["content"] for t in described["added_tokens"]]
    ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in added}
    plain = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @functools.cache
    def whole() -> Tokenizer:
        return Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            ids = whole().encode(text, add_special_tokens=False).ids
        else:
            ids = plain.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32)

    return encode


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of bins, [(length, pieces in each bin)]), by minimum bin slack."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        first = next(iter(left))
        room = size - first
        pattern = [(first, 1)]
        if room:
            pattern = merged(pattern + fullest(left, first, room))
        times = min(left[n] // k for n, k in pattern)
        out.append((times, pattern))
        for n, k in pattern:
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def fullest(left: dict[int, int], first: int, room: int) -> list[tuple[int, int]]:
    """The subset of the lengths left (one ``first`` is taken) with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n, c in left.items():
        if n > room:
            continue
        many = min(c - (n == first), room // n)
        k = 1
        while many > 0:
            k = min(k, many)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            many -= k
            k *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    total = reach.bit_length() - 1
    taken = []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            taken.append((n, k))
            total -= n * k
    return taken


def merged(pattern: list[tuple[int, int]]) -> list[tuple[int, int]]:
    sums: dict[int, int] = {}
    for n, k in pattern:
        sums[n] = sums.get(n, 0) + k
    return sorted(sums.items(), reverse=True)


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence, pieces in a bin, offset of the first of them)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for n, k in pattern:
            out.setdefault(n, []).append((used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return {n: np.array(v, dtype=np.int64) for n, v in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves.

    A null text counts as empty; its piece is the closing 0 alone. Rows that repeat a doc_id are separate documents.
    """
    common.text_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].tolist(), batch["text"].fillna("").tolist(), strict=True):
                ids = np.append(encode(text), np.uint32(0)).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    end = at + ((len(ids) - at - 1) % size + 1 if at == 0 else size)
                    part = ids[at:end]
                    rows.append((key, piece, at, len(part), zlib.crc32(part.tobytes()), *[part.astype("i4")] * tokens))
                    at, piece = end, piece + 1
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return docs.select(common.without_null("doc_id"), "text").mapInPandas(cut, schema).withColumn("doc_id", common.with_null("doc_id"))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``size``; other columns stay.

    ``cut`` is read three times, so it should be a table. Pieces of one length may be a third of all: they are
    ranked in cells.
    """
    cut = cut.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(counts, size))
    split = F.array(*[F.lit(common.cells(counts.get(n, 0))) for n in range(size + 1)])
    spread = cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(split, F.col("length").cast("int"))))
    ranked = common.running(spread, ["length"], ["_cell"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
                            F.lit(1), "_rank").drop("_cell")
    schema = T.StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence = np.zeros(len(batch), np.int64)
            offset = np.zeros(len(batch), np.int64)
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            for n in np.unique(length):
                mine, spots = length == n, where[int(n)]
                spot = spots[np.searchsorted(spots[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - spot[:, 0]
                sequence[mine] = spot[:, 1] + k // spot[:, 2]
                offset[mine] = spot[:, 3] + k % spot[:, 2] * n
            # other columns pass as they are
            kept = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(kept, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.select(*cut.columns, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(pieces(docs, tokenizer_path, size), "pieces"), size)
