"""Language identification of mixed texts.

A word scores for each language by the letter trigrams it is made of, as counted over the whole labelled
corpus. The script of a word, by ranges of code points, leaves only languages that were seen to
use it. Viterbi then runs over a text's words with a penalty for each switch of language, and so labels spans. All texts of
a slice take a Viterbi step together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common

# First code points of script ranges; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0x20000, "Han"), (0x30000, "Other")]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])
# Trigrams share this many counters; a switch of language costs this much log-likelihood; a language uses a
# script if at least this share of its letters are of it.
BUCKETS = 1 << 14
SWITCH = 12.0
LEAST_SHARE = 0.01
SMOOTH = 0.5
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def lowered() -> np.ndarray:
    """The lower case of every code point by itself, whatever its neighbours are; of several code points the first."""
    return np.fromiter((ord(chr(c).lower()[0]) for c in range(0x110000)), np.uint32, 0x110000)


@dataclass
class Words:
    """The words of several texts: runs of letters, with their trigrams."""

    grams: np.ndarray  # bucket of each trigram; a word of n letters has n, its ends count as letters
    first: np.ndarray  # where each word's trigrams begin
    script: np.ndarray
    start: np.ndarray  # code points in the word's own text
    end: np.ndarray
    text: np.ndarray  # which text


def words_of(texts: list[str]) -> Words:
    joined = " " + " ".join(texts) + " "
    shape = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[shape]
    code = np.where(is_letter, lowered()[shape], 0).astype(np.int64)
    at = np.flatnonzero(is_letter)
    grams = (code[at - 1] * 961_748_941 + code[at] * 15_485_863 + code[at + 1] * 32_452_843)
    grams = (grams ^ (grams >> 15)) * 2_654_435_761
    grams = (grams >> 11) & (BUCKETS - 1)
    opens = ~is_letter[at - 1]
    first = np.flatnonzero(opens)
    begin = at[first]
    last = np.append(first[1:], len(at)) - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(np.concatenate([[1], sizes[:-1] + 1])) if len(texts) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, begin, side="right") - 1
    base = offsets[text] if len(text) else text
    script = SCRIPT_OF[np.searchsorted(STARTS, shape[begin], side="right") - 1]
    return Words(grams, first, script, begin - base, at[last] + 1 - base, text)


@dataclass
class Model:
    """Languages in order, log-likelihood of trigrams (buckets, languages), and which language uses which script."""

    languages: list[str]
    likelihood: np.ndarray
    uses: np.ndarray


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of documents that no model learns from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame) -> Model | None:
    """Count trigrams and scripts by language over all rows of ``docs`` (text, lang) that have both.

    The counts, at most ``BUCKETS`` + scripts for each language, are all that reaches the driver.
    """
    common.text_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                held = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                for a, b in common.slices(texts):
                    found = words_of(texts[a:b])
                    held[:BUCKETS] += np.bincount(found.grams, minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount(found.script, found.end - found.start, len(NAMES)).astype(np.int64)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": held[at]})

    counted = docs.where("text is not null and lang is not null").select("text", "lang") \
        .mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return None
    table = np.zeros((len(languages), BUCKETS + len(NAMES)))
    table[[languages.index(x) for x in counted["lang"]], counted["bucket"]] = counted["n"]
    grams, scripts = table[:, :BUCKETS] + SMOOTH, table[:, BUCKETS:]
    likelihood = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    uses = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, likelihood, uses.T)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. ``scores`` (words, labels), texts one after the other with ``counts`` words each."""
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    starts, lengths = starts[order], counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step
    labels = scores.shape[1]
    back = np.empty(scores.shape, np.int16)
    stay = np.arange(labels, dtype=np.int16)
    value = np.zeros((len(counts), labels), np.float32)
    for t in range(steps):
        k = running[t]
        at = starts[:k] + t
        v = value[:k]
        best = v.argmax(axis=1)
        jump = v[np.arange(k), best][:, None] - switch
        moved = jump > v
        back[at] = np.where(moved, best[:, None], stay)
        value[:k] = np.where(moved, jump, v) + scores[at]
    out = np.empty(len(scores), np.int64)
    label = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


def label(model: Model, texts: list[str], switch: float = SWITCH) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text.

    The language holds most letters; the score is its share of them. Words in a script that no language uses say nothing.
    """
    found = words_of(texts)
    langs = len(model.languages)
    counts = np.bincount(found.text, minlength=len(texts)) if len(found.text) else np.zeros(len(texts), np.int64)
    scores = np.zeros((len(found.first), langs), np.float32)
    if len(found.first):
        for j in range(langs):
            scores[:, j] = np.add.reduceat(model.likelihood[found.grams, j], found.first)
        known = model.uses[found.script]
        some = known.any(axis=1)
        scores = np.where(known, scores, np.float32(-1e4))
        scores[~some] = 0
    best = viterbi(scores, counts, switch)
    size = found.end - found.start
    held = np.zeros((len(texts), langs))
    np.add.at(held, (found.text, best), size)
    winner = held.argmax(axis=1)
    total = held.sum(axis=1)
    change = np.ones(len(best), bool)
    change[1:] = (best[1:] != best[:-1]) | (found.text[1:] != found.text[:-1])
    head = np.flatnonzero(change)
    tail = np.append(head[1:], len(best)) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for t, a, b, j in zip(found.text[head].tolist(), found.start[head].tolist(), found.end[tail].tolist(), best[head].tolist(), strict=True):
        spans[t].append({"start": a, "end": b, "lang": model.languages[j]})
    names = [model.languages[w] if n else UNKNOWN for w, n in zip(winner, total, strict=True)]
    share = [float(held[i, w] / total[i]) if total[i] else 0.0 for i, w in enumerate(winner)]
    return names, share, spans


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (start and end in code points, lang).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. A null doc_id stays null.
    """
    common.text_batches(docs.sparkSession)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            names, share, spans = [], [], []
            for a, b in common.slices(texts, 4_000_000):
                part = label(model, texts[a:b]) if model else ([UNKNOWN] * (b - a), [0.0] * (b - a), [[] for _ in range(b - a)])
                for all_, some in zip((names, share, spans), part, strict=True):
                    all_ += some
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": share, "spans": spans})

    found = docs.select(common.without_null("doc_id"), held_out("doc_id").alias("held_out"), "text").mapInPandas(run, schema)
    return found.withColumn("doc_id", common.with_null("doc_id"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, and predict all."""
    return predict(docs, train(docs.where(~held_out("doc_id"))))
