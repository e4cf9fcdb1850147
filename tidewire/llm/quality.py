"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of the features, with the logistic loss. Features named in ``FALLING``
may only lower the verdict as they rise: splits that would break this are not taken, and children stay
within bounds set at the split above them. A forest is flattened into numpy arrays (feature,
threshold, value by node of complete binary trees), so that scoring a batch takes one step per level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common

# The base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# At most this many labelled documents train the trees.
SAMPLE = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "sentences", "exclaims", "distinct",
            "short_words", "digits", "line_words"]
FALLING = {"symbols", "dup_lines", "repeat_words", "exclaims"}
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 3, 0.25, 64, 20, 1.0
UPPER, DIGITS = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+")


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeated, distinct = 0, n
    if n:
        hashes = np.fromiter(map(hash, raw), np.int64, n).view(np.uint64)
        distinct = len(np.unique(hashes))
    if n > 2:
        with np.errstate(over="ignore"):
            h = hashes * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            windows = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + (h[2:] ^ (h[2:] >> np.uint64(17)))
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= twice
        repeated = int(covered.sum())
    some, length = max(n, 1), max(len(text), 1)
    features = [
        np.log1p(n), chars / some, symbols / some, duplicates / max(len(lines), 1), repeated / some,
        sum(map(len, UPPER.findall(text))) / length, sum(text.count(c) for c in ".!?") / some, text.count("!") / some,
        distinct / some, sum(len(w) <= 3 for w in raw) / some, sum(map(len, DIGITS.findall(text))) / length, n / max(len(lines), 1)]
    return [n, chars, symbols, duplicates, repeated], features


@dataclass
class Forest:
    """Complete binary trees: arrays (trees, nodes) of feature and threshold, (trees, leaves) of value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is good."""
        trees, nodes = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(nodes + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.start + self.value[tree, at - nodes].sum(axis=1))))


def train(x: np.ndarray, good: np.ndarray, falling: list[int], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Grow trees on rows ``x`` with verdicts ``good`` (0 or 1); ``falling`` columns may only lower the score."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    nodes = 2 ** depth - 1
    share = (good.sum() + 1) / (len(good) + 2)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                    np.zeros((trees, nodes + 1)))
    margin = np.full(len(good), forest.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = good - p, p * (1 - p)
        at = np.zeros(len(good), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            low, high = bounds.pop(node)
            mine = np.flatnonzero(at == node)
            found = split(binned[mine], gradient[mine], hessian[mine], edges, falling, low, high)
            left = right = (low, high)
            if found:
                j, b, lower, upper = found
                forest.feature[t, node], forest.threshold[t, node] = j, edges[j][b]
                if j in falling:
                    middle = (lower + upper) / 2
                    left, right = (middle, high), (low, middle)
                at[mine] = 2 * node + 1 + (binned[mine, j] > b)
            else:
                at[mine] = 2 * node + 1
            bounds[2 * node + 1], bounds[2 * node + 2] = left, right
        for leaf in range(nodes + 1):
            mine = at == leaf + nodes
            low, high = bounds[leaf + nodes]
            if mine.any():
                forest.value[t, leaf] = RATE * np.clip(gradient[mine].sum() / (hessian[mine].sum() + RIDGE), low, high)
        margin += forest.value[t, at - nodes]
    return forest


def split(binned, gradient, hessian, edges, falling, low, high):
    """The best allowed (feature, bin, left value, right value) of a node, or None."""
    best, found = 1e-6, None
    total_g, total_h = gradient.sum(), hessian.sum()
    for j, e in enumerate(edges):
        if not len(e) or len(binned) < 2 * LEAST_LEAF:
            continue
        g, h, c = (np.bincount(binned[:, j], w, len(e) + 1).cumsum()[:-1] for w in (gradient, hessian, None))
        a, b = np.clip(g / (h + RIDGE), low, high), np.clip((total_g - g) / (total_h - h + RIDGE), low, high)
        gain = a * g - a * a * (h + RIDGE) / 2 + b * (total_g - g) - b * b * (total_h - h + RIDGE) / 2
        allowed = (c >= LEAST_LEAF) & (len(binned) - c >= LEAST_LEAF)
        if j in falling:
            allowed &= a >= b
        gain = np.where(allowed, gain, -np.inf) - total_g ** 2 / (total_h + RIDGE) / 2
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, a[k], b[k])
    return found


def with_statistics(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """Every row with its base counts, base_failed, and either the features or, given a forest, score and kept.

    A null text has no words. Other columns stay as they are; columns of these names are replaced.
    """
    common.text_batches(docs.sparkSession)
    added = [(c, "long") for c in BASE] + [("base_failed", "boolean")]
    added += [("score", "double"), ("kept", "boolean")] if forest else [(c, "double") for c in FEATURES]

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in added))
    def measure(text: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in text.fillna("")]
        counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
        features = np.array([f[1] for f in found], np.float64).reshape(-1, len(FEATURES))
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        out = pd.DataFrame(counts, columns=BASE).assign(base_failed=failed)
        if forest is None:
            return out.assign(**{c: features[:, i] for i, c in enumerate(FEATURES)})
        score = forest.score(features)
        return out.assign(score=score, kept=~failed & (score >= 0.5))

    kept_columns = docs.drop(*[c for c, _ in added])
    return kept_columns.withColumn("_measured", measure("text")).select("*", "_measured.*").drop("_measured")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Train on at most ``most`` labelled documents, those with the smallest hashes of doc_id.

    Only their statistics reach the driver. Labels without a document, and documents with null or
    conflicting labels, don't count. Without both verdicts among them the forest is empty and keeps everything.
    """
    usable = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows
    got = with_statistics(rows).select("quality", *FEATURES).orderBy("quality", *FEATURES).toPandas()
    good = got["quality"].to_numpy(np.float64)
    if len(set(good)) < 2:
        return Forest(1.0, np.zeros((1, 1), np.int64), np.zeros((1, 1)), np.zeros((1, 2)))
    return train(got[FEATURES].to_numpy(), good, [i for i, f in enumerate(FEATURES) if f in FALLING])


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    return with_statistics(docs.select("doc_id", "text"), forest).select("doc_id", *BASE, "base_failed", "kept", "score")
