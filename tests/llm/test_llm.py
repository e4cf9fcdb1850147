"""Every operator against brute force on small tables, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from compare import duck, spark_rows, sql_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewire.llm import alignment, html, importance, language, lines, merkle, mixture, packing, quality, secrets, shards, shingle_join, urls
from tidewire.llm.components import components
from tidewire.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(30_000))
# null, empty and blank texts, ties, repeated rows, null ids and sources, a very long text
ODD = [
    (0, None, "en", "a", None), (1, "", None, "a", 0), (2, " \n\t ", "en", None, 4), (3, "One two three. Four five six!", "en", "b", 29),
    (4, "One two three. Four five six!", "en", None, 29), (4, "One two three. Four five six!", "en", None, 29), (None, "No id here at all.", "en", "a", 18),
    (None, None, None, None, None), (7, LONG, "en", "b", len(LONG)), (9, "Ünï\u00a0cödé 日本語 \U0001F600 text\r\nline\x0btwo", "de", "a", 33),
]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns carry names that operators use
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in ("size", "key", "shard", "n", "kept", "copies", "target", "line", "html")]).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def some(folder):
    return pd.read_parquet(f"{folder}/documents.parquet")


def test_tokens_match_the_tokenizer(some):
    encode, whole = packing.encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    draw = random.Random(5)
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "'s", "don't", "1", "!", "\u00a0", "日本", "_", "\r\n", "\x85", "<|endoftext|>", "\U0001F600"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(3000)] + some.text.head(60).tolist()
    assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_packing(spark, odd, none, some):
    for docs, texts in ((odd, [r[1] or "" for r in ODD]), (spark.createDataFrame(some), some.text.tolist())):
        got = packing.pack_documents(docs, TOKENIZER).toPandas()
        whole = Tokenizer.from_file(TOKENIZER)
        want = Counter()
        for t in texts:
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
            cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
            want.update((i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
        assert Counter(got[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        assert got.groupby("sequence_id").length.sum().max() <= 2048
        assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_large_ids_stay_beside_null_ones(spark, field):
    big = 2 ** 53 + 1
    docs = spark.createDataFrame([(big, "Some words here.", "en"), (None, "Other words here.", "en"), (-big, None, None)], "doc_id long, text string, lang string").coalesce(1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>text").alias("html"))
    for got in (packing.pack_documents(docs, TOKENIZER), language.identify(docs), html.extract_pages(pages, field).withColumnRenamed("page_id", "doc_id"),
                shingle_join.link(docs), merkle.fingerprints(docs), alignment.align_documents(docs, TOKENIZER, TOKEN_PIECES), importance.resample(docs, docs)):
        assert {r.doc_id for r in got.collect()} == {big, None, -big}


def test_a_plan_places_each_piece_once():
    draw = random.Random(1)
    for _ in range(30):
        counts = {draw.randint(1, 64): draw.randint(1, 9) for _ in range(draw.randint(1, 12))}
        patterns = packing.plan(counts, 64)
        used = Counter()
        for times, pattern in patterns:
            assert sum(n * k for n, k in pattern) <= 64
            used.update({n: times * k for n, k in pattern})
        assert used == Counter(counts)


def test_the_fullest_bin_is_found():
    draw = random.Random(2)
    for _ in range(100):
        left = dict(sorted({draw.randint(1, 20): draw.randint(1, 3) for _ in range(5)}.items(), reverse=True))
        first, room = next(iter(left)), draw.randint(1, 40)
        items = [n for n, c in left.items() for _ in range(c - (n == first))]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        taken = packing.fullest(left, first, room)
        assert sum(n * k for n, k in taken) == max(s for s in sums if s <= room)
        assert all(k <= items.count(n) for n, k in packing.merged(taken))


def fill(sizes: dict, order: list) -> dict:
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def test_mixture(spark, odd, none, some):
    docs = pd.concat([some[["doc_id", "text", "source"]], pd.DataFrame(ODD, columns=["doc_id", "text", "lang", "source", "n"])[["doc_id", "text", "source"]]])
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, r.source) for r in docs.itertuples()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixture.mix(frame).toPandas()
    assert Counter(got["size"]) == Counter(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert got.taken.le(2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1)).eq(0).all()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = fill(sizes, sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None])
    targets = {(r.source_size, round(r.target, 6)) for r in got.itertuples()}
    assert targets == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= 2 * g["size"].max() + 1, (size, target)
    again = mixture.mix(frame.repartition(2)).toPandas()
    assert Counter(map(str, got.itertuples(index=False, name=None))) == Counter(map(str, again.itertuples(index=False, name=None)))
    assert mixture.mix(odd).count() == len(ODD) and mixture.mix(none).count() == 0


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def reach(ids, texts, k, similar):
    found, lists, up = [sets_of(t, k) for t in texts], defaultdict(list), list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(found):
        shared = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, n in shared.items():
            if 100 * n >= similar * (len(s) + len(found[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(found[i]), least[top(i)]) for i, d in enumerate(ids)}


def near_texts(seed: int, n: int, edits: int) -> list[str]:
    draw = random.Random(seed)
    base = [f"v{draw.randint(0, 5000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"e{draw.randint(0, 10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "similar"), [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, some, words, similar):
    texts = some.text.tolist() + near_texts(1, 250, 4) + near_texts(2, 40, 2) + ["a b", "A  b", "a b c d e f g h i j", "a b c d e f g h i", "", " "]
    texts += [" ".join("abcdefghijklmnopqrstuvwxyz"[:k]) for k in range(3, 26)]
    ids = random.Random(3).sample(range(10 ** 6), len(texts))
    got = shingle_join.link(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(6), words, similar).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == reach(ids, texts, words, similar)
    assert len(got) == len(texts)


def test_join_on_odd_rows(odd, none):
    got = shingle_join.link(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 7: 7, 9: 9}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert shingle_join.link(none).count() == 0


def test_divide_skip_equals_counting():
    draw = random.Random(4)
    sets = [np.array(sorted(draw.sample(range(60), draw.randint(1, 30))), np.uint64) for _ in range(60)]
    index = shingle_join.Index(sets)
    for query in sets:
        want = {i for i, s in enumerate(sets) if 10 * len(set(s.tolist()) & set(query.tolist())) >= 5 * len(set(s.tolist()) | set(query.tolist()))}
        assert set(index.search(query, 50, set())) == want


def test_linked_sets_share_a_key():
    draw = random.Random(6)
    counts = np.array([draw.randint(0, 3) for _ in range(shingle_join.COUNTERS)])
    for similar in (80, 90):
        sets = []
        for _ in range(40):
            start = draw.sample(range(10 ** 9), draw.randint(1, 200))
            for _ in range(4):
                gone = draw.randint(0, max(0, len(start) // 9))
                sets.append(frozenset(start[gone:] + draw.sample(range(10 ** 9), draw.randint(0, len(start) // 9))))
        sets = [np.sort(np.array([x * 0x9E3779B97F4A7C15 % 2 ** 64 for x in s], np.uint64)) for s in set(sets) if s]
        short = [shingle_join.short_lists(s, counts, similar).tolist() for s in sets]
        often = Counter(k for keys in short for k in keys)
        left = []
        for s, keys in zip(sets, short, strict=True):
            met = sorted((often[k], k) for k in keys if often[k] > 1)
            left.append({k for _, k in met[:max(0, len(met) - shingle_join.dropped(len(s), similar))]})
        linked = 0
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= similar * (len(a) + len(sets[j]) - both):
                    assert left[i] & left[j]
                    linked += 1
        assert linked > 40


def test_maps_never_rule_out_a_link():
    draw = random.Random(8)
    sets = []
    for _ in range(30):
        start = draw.sample(range(2 ** 60), draw.randint(1, 300))
        sets += [np.sort(np.array(start[draw.randint(0, len(start) // 6):] + draw.sample(range(2 ** 60), draw.randint(0, len(start) // 6)), np.uint64)) for _ in range(3)]
    sets = [s for s in sets if len(s)]
    n, maps = np.array([len(s) for s in sets]), [shingle_join.parity(s) for s in sets]
    for similar in (80, 90):
        met = shingle_join.possible(n, maps, np.arange(len(sets)), n, maps, np.arange(len(sets)), similar)
        wrong = 0
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                linked = 100 * both >= similar * (len(a) + len(sets[j]) - both)
                assert met[i, j] == met[j, i] and (met[i, j] or not linked)
                wrong += met[i, j] and not linked
        assert wrong < 0.02 * len(sets) ** 2


def test_unlinked_documents_of_one_template_stay_apart(spark):
    draw = random.Random(3)
    template = [f"w{draw.randint(0, 5000)}" for _ in range(300)]
    rows = []
    for i in range(300):
        words = list(template)
        for at in draw.sample(range(300), 18):
            words[at] = f"x{draw.randint(0, 10 ** 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = shingle_join.sets(docs, 5).persist()
    nodes = written.where("n > 0").select(F.col("doc_id").alias("node"))
    counts = shingle_join.summed(written.where("counts is not null").select("counts"))
    assert counts.sum() == written.agg(F.sum("n")).first()[0]
    # the template's shingles are long lists, which nobody meets by
    assert shingle_join.neighbours(docs, nodes, counts, 5, 80).count() < 30
    written.unpersist()
    assert {r.component_id for r in shingle_join.link(docs, 5, 80).collect()} == set(range(300))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (60, 60), (200, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 60: 50, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def counts_of(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), failed


def test_quality(spark, folder, odd, none, some):
    docs, labels = spark.createDataFrame(some), spark.read.parquet(f"{folder}/labels.parquet")
    forest = quality.fit(docs, labels)
    texts = some.text.tolist() + [r[1] for r in ODD] + ["a a a a", "x y z x y z " * 20, "l\nl\nl\n \n \nm"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.judge(frame, forest).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts_of(t), t
    assert not (got.kept & got.base_failed).any() and (got.kept | got.base_failed | (got.score < 0.5)).all()
    assert quality.judge(odd, forest).count() == len(ODD) and quality.judge(none, forest).count() == 0
    empty = quality.fit(none, labels)
    assert quality.judge(frame, empty).where("not kept and not base_failed").count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    forest = quality.fit(docs, labels.where("doc_id % 2 = 0"), 1500)
    tested = quality.judge(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), forest).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (tested.kept == (tested.quality == 1)).mean() > 0.99


def test_trees_keep_to_their_constraints():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    good = ((x[:, 0] + 0.7 * np.sin(9 * x[:, 1]) + draw.normal(0, 0.3, 4000)) < 0.5).astype(float)
    forest = quality.train(x, good, [0, 1], trees=25)
    steps = np.linspace(0, 1, 60)
    for j in (0, 1):
        rows = np.repeat(draw.random((20, 1, 3)), 60, axis=1)
        rows[:, :, j] = steps
        assert (np.diff(forest.score(rows.reshape(-1, 3)).reshape(20, 60), axis=1) <= 1e-12).all()
    # flattened arrays score as a walk down the trees does
    for row in x[:50]:
        total = forest.start
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node - forest.feature.shape[1]]
        assert np.isclose(forest.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_lines(spark, odd, none):
    shared = "Shared by many sites, this is."
    rows = [(i, f"Own line number {i} here.\n{shared}\n  {shared}\t\nhi\nhi", f"s{i % 4}") for i in range(8)]
    rows += [(20, "Two sites only share this.\nx", "s1"), (21, "Two sites only share this.", None), (22, shared, "s9"), (23, None, "s9")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()}
    # lines of one word count like any other
    assert got[0] == (f"Own line number 0 here.\n{shared}\nhi", 2)
    assert all(got[i] == (f"Own line number {i} here.", 4) for i in range(1, 8))
    assert got[20][1] == got[21][1] == 0 and got[22] == ("", 1) and got[23] == (None, 0)
    nulls = [(None, "Line of three sites.\nown a", f"s{i}") for i in range(2)] + [(2, "Line of three sites.\nx", "s2"), (3, "Line of three sites.", "s3"), (None, "only null\nown", "s1"),
             (None, "only null\nelse", "s2"), (None, "only null", "s3")]
    got = Counter(map(tuple, lines.dedup_lines(spark.createDataFrame(nulls, "doc_id long, text string, source string").repartition(3)).collect()))
    assert got == Counter({(None, "own a", 1): 2, (2, "Line of three sites.\nx", 0): 1, (3, "", 1): 1, (None, "only null\nown", 0): 1, (None, "only null\nelse", 0): 1, (None, "only null", 0): 1})
    assert lines.dedup(odd).count() == len(ODD) and set(odd.columns) < set(lines.dedup(odd).columns)
    assert lines.dedup(none).count() == 0


def test_pipeline_counts_short_lines(spark, folder):
    rows = [(i, f"Own line number {i} here.\nLes.\n \nAnd ornd.\n\nhi {i}", "en", f"s{i % 3}", 0) for i in range(6)] + [(9, "Du.\nDu.", "en", "s0", 7), (10, "Du.", "en", "s1", 3)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), folder).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"Own line number {i} here.\n \n\nhi {i}" for i in range(1, 6))
    assert got[9] == "Du.\nDu." and got[10] == "Du."


def test_exact_counts_decide_near_the_threshold(spark):
    draw = random.Random(3)
    rows = [(d, f"line {k} of them", f"s{s}") for d, (k, s) in enumerate((k, s) for k in range(40) for s in draw.sample(range(400), 80 + k))]
    cut = spark.createDataFrame(rows, "doc_id long, line string, site string").select("doc_id", "site", lines.line_key(F.col("line")).alias("key"), "line")
    found = lines.boilerplate(cut.drop("line"), 100).join(cut, "key").select("line").distinct().collect()
    assert {r.line for r in found} == {f"line {k} of them" for k in range(20, 40)}


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def ruled(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, folder):
    page_urls = pd.read_parquet(f"{folder}/pages.parquet").url.tolist()
    page_urls += [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?y#z", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://xcom/", "http://com/",
                  "http://example.com", "a://b://c.net/es/1", "http://É.NET/fr/"]
    rules = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(page_urls)], "page_id long, url string"), rules).collect()
    assert len(got) == len(page_urls)
    for r in got:
        host, path, rule = ruled(page_urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, RULES.get(rule, "allow"))


def test_mined_rules_equal_counting(spark):
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        host = draw.choice(["casino-win.org", "blog.garden.org", "news.org", "free-bets.org"])
        bad = ("casino" in host or (host == "news.org" and i % 2 == 0)) and draw.random() < 0.95
        rows.append((f"http://{host}/{'offers' if i % 2 == 0 else 'posts'}/{i}", bad))
    rules = urls.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert rules
    words = [(set(re.findall(r"[a-z]+", u)), b) for u, b in rows]

    def fits(rule, w):
        return all({t[2:] for t in item.split(" ")} & w for item in rule.antecedent)

    for r in rules:
        hits = [b for w, b in words if fits(r, w)]
        assert len(hits) >= 25 and abs(sum(hits) / len(hits) - r.confidence) < 1e-9 and r.confidence >= urls.CONFIDENCE
        assert abs(r.support - sum(hits) / len(rows)) < 1e-9 and r.filed in r.antecedent
    # every combination of up to three tokens that is frequent and reliable enough is fitted by some rule
    for k in (1, 2, 3):
        for need in map(set, itertools.combinations(sorted(set().union(*(w for w, _ in words))), k)):
            hits = [b for w, b in words if need <= w]
            if sum(hits) >= 25 and sum(hits) >= urls.CONFIDENCE * len(hits):
                assert any(fits(r, need) for r in rules)
    got = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"), urls.mine(spark.createDataFrame(rows, "url string, bad boolean")))
    fitted = {i for i, (w, _) in enumerate(words) if any(fits(r, w) for r in rules)}
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == fitted


def test_long_urls_of_one_site_are_one_item(spark):
    path = "/".join(f"word{i}" for i in range(40))
    rows = [(f"http://bad.org/{path}/{i}", True) for i in range(30)] + [(f"http://good.org/x{i}", False) for i in range(60)]
    rules = urls.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert 1 <= len(rules) <= 3 and any(len(item.split(" ")) > 40 for r in rules for item in r.antecedent)
    # support is a count: the same site is a rule among many more urls
    more = rows + [(f"http://other{i % 300}.org/y", False) for i in range(60_000)]
    assert {tuple(r.antecedent) for r in urls.mine(spark.createDataFrame(more, "url string, bad boolean")).collect()} >= {tuple(r.antecedent) for r in rules if "s:http" not in r.antecedent}


def test_tokens_of_numbers_and_other_scripts(spark):
    row = spark.range(1).select(urls.tokens(F.lit("http://163.com/новости/12?q=日本")).alias("a"), urls.tokens(F.lit("no scheme")).alias("b")).first()
    assert row.a == ["h:163", "h:com", "p:новости", "q:q", "q:日本", "s:http"] and row.b == []


def test_odd_urls(spark, none):
    odd_urls = [(1, "http://a.net/es/1", "x", "y"), (1, "http://a.net/es/1", "x", "y"), (None, None, None, None), (2, "", "", "")]
    table = spark.createDataFrame(odd_urls, "page_id long, url string, host string, verdict string")
    rules = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = urls.judge(table, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter({(1, "a.net", "/es/1", "net/es/", "block"): 2, (None, "", "", None, "allow"): 1, (2, "", "", None, "allow"): 1})
    assert urls.judge(table.limit(0), rules).count() == 0


def test_shards(spark, odd, none, some):
    rows = spark.createDataFrame(some).union(spark.createDataFrame(some.head(60))).repartition(7)
    got = shards.shard_documents(rows).toPandas()
    sizes = got.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(sizes) == 16 and sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["max"] + 1 == sizes["size"]).all() and (sizes["nunique"] == sizes["size"]).all()
    by_id = some.set_index("doc_id").text
    for r in got.itertuples():
        raw = by_id[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    source = got.merge(some[["doc_id", "source"]]).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (source.max(axis=1) - source.min(axis=1)).max() <= 2
    again = shards.shard_documents(rows.repartition(2)).toPandas()
    assert Counter(zip(got.doc_id, got.shard, strict=True)) == Counter(zip(again.doc_id, again.shard, strict=True))
    assert sorted(r.size for r in shards.shard_documents(odd).collect()) == sorted(len((r[1] or "").encode()) + 1 for r in ODD)
    assert shards.shard_documents(none).count() == 0


def test_merkle(spark, odd, none, some):
    got = merkle.fingerprints(spark.createDataFrame(some).repartition(5)).toPandas().sort_values("doc_id").reset_index(drop=True)
    ordered = some.sort_values("doc_id").reset_index(drop=True)
    texts = ordered.text.tolist()
    follows = texts[1:] + texts[:1]
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, follows, strict=True)]
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    by_text = dict(zip(texts, got.fingerprint, strict=True))
    assert all(by_text[t] == f for t, f in zip(texts, got.fingerprint, strict=True)) and len(set(by_text.values())) == len(by_text)
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > 0.65 > 0.05 > got.near_next.mean()
    assert len(merkle.fingerprints(odd).collect()) == len(ODD) and merkle.fingerprints(none).count() == 0


def tree_by_hand(text):
    """A Merkle tree as nested tuples (hash, children), made of whole hashes; leaves have no children."""
    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    def cut(paragraph):
        size = 7 if len(paragraph) < 64 else 47
        return [x for x in re.findall(rf"(?s)[^.!?]{{0,{size}}}(?:[.!?]+[ \t\n\x0b\f\r]*|[^.!?]|$)", paragraph) if x]

    def node(children):
        return md5("".join(h for h, _ in children)), children

    blank = r"\n[ \t\x0b\f\r]*\n"
    sections = [node([node([(md5(x), None) for x in cut(p)]) for p in s.split("\n")]) for s in re.split(blank, text)]
    return md5("".join(h for h, _ in sections) + "|" + "".join(map(md5, re.findall(blank, text)))), sections


def spelled_tree(tree):
    return tree[0] + "/" + ";".join(s[:16] + ":" + ",".join(p[:16] + "=" + ".".join(x[:8] for x, _ in ls) for p, ls in ps) for s, ps in tree[1])


def leaves_of(node):
    return 1 if node[1] is None else sum(map(leaves_of, node[1]))


def walk_by_hand(x, y, at_a=(), at_b=()):
    """(shared leaves, twice; edits) of two lists of children."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    mx, my = x[head:len(x) - tail], y[head:len(y) - tail]
    once = lambda of: list({n[0]: n for n in of}.values())
    moved, gone, new = [n for n in once(mx) if n in my], [n for n in once(mx) if n not in my], [n for n in once(my) if n not in mx]
    total = 2 * sum(map(leaves_of, x[:head] + x[len(x) - tail:])) + sum(map(leaves_of, moved))
    edits = [("moved", (*at_a, x.index(n)), (*at_b, y.index(n))) for n in moved]
    for o, n in zip(gone, new, strict=False):
        here = (*at_a, x.index(o)), (*at_b, y.index(n))
        if o[1] is None:
            edits.append(("replaced", *here))
        else:
            inner, more = walk_by_hand(o[1], n[1], *here)
            total += inner
            edits += more
    edits += [("deleted", (*at_a, x.index(n)), None) for n in gone[len(new):]] + [("inserted", None, (*at_b, y.index(n))) for n in new[len(gone):]]
    return total, edits


def likeness_by_hand(a, b):
    if a[0] == b[0]:
        return 1.0
    total = leaves_of(a) + leaves_of(b)
    return min(walk_by_hand(a[1], b[1])[0] / total, 1 - 1 / (total + 1)) if total else 0.0


def test_trees_equal_brute_force(spark, some):
    draw = random.Random(12)
    sentences = ["One. ", "Two words! ", "A somewhat longer sentence that runs on for more than a piece. ", "x", "é😀. ", "Three? ", ""]
    texts = ["", "\n", "\n\n", " \n \n", "a", *some.text.tolist()[:20]]
    for _ in range(150):
        parts = [[["".join(draw.choice(sentences) for _ in range(draw.randint(0, 4)))] for _ in range(draw.randint(1, 4))] for _ in range(draw.randint(1, 4))]
        texts.append(draw.choice(["\n\n", "\n \n"]).join("\n".join(p[0] for p in s) for s in parts))
        other = [list(map(list, s)) for s in parts]
        for _ in range(draw.randint(0, 3)):
            s = draw.choice(other)
            change = draw.randint(0, 3)
            if change == 0:
                s.pop(draw.randrange(len(s))) if len(s) > 1 else None
            elif change == 1:
                s.insert(draw.randint(0, len(s)), ["New here. "])
            elif change == 2:
                draw.shuffle(s)
            else:
                draw.shuffle(other)
        texts.append("\n\n".join("\n".join(p[0] for p in s) for s in other))
    pairs = [(t, texts[i ^ 1]) for i, t in enumerate(texts[:len(texts) // 2 * 2])]
    printed = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select(
        "i", merkle.fingerprint("a").alias("a"), merkle.fingerprint("b").alias("b"))
    kinds = Counter()
    for r in printed.select("*", merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.edits(F.col("a"), F.col("b")).alias("edits")).collect():
        a, b = map(tree_by_hand, pairs[r.i])
        assert (r.a, r.b) == (spelled_tree(a), spelled_tree(b))
        assert r.near == pytest.approx(likeness_by_hand(a, b), abs=1e-12)
        want = [] if a[0] == b[0] else walk_by_hand(a[1], b[1])[1]
        assert sorted((e.kind, e.a and tuple(e.a), e.b and tuple(e.b)) for e in r.edits) == sorted(want), pairs[r.i]
        kinds.update(e.kind for e in r.edits)
    assert set(kinds) == {"replaced", "moved", "deleted", "inserted"}


def test_a_tree_locates_edits(spark):
    a = "First part. Two sentences.\nSecond paragraph here.\n\nAnother section.\nIts last line."
    cases = {
        "Another section.\nIts last line.\n\nFirst part. Two sentences.\nSecond paragraph here.": [("moved", [0], [1]), ("moved", [1], [0])],
        "First part. Two sentences.\n\nAnother section.\nIts last line.": [("deleted", [0, 1], None)],
        a + "\nMore.": [("inserted", None, [1, 2])],
        a.replace("\n\n", "\n \n"): [],
        a: [],
    }
    rows = spark.createDataFrame([(a, b) for b in cases], "a string, b string").select("b", merkle.fingerprint("a").alias("x"), merkle.fingerprint("b").alias("y"))
    for r in rows.select("b", merkle.edits(F.col("x"), F.col("y")).alias("e"), merkle.likeness(F.col("x"), F.col("y")).alias("near")).collect():
        assert sorted((e.kind, e.a, e.b) for e in r.e) == cases[r.b]
        assert (r.near == 1.0) == (r.b == a) and 0 < r.near <= 1


def test_following_wraps_and_passes_empty_ranges(spark):
    ids = [5, 1, 1, 900, 44, 10 ** 15, -3]
    got = dict(merkle.following(spark.createDataFrame([(i,) for i in ids], "_key long")).collect())
    ordered = sorted(set(ids))
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_language(spark, odd, none, some):
    got = language.identify(spark.createDataFrame(some)).toPandas().merge(some, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in language.identify(odd).collect() if r.doc_id is not None}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[3].lang_pred == "en"
    assert language.identify(none).count() == 0
    assert all(r.lang_pred == "und" for r in language.predict(odd, None).collect())


def test_words_do_not_depend_on_neighbouring_texts():
    greek = "ΟΔΟΣ ΣΑΣ όλος"
    alone, beside = language.words_of([greek]), language.words_of([greek, "İstanbul"])
    assert beside.grams[:len(alone.grams)].tolist() == alone.grams.tolist()


def test_spans_of_a_mixed_text(spark, some):
    model = language.train(spark.createDataFrame(some))
    by = {k: max(g.text, key=len)[:400] for k, g in some.groupby("lang")}
    for a in by:
        for b in by:
            text = by[a] + "\n" + by[b]
            if a != b:
                names, _, spans = language.label(model, [text, "", "12 34"])
                assert names[1:] == ["und", "und"] and {s["lang"] for s in spans[0]} >= {a, b}
                right = sum(max(0, min(s["end"], 400) - s["start"]) for s in spans[0] if s["lang"] == a)
                assert right > 340


def test_script_leaves_only_languages_that_use_it(spark):
    docs = [("hello there you all", "en"), ("привет вам всем друзья", "ru"), ("здраво свима вама", "sr"), ("zdravo svima vama ovde", "sr")] * 5
    model = language.train(spark.createDataFrame(docs, "text string, lang string"))
    names, _, _ = language.label(model, ["qqq", "щщщ", "日本"])
    assert names[0] in ("en", "sr") and names[1] in ("ru", "sr") and names[2] in ("en", "ru", "sr")


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(2)
    for _ in range(20):
        counts = draw.integers(0, 6, 4)
        scores = draw.normal(0, 2, (int(counts.sum()), 3)).astype(np.float32)
        got, at = language.viterbi(scores, counts, 1.5), 0
        for n in counts:
            own = scores[at:at + n]
            paths = [[]]
            for _ in range(n):
                paths = [[*p, k] for p in paths for k in range(3)]
            value = lambda p, own=own: sum(own[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
            assert np.isclose(value(got[at:at + n].tolist()), max(map(value, paths)), atol=1e-4)
            at += n


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site name</a></header>
<div class="cookie-notice">We use cookies, as everyone does. Accept?</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div id=content><h1>A fine heading</h1><p>First &amp; longest paragraph of the article, with commas, words,
and   spaces that collapse.<p>Second paragraph &eacute; follows<br>here, also long enough to be text.</p><div class=ad>Buy now, cheap things.</div>
<p>Third paragraph ends the article, as it should, with a full stop.</p></div><script>var x = "<p>no</p>";</script>
<aside><h3>Read more</h3><p>Other stories you may like.</p></aside><form><p>Name please</p><input></form>
<section class="comments"><h3>Comments</h3><p>I disagree with all of this, said a reader.</p></section><footer><p>&copy; 2020 Us.</p></footer></body></html>"""


@pytest.fixture(scope="module")
def field(spark, folder):
    pages, docs = spark.read.parquet(f"{folder}/pages.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    return html.fit(pages.select(F.regexp_extract("url", r"/(\d+)[^/\d]*/?(?:[?#].*)?$", 1).cast("long").alias("doc_id"), "html"), docs)


def test_main_text_of_an_unseen_layout(field):
    assert html.extract(PAGE, field).split("\n\n") == [
        "A fine heading", "First & longest paragraph of the article, with commas, words, and spaces that collapse.",
        "Second paragraph é follows here, also long enough to be text.", "Third paragraph ends the article, as it should, with a full stop."]


def test_missing_ends_keep_the_text():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<html><head><title>T</title><style>p {}</style><body><article><p>One.<p>Two.</article>") == ["One.", "Two."]
    assert texts("<head><title>T</title><meta name=x><p>One.") == ["One."]
    for name in "button option object canvas noscript select svg".split():
        assert texts(f"<div>Before <{name} class=x>inside<p>One.</p></div><p>Two.</p>") == ["Before", "One.", "Two."]
        assert texts(f"<div><{name}>inside</div>One.<{name}>more</{name}> Two.<p>Three.") == ["One. Two.", "Three."]
        assert texts(f"<p>One <{name}><p>in</p></{name}> two.</p>") == ["One two."]
    assert texts("<p>One <select><option>a<option>b</select> two <object>a<object>b</object>c</object>three.") == ["One two three."]
    assert texts("<p>One <button>a<button>b</button> two.") == ["One two."]
    assert texts("<button>" * 20_000 + "<svg>" * 20_000 + "<p>One.") == ["One."]


def test_main_text_of_the_pages(spark, folder, field):
    raw = pd.read_parquet(f"{folder}/pages.parquet").set_index("page_id").html
    got = html.extract_pages(spark.read.parquet(f"{folder}/pages.parquet"), field).collect()
    right = 0
    for r in got:
        inside = re.search(r"(?s)<article>(.*?)(</article>|\Z)", raw[r.page_id])[1]
        want = [" ".join(html.html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inside)]
        right += r.text == "\n\n".join(w for w in want if w)
        assert r.n_chars == len(r.text)
    assert right >= 0.98 * len(got) and len(got) == len(raw)


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (None, "u", "plain"), (5, "u", "<div>" * 3000 + "deep" + "</p>" * 10), (6, "u", "<!-- open"), (7, "u", "<script>open"), (1, "u", None)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), field).collect()
    assert len(got) == len(rows) and all(r.text == "" for r in got if r.page_id in (1, 2, 6, 7))
    clashing = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("text", "n_chars", "doc_id")])
    assert html.extract_pages(clashing, field).columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract_pages(clashing.limit(0), field).count() == 0


def test_quotes_open_values_after_equal_signs_only():
    assert [b.text for b in html.blocks("<p title=don't>one</p><p title='a>b' x=\"c>d\">two</p><p it's>three's</p><p title=\"open>four</p>")] == ["one", "two", "three's", "four"]


def test_deep_nesting_takes_linear_time():
    took = []
    for n in (4_000, 40_000):
        start = time.perf_counter()
        found = html.blocks("<article>" + "<div class='content'>" * n + "deep" + "</div>" * n + "after</article>" + "</nav>" * n + "end")
        took.append(time.perf_counter() - start)
        assert [b.text for b in found] == ["deep", "after", "end"]
        assert [(b.last, set(b.above)) for b in found] == [("div", {"article", "div", ".main"}), ("article", {"article"}), ("body", set())]
    assert took[1] < 40 * took[0]


def test_decoding_equals_all_labellings():
    draw = np.random.default_rng(3)
    for _ in range(50):
        trial = html.Field(draw.normal(size=len(html.FEATURES)), draw.normal(size=(2, 2)))
        found = [draw.choice(len(html.FEATURES), 4, replace=False).tolist() for _ in range(int(draw.integers(1, 7)))]
        value = lambda z, trial=trial, found=found: sum(trial.weight[f].sum() for f, k in zip(found, z, strict=True) if k) + sum(trial.step[int(a), int(b)] for a, b in zip(z, z[1:], strict=False))
        every = [[bool(k >> i & 1) for i in range(len(found))] for k in range(2 ** len(found))]
        assert np.isclose(value(trial.decode(found)), max(map(value, every)))


def features_of(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def drawn_by_hand(rows, target, longest=1, buckets=10_000, percent=10):
    """{row: (n_features, weight, score, rank)} for rows (doc_id, text)."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features_of(t, longest)[1])

    s, t = counts(r[1] for r in rows), counts(target)
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = {}
    for i, (key, text) in enumerate(rows):
        found = [gain[zlib.crc32(f.encode()) % buckets] for f in features_of(text, longest)[1]]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    enough = sorted((i for i, r in enumerate(rows) if len(features_of(r[1])[0]) >= 20), key=lambda i: (-out[i][2], -1 << 63 if rows[i][0] is None else rows[i][0]))
    ranks = {i: k for k, i in enumerate(enough[:percent * len(enough) // 100], 1)}
    return Counter((rows[i][0], *v, ranks.get(i)) for i, v in out.items())


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, folder, odd, none, some, longest):
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    wanted = [r.text for r in target.collect()]
    for docs, rows in ((spark.createDataFrame(some).repartition(5), list(zip(some.doc_id.tolist(), some.text, strict=True))), (odd, [(r[0], r[1]) for r in ODD])):
        got = importance.resample(docs, target, longest, percent=40).collect()
        assert Counter(map(tuple, got)) == drawn_by_hand(rows, wanted, longest, percent=40)
    assert importance.resample(none, target).count() == 0
    assert importance.resample(odd, target.limit(0)).count() == len(ODD)


def test_the_cutoff_is_selected_exactly(spark):
    draw = random.Random(2)
    for few, size in ((1, 500), (1, 40), (7, 300)):
        rows = [(draw.randint(-3, 3) if size == 500 else draw.randint(-10 ** 9, 10 ** 9), draw.choice([-1 << 63, 5, 2 ** 62]), i) for i in range(size)]
        keys = spark.createDataFrame(rows, "loss long, doc_id long, row long").repartition(7)
        for place in (1, size // 3, size):
            assert importance.select(keys, importance.KEY, place, few) == sorted(rows)[place - 1]


def test_a_pivot_has_a_fourth_on_either_side():
    draw = random.Random(9)
    for _ in range(200):
        parts = [np.array([[draw.randint(0, 50), draw.randint(0, 3)] for _ in range(draw.randint(1, 30))]) for _ in range(draw.randint(1, 9))]
        everything = sorted(tuple(map(int, k)) for p in parts for k in p)
        for p in parts:
            assert importance.median(p) == sorted(map(tuple, p.tolist()))[(len(p) - 1) // 2]
        pivot = importance.Side(len(everything), [(importance.median(p), len(p)) for p in parts]).pivot()
        assert 4 * sum(k <= pivot for k in everything) >= len(everything) <= 4 * sum(k >= pivot for k in everything) + 4


def spans_by_hand(text, rules=secrets.RULES):
    out = []
    for i, rule in enumerate(rules):
        pattern = re.compile(rule.pattern, re.A)
        out += [(m.start(), i, rule.kind, m.end()) for m in pattern.finditer(text or "") if len(m[rule.group]) >= rule.least]
    return sorted(out)


def spelled_spans(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def random_secrets(n, seed=1):
    draw = random.Random(seed)
    parts = ["password", "API_KEY", "apikey", "Secret", "tokens", "token", "=", " : ", "\"", "'", ":", "= ", "abcdefgh", "short", "AKIA", "AKIAABCDEFGHIJKL", "AKIAABC", "a1" * 16,
             "a1" * 15, "deadbeef" * 9, "\n", "\U0001F600", "é", " ", "ſecret", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", ".", "x/+y==zz9"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_base_rules_are_the_given_ones():
    given = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.A), 2, 8),
             (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]
    for text in random_secrets(3000):
        want = sorted((m.start(), i, secrets.BASE[i].kind, m.end()) for i, (p, group, least) in enumerate(given) for m in p.finditer(text) if len(m[group]) >= least)
        assert spans_by_hand(text, secrets.BASE) == want


def test_secrets(spark, tmp_path, odd, none, some):
    texts = random_secrets(400)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])] + [(None, texts[0]), (3, texts[3])], "doc_id long, text string").repartition(5)
    for k, (docs, rows) in enumerate(((table, [(r.doc_id, r.text) for r in table.collect()]), (odd, [(r[0], r[1]) for r in ODD]),
                                      (spark.createDataFrame(some), list(zip(some.doc_id.tolist(), some.text, strict=True))))):
        want = Counter()
        for key, text in rows:
            spans = spans_by_hand(text)
            base = [s for s in spans if s[1] < 3]
            kinds = Counter(s[2] for s in spans)
            want[key, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(spelled_spans(base).encode()).hexdigest(), spelled_spans(spans)] += 1
        assert Counter(map(tuple, secrets.scan_documents(docs, str(tmp_path / f"ledger{k}")).collect())) == want
    assert secrets.scan_documents(none, str(tmp_path / "none")).count() == 0


def test_a_ledger_scans_each_pair_once(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "nothing"), (3, "password=abcdefgh1")], "path long, text string")
    second = spark.createDataFrame([(1, "AKIAABCDEFGHIJKL here"), (2, "nothing"), (4, "password=abcdefgh1")], "path long, text string")
    old, new = secrets.BASE[:1], (secrets.BASE[0], secrets.BASE[1])

    def scans():
        return sorted((r.scan, sorted(r.scanned)) for r in ledger.table().collect())

    ledger.scan(first, old)
    assert scans() == [("1", ["assign@1"])] * 2
    history = ledger.scan(second, new).union(ledger.scan(first, new))
    # the new rule meets known blobs, the new blob meets both, and what is known by both isn't looked at again
    assert scans() == [("1", ["assign@1"])] * 2 + [("2", ["access@1"])] * 2 + [("2", ["access@1", "assign@1"])]
    got = Counter((r.path, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in ledger.report(history, new).collect())
    word, key = (("assign", 0, 18),), (("access", 0, 16),)
    assert got == Counter([(1, word), (2, ()), (3, word), (1, key), (2, ()), (4, word)])
    # a changed rule is another pair, and findings of its earlier version are no longer reported
    changed = (secrets.Rule("assign", r"password=([a-z]+)", version=2, group=1, least=20),)
    assert all(not r.spans for r in ledger.report(ledger.scan(first, changed), changed).collect())
    assert sorted(r.path for r in ledger.report(ledger.scan(first, old), old).collect() if r.spans) == [1, 3]


def aligned_by_hand(rows):
    """Counter of the columns of the query, by sets of bytes and pairs in plain loops."""
    whole = Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=TOKEN_PIECES)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    found = []
    for _, text in rows:
        a = [(i, bytes(letters[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i in model.encode(text or "") for p in [model.id_to_piece(i)]]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        sides = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            sides.append(out)
        found.append(sides)
    links = [[(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] for a, b in found]
    docs = Counter(p for one in links for p in set(one))
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    out = Counter()
    for (key, _), (a, b), pairs in zip(rows, found, links, strict=True):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        spelled, shared, start = [], 0, 0
        for end in ends:
            x, y = ([str(i) for i, s, e in side if s >= start and e <= end] for side in (a, b))
            spelled.append(",".join(x) + "|" + ",".join(y))
            shared += len(x) * len(y)
            start = end
        out[key, len(a), len(b), len(ends), len(pairs), sum(docs[p] == most[p[0]] for p in pairs), sum(docs[p] for p in pairs),
            hashlib.sha256(";".join(spelled).encode()).hexdigest() if a else "", shared] += 1
    return out


def test_alignment(spark, odd, none, some):
    draw = random.Random(7)
    parts = [" ", "a", "the", "\n", "\t", "é", "'s", "don't", "1234", "!", " ", "日本", "_", "<|endoftext|>", "<s>", "\U0001F600", "▁", "ﬁ", "naïve", "  "]
    mixed = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))) for i in range(150)]
    short = [(r[0], r[1] if r[1] is None or len(r[1]) < 10_000 else r[1][:900]) for r in ODD]
    real = [(k, t[:1500]) for k, t in zip(some.doc_id.tolist()[:40], some.text, strict=False)]
    for rows in (mixed, short, real):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = aligned_by_hand(rows)
        for frequent in (10, 100_000):
            got = alignment.align_documents(docs, TOKENIZER, TOKEN_PIECES, frequent)
            assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
            assert Counter(map(tuple, got.collect())) == want
        groups = alignment.alignments(docs, TOKENIZER, TOKEN_PIECES).collect()
        assert len(groups) == sum(r[3] * n for r, n in want.items())
        assert all(g.end > g.start and g.a_ids and g.b_ids for g in groups)
    assert alignment.align_documents(odd, TOKENIZER, TOKEN_PIECES).count() == len(ODD)
    assert alignment.align_documents(none, TOKENIZER, TOKEN_PIECES).count() == 0


def test_products_equal_dense_ones():
    draw = np.random.default_rng(4)
    for block in (1, 5, 1000):
        a, b = (draw.random((9, 7)) < 0.4, draw.random((7, 8)) < 0.4)
        rows = [alignment.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1]) for m in (a, b)]
        dense = np.zeros((9, 8), int)
        for i, j, value in alignment.product(*rows, block):
            dense[i, j] += value
        assert (dense == a.astype(int) @ b.astype(int)).all()
        assert (alignment.product_sizes(*rows) == (a.astype(int) @ b.astype(int)).sum(axis=1)).all()
        turned = rows[0].transposed(7)
        assert (turned.starts == np.concatenate([[0], np.cumsum(a.sum(axis=0))])).all() and (turned.columns == np.nonzero(a.T)[1]).all()


def test_common_ends_are_found_by_search(monkeypatch):
    draw = np.random.default_rng(5)
    for n in (0, 1, 3, 40):
        for _ in range(20):
            a, b = (np.sort(draw.integers(0, 50, draw.integers(0, n + 1))) for _ in range(2))
            assert alignment.in_both(a, b).tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    monkeypatch.setattr(np, "intersect1d", None)
    sides = alignment.byte_level(TOKENIZER), alignment.pieces_of(TOKEN_PIECES)
    assert len(alignment.align(["one two", "", "three"], *sides).group_text) >= 2


def test_pipeline_stages(spark, folder, odd, none):
    kept = {"quality rules", "n-gram Jaccard join"}
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, folder)
            if name != "best-fit packing":
                assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if name in kept:
                assert after.count() <= docs.count()
            docs = after
        docs.count()


def test_pipeline_keeps_one_of_many_copies(spark, folder, some):
    good = pd.read_parquet(f"{folder}/labels.parquet").query("quality == 1").doc_id
    copied, *others = some[some.doc_id.isin(good) & ~some.text.map(lambda t: bool(counts_of(t)[-1]))].sort_values("doc_id").itertuples(index=False)
    text = copied.text + "\n\nLes.\n" + "\n".join(f"The copied text has a line {k} of its own." for k in range(3))
    rows = [(int(d.doc_id), d.text, d.lang, d.source, int(d.n_chars)) for d in others]
    rows += [(10_000 + i, text, copied.lang, f"site{i % 5}", len(text)) for i in range(40)]
    docs, out = spark.createDataFrame(rows, DOCS).repartition(4), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas())
        out[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sum(i >= 10_000 for i in out["quality rules"]) == 40
    assert [i for i in out["line dedup"] if i >= 10_000] == [i for i in out["n-gram Jaccard join"] if i >= 10_000] == [10_000]
    assert {i for i in out["best-fit packing"] if i >= 10_000} <= {10_000}
    docs = spark.createDataFrame([(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", "en", "b", 3)], DOCS)
    assert corpus_pipeline.line_dedup(spark, docs, folder).count() == 3


def test_near_duplicates_keep_one_row_of_a_group(spark, folder):
    near = " ".join(f"word{i}" for i in range(100))
    rows = [(1, near, "en", "a", 0), (1, near, "en", "a", 0), (1, near + " more", "en", "b", 0), (None, near, "en", "a", 0), (None, near + " again", "en", "a", 0),
            (0, "Alone.", "en", "a", 0), (None, None, None, None, None), (None, None, None, None, None), (5, "Twice.", "en", "a", 0), (5, "Other.", "en", "a", 0)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), folder).collect()
    groups = Counter((r.doc_id, "near" if r.text and r.text.startswith("word0") else r.text) for r in got)
    assert groups == Counter({(1, "near"): 1, (0, "Alone."): 1, (None, None): 2, (5, "Twice."): 1, (5, "Other."): 1})
    unique = [(i, r[1], *r[2:]) for i, r in enumerate(rows, 3)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(unique, DOCS).repartition(3), folder).collect()
    assert sorted(r.doc_id for r in got) == [3, 8, 9, 10, 11, 12]


def test_pipeline_equals_its_operators(spark, folder, some):
    base = {i: counts_of(t)[-1] for i, t in zip(some.doc_id, some.text, strict=True)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out[name] = docs.toPandas()
        docs = spark.createDataFrame(out[name])
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").quality
    kept = set(out["quality rules"].doc_id)
    assert not any(base[i] for i in kept) and all(i in kept for i, q in labels.items() if q == 1 and not base[i]) and not any(labels.get(i) == 0 for i in kept)
    deduped = out["line dedup"]
    assert len(deduped) == len(kept) and (deduped.n_chars == deduped.text.str.len()).all()
    want = reach(deduped.doc_id.tolist(), deduped.text.tolist(), 5, 80)
    single = out["n-gram Jaccard join"]
    assert set(single.doc_id) == {i for i, (_, c) in want.items() if i == c}
    mixed = out["mixing sources"].doc_id.value_counts()
    assert set(mixed.index) <= set(single.doc_id) and mixed.max() <= 2
    packed = out["best-fit packing"]
    assert packed.groupby("doc_id").start.apply(lambda s: (s == 0).sum()).to_dict() == mixed.to_dict()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("op4", "op8", "op9", "op10", "op12"))])
def test_native_queries_run_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, folder, name):
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(duck(folder), ORACLE[name])
