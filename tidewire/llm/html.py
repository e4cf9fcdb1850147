"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text without a block-level tag in between, each with the tags,
classes and ids above it. Features of a block are its ancestors and its text. The field is trained by
gradient ascent on labelled pages and decoded by Viterbi. Labelled pages are pages whose text is known; each is also laid
out anew, with menus, notices, comments and the like around and inside it, in markup that the pages at hand may not use.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import common

# Tags of HTML by what they do here.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Raw elements have no tags inside and may run to the end of the page. Other silent ones hold tags, and their end may be missing.
RAW = "script|style|title|textarea"
SILENT = "noscript|template|select|option|button|iframe|svg|math|canvas|object|datalist"
NESTED = {"template", "svg", "object"}  # silent elements that may hold others of their name
# Tags that end a silent element without an end.
BREAKS = set("html body hr hgroup h5 h6 tr td th tbody thead tfoot caption dl dt dd main fieldset legend center menu search summary".split())
# An opening tag that ends an open one of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STRUCTURE = "article main nav header footer aside form section ul ol li table figure figcaption blockquote pre h1 h2 h3 h4 p div dialog address details".split()
# Word stems in classes, ids and roles, by what they tell.
HINTS = {
    "menu": "nav menu breadcrumb pagination pager toc tabs skip search toolbar",
    "edge": "footer header masthead sidebar side aside widget rail bottom top copyright",
    "notice": "cookie consent notice banner alert popup modal overlay gdpr paywall message",
    "advert": "ad ads advert advertisement promo sponsor sponsored recommend related outbrain teaser newsletter subscribe signup",
    "reader": "comment comments reply replies respond disqus discussion feedback review",
    "social": "share social follow login form contact author bio tag tags meta byline rating",
    "main": "content article post entry main body story text prose page",
}
STEMS = {w: k for k, words in HINTS.items() for w in words.split()}
HIDDEN = re.compile(r"\bhidden\b|display:\s*none|aria-hidden=[\"']?true")
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<({RAW})(?=[\s/>])(?:[^>]*?/>|.*?(?:</\1\s*>|\Z))|<(/?)({SILENT})(?=[\s/>])([^>]*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+)(?:>|\Z)",
    re.S | re.I)
NAMES_IN = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
BREAKS |= set(STRUCTURE)
# What features say about the tags above a block.
ABOVE = [*STRUCTURE, *["." + k for k in HINTS], ".hidden"]
# Labelled pages, at most, and code points of html and text of each.
PAGES, LONGEST = 300, 30_000
STEPS, LEARNING, RIDGE = 150, 0.15, 1e-3


@dataclass
class Block:
    text: str
    above: tuple[str, ...]  # marks of the tags that it is in
    last: str  # the innermost of these tags
    linked: int  # characters inside links


def closings(tags: list[re.Match]) -> dict[int, int]:
    """Where each silent element ends that has its own closing tag, before the elements around it close."""
    ends: dict[int, int] = {}
    stack: list[list] = []
    latest: dict[str, list] = {}
    opened: Counter = Counter()
    for i, m in enumerate(tags):
        name = (m[3] or m[6] or "").lower()
        if not name or name in INLINE or name in VOID:
            continue
        if not (m[2] or m[5]):
            if not (m[4] or m[7] or "").endswith("/"):
                if m[3] and name not in NESTED and opened[name]:
                    latest[name][0] = ""  # the earlier one has no end
                    opened[name] -= 1
                latest[name] = [name, i]
                stack.append(latest[name])
                opened[name] += 1
        elif opened[name]:
            while True:
                top, start = stack.pop()
                opened[top] -= 1
                if top == name:
                    break
            if m[3]:
                ends[start] = i
    return ends


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with references decoded and white space collapsed; scripts, styles, menus of forms are no text.

    A silent element without a closing tag ends at the next block-level tag or the next element of its name. A head is no
    element of its own here: what is silent in it is so by itself, and its closing tag may be left out.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter = Counter()  # open tags by name
    above = dict.fromkeys(ABOVE, 0)  # marks of open tags
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(m for m, n in above.items() if n), stack[-1][0] if stack else "body", linked))
        parts.clear()
        linked = 0

    def pop() -> str:
        name_, marks_ = stack.pop()
        opened[name_] -= 1
        for mark in marks_:
            above[mark] -= 1
        return name_

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, until, loose = 0, -1, ""  # silent up to a tag, and in an element without an end
    tags = list(MARKUP.finditer(page))
    ends = closings(tags)
    for i, m in enumerate(tags):
        if i > until and not loose:
            say(page[at:m.start()])
        at = m.end()
        closing, name = m[5], (m[3] or m[6] or "").lower()
        if i < until or not name:
            continue
        if m[3]:
            if not m[2] and not m[4].endswith("/"):
                if loose == name:
                    loose = ""
                if i in ends:
                    until = ends[i]
                else:
                    loose = loose or name
            continue
        if loose and name in BREAKS:
            loose = ""
        if loose or name == "head":
            if not loose:
                flush()
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if closing:
            while opened[name] and pop() != name:
                pass
        elif name not in VOID and not m[7].endswith("/"):
            if name in ENDS and stack and stack[-1][0] in ENDS[name]:
                pop()
            found = marks(name, m[7])
            stack.append((name, found))
            opened[name] += 1
            for mark in found:
                above[mark] += 1
    if not loose:
        say(page[at:])
    flush()
    return out


def marks(name: str, attributes: str) -> tuple[str, ...]:
    found = [name] if name in STRUCTURE else []
    if attributes:
        for groups in NAMES_IN.findall(attributes):
            for token in TOKEN.findall("".join(groups).lower()):
                stem = STEMS.get(token)
                if stem:
                    found.append("." + stem)
        if HIDDEN.search(attributes):
            found.append(".hidden")
    return tuple(found)


TEXTUAL = ["bias", "short", "middling", "long", "mostly_link", "partly_link", "no_link", "sentence", "no_stop", "comma", "copyright", "digits",
           "capital", "first", "last", "heading"]
FEATURES = {name: i for i, name in enumerate(
    [*["in:" + a for a in ABOVE], *["at:" + a for a in ABOVE], *TEXTUAL, *["both:" + t + ":" + a for t in ("long", "short") for a in ("div", "p", "li")]])}


def features(all_blocks: list[Block]) -> list[list[int]]:
    """The features that each block has."""
    out = []
    for i, b in enumerate(all_blocks):
        n = len(b.text)
        size = "short" if n < 40 else "middling" if n < 160 else "long"
        share = b.linked / n
        last = b.last
        found = {"in:" + t for t in b.above} | {"at:" + last, "bias", size}
        found.add("mostly_link" if share > 0.6 else "partly_link" if share > 0.15 else "no_link")
        found.add("sentence" if b.text[-1] in ".!?…\"”»:" else "no_stop")
        if "," in b.text:
            found.add("comma")
        if b.text[0] == "©" or "©" in b.text[:40]:
            found.add("copyright")
        if sum(c.isdigit() for c in b.text[:100]) > 0.3 * min(n, 100):
            found.add("digits")
        if b.text[0].isupper():
            found.add("capital")
        if i == 0:
            found.add("first")
        if i == len(all_blocks) - 1:
            found.add("last")
        if last in ("h1", "h2", "h3", "h4"):
            found.add("heading")
        found.add(f"both:{size}:{last}")
        out.append(sorted(FEATURES[f] for f in found if f in FEATURES))
    return out


@dataclass
class Field:
    """Weights of features for being main text, and of the four transitions."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, found: list[list[int]]) -> list[bool]:
        """Which blocks are main text, by Viterbi."""
        (stay_out, enter), (leave, stay_in) = self.step.tolist()
        weight = self.weight.tolist()
        back, out, inside = [], 0.0, 0.0
        for i, active in enumerate(found):
            score = sum(weight[f] for f in active)
            if i:
                a, b = out + stay_out, inside + leave
                c, d = out + enter, inside + stay_in
                back.append((b > a, d > c))
                out, inside = max(a, b), max(c, d)
            inside += score
        state, states = inside > out, []
        for came in reversed(back):
            states.append(state)
            state = came[state]
        return [state, *reversed(states)] if found else []


def train(examples: list[tuple[list[list[int]], list[bool]]], steps: int = STEPS) -> Field:
    """Maximise the conditional likelihood of the labels: forward and backward over all pages at once, Adam steps."""
    examples = [e for e in examples if e[0]]
    field = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    if not examples:
        return field
    pages, longest = len(examples), max(len(f) for f, _ in examples)
    x = np.zeros((pages, longest, len(FEATURES)), np.float32)
    y, real = np.zeros((pages, longest)), np.zeros((pages, longest), bool)
    for p, (found, truth) in enumerate(examples):
        real[p, :len(found)] = True
        y[p, :len(found)] = truth
        for i, active in enumerate(found):
            x[p, i, active] = 1
    z = y.astype(int)
    pairs = real[:, 1:]
    seen = np.array([[(pairs & (z[:, :-1] == a) & (z[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    moment = [np.zeros_like(field.weight), np.zeros_like(field.step)]
    square = [np.zeros_like(field.weight), np.zeros_like(field.step)]
    total = real.sum()
    for t in range(1, steps + 1):
        score = np.zeros((pages, longest, 2))
        score[:, :, 1] = x @ field.weight
        forward, backward = score.copy(), np.zeros_like(score)
        for i in range(1, longest):
            new = np.logaddexp(forward[:, i - 1, :1] + field.step[0], forward[:, i - 1, 1:] + field.step[1]) + score[:, i]
            forward[:, i] = np.where(real[:, i, None], new, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = score[:, i + 1] + backward[:, i + 1]
            new = np.logaddexp(ahead[:, :1] + field.step[:, 0], ahead[:, 1:] + field.step[:, 1])
            backward[:, i] = np.where(real[:, i + 1, None], new, 0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        likely = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * real
        both = forward[:, :-1, :, None] + field.step + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(np.where(pairs[:, :, None, None], both, -np.inf))).sum(axis=(0, 1))
        gradients = [np.tensordot((y - likely) * real, x, 2) / total - RIDGE * field.weight, (seen - expected) / total - RIDGE * field.step]
        for k, (now, g) in enumerate(zip((field.weight, field.step), gradients, strict=True)):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            now += LEARNING * moment[k] / (1 - 0.9 ** t) / (np.sqrt(square[k] / (1 - 0.99 ** t)) + 1e-8)
    return field


def labelled(page: str, text: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page, each labelled by whether it is a line of the page's known text, or how one begins (a heading)."""
    found = blocks(page)
    lines = {" ".join(line.split()) for line in text.split("\n")}
    heads = {line[:n] for line in lines for n in (40, 50, 60, 80)} | {line[:60].strip() for line in lines}
    return found, [b.text in lines or (len(b.text) >= 8 and b.text in heads) for b in found]


# Ways to lay out a page: what wraps the main text, its paragraphs, and what else there is. {} is text.
MAINS = ["<article>{}</article>", "<main><div class='content'>{}</div></main>", "<div id='content'>{}</div>", "<div class='post-body'>{}</div>", "<div>{}</div>",
         "<main>{}</main>", "<section class='story'><div>{}</div></section>"]
PARAGRAPHS = ["<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='text'>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>"]
BEFORE = ["<header><a href='/'>{}</a></header>", "<header><div class='logo'>{}</div></header>", "<nav><ul><li><a href='#'>{}</a></li><li><a href='#'>{}</a></li></ul></nav>",
          "<div class='menu'><a href='#'>{}</a> | <a href='#'>{}</a></div>", "<div class='cookie-notice'>{}</div>", "<div class='banner'><p>{}</p></div>",
          "<div id='header'><h1>{}</h1><p>{}</p></div>", "<ul class='breadcrumb'><li><a href='#'>{}</a></li><li>{}</li></ul>", "<div class='ad'>{}</div>"]
WITHIN = ["<aside>{}</aside>", "<div class='ad'>{}</div>", "<div class='advertisement'><p>{}</p></div>", "<div class='related'><a href='#'>{}</a></div>",
          "<form action='#'><label>{}</label><input></form>", "<div class='share'><a href='#'>{}</a></div>", "<div class='newsletter'><p>{}</p></div>",
          "<figure><figcaption class='ad-label'>{}</figcaption></figure>"]
AFTER = ["<footer>&copy; {}</footer>", "<footer><p>{}</p></footer>", "<div id='footer'>{}</div>", "<aside><h3>{}</h3><p>{}</p></aside>", "<div class='sidebar'><p>{}</p><p>{}</p></div>",
         "<section class='comments'><h3>{}</h3><p>{}</p></section>", "<div id='comments'><ol><li><p>{}</p></li><li><p>{}</p></li></ol></div>",
         "<form><p>{}</p></form>", "<div class='subscribe'><p>{}</p></div>", "<div class='comment'><div>{}</div></div>"]


def laid_out(main: list[str], other: list[str], seed: int) -> tuple[list[Block], list[bool]]:
    """A page of another layout from the same texts. The rest of the page also uses sentences of other pages."""
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    notes: list[str] = []

    def fill(template: str) -> str:
        while "{}" in template:
            text = pick(other)
            notes.append(text)
            template = template.replace("{}", html.escape(text), 1)
        return template

    body = []
    for i, text in enumerate(main):
        body.append((PARAGRAPHS[0] if draw.random() < 0.7 else pick(PARAGRAPHS)).replace("{}", html.escape(text)) if i or draw.random() < 0.5
                    else "<h1>{}</h1>".replace("{}", html.escape(text)))
        if draw.random() < 0.08:
            body.append(fill(pick(WITHIN)))
    before = "".join(fill(pick(BEFORE)) for _ in range(int(draw.integers(0, 4))))
    after = "".join(fill(pick(AFTER)) for _ in range(int(draw.integers(0, 4))))
    inside = "".join(fill(pick(AFTER[5:])) for _ in range(draw.random() < 0.25))
    found = blocks("<html><body>" + before + pick(MAINS).replace("{}", "".join(body) + inside) + after + "</body></html>")
    known = {" ".join(t.split()) for t in main} - {" ".join(t.split()) for t in notes}
    return found, [b.text in known for b in found]


def fit(pages: DataFrame, texts: DataFrame, most: int = PAGES, longest: int = LONGEST) -> Field:
    """Train on at most ``most`` pages with known text: ``pages`` (doc_id, html), ``texts`` (doc_id, text).

    Those with the smallest hashes of doc_id are taken, and of those the ones of at most ``longest`` code points.
    """
    sample = pages.where((F.length("html") <= longest) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("html").alias("html")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` pages of bounded length
    rows = texts.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").collect()
    seen = [labelled(r["html"], r["text"]) for r in rows]
    other = sorted({b.text for found, truth in seen for b, t in zip(found, truth, strict=True) if not t})
    other += sorted({s.strip() + "." for r in rows for s in r["text"][:2000].split(".")[1:4] if s.strip()})
    examples = list(seen)
    if other:
        for i, (found, truth) in enumerate(seen):
            main = [b.text for b, t in zip(found, truth, strict=True) if t]
            examples += [laid_out(main, other, 2 * i + k) for k in range(2)]
    return train([(features(found), truth) for found, truth in examples])


def extract(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, main in zip(found, field.decode(features(found)), strict=True) if main)


def extract_pages(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text (main blocks, two line ends between), n_chars. A null or empty html has an empty text, a null page_id stays null."""
    common.text_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(page, field) for page in batch["html"].fillna("")]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": list(map(len, text))})

    found = pages.select(common.without_null("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
    return found.withColumn("page_id", common.with_null("page_id"))
