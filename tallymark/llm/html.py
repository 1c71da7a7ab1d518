"""Main text of web pages by a linear-chain conditional random field.

A page is read into leaf blocks, the stretches of text between block-level
tags, each with its chain of ancestors. A CRF with two labels, article and
rest, scores every block by its ancestors' tags and attribute words and by its
text (length, share of links, punctuation, place in the page) and every step
from block to block; Viterbi decoding finds the best labels of a whole page.

It is trained here, on labelled pages of three kinds: a bounded sample of the
pages whose own markup tells where the article is (``article`` or ``main``);
the blocks of these set anew into pages of other make-up, whose labels are known
by construction; and pages made in that way from sentences of this module, so
that a table in which no page has such markup gets a model too. The model, some
thousand weights, is broadcast.

Text: character references are decoded, white space inside a block becomes one
blank, blocks are trimmed and joined by a blank line, in page order.

Cases: null html is empty; no text gives an empty string. Cut-off and badly
nested pages are read as far as they go. Scripts and the like are no text, nor
are closed drawings, players and objects; an element of those that is never
closed takes nothing with it. Formulas (MathML) are text. Very long pages are read
whole, in linear time. Under one model rows are independent: repeated rows give
repeated results.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymark.llm.store import arrow_batch

#: Pages sampled to be labelled, and pages made from each.
SAMPLE, MADE = 300, 6
#: Pages made without a page, times MADE; characters of a block that may stand in a menu.
OWN, SHORT = 40, 60
EPOCHS, RATE, DECAY = 6, 0.3, 1e-4

# How HTML elements behave.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title iframe textarea".split())
#: Not text between their tags either, but not text to the page's end if left open.
INSET = frozenset("svg object canvas audio video".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
BOUNDS = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGIT = re.compile(r"\d")


@dataclass(slots=True)
class Block:
    """A leaf block: its text, ancestors as (tag, attribute words), and characters inside links."""

    text: str
    chain: tuple
    linked: int


def attribute_words(attributes: str) -> tuple[str, ...]:
    """Words of the telling attributes, in lower case; their order does not matter."""
    found: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            found.add("hidden")
        for value in values:
            found.update(w.lower() for w in _PART.findall(value))
    return tuple(sorted(found))


def raw_end(html: str, tag: str, at: int) -> int:
    """Where a raw element whose text begins at ``at`` ends: after its closing tag or with the page."""
    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
    return close.end() if close else len(html)


def inset_ends(html: str) -> dict[int, int]:
    """Where each closed inset ends, by the end of its opening tag; those left open are not in it."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in INSET}
    at = 0
    while at < len(html) and (m := _TOKEN.match(html, at)):
        at = m.end()
        tag = (m[2] or "").lower()
        if m[1] and opened.get(tag):
            out[opened[tag].pop()] = at
        elif not m[1] and tag in RAW:
            at = raw_end(html, tag, at)
        elif not m[1] and tag in INSET and not (tag == "svg" and m[3].endswith("/")):
            opened[tag].append(at)
    return out


def blocks(html: str | None) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    # Open elements: block-level ones, and inline ones whose attributes say something.
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, in_link = 0, False
    html = html or ""
    insets: dict[int, int] | None = None

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            held.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size and (m := _TOKEN.match(html, at)):
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = entities.unescape(piece) if "&" in piece else piece
                held.append(piece)
                if in_link:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                end()
            if tag in BLOCK or tag == "a":
                in_link = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            at = raw_end(html, tag, at)
            held.append(" ")
            continue
        if tag in INSET:
            insets = inset_ends(html) if insets is None else insets
            if at in insets:
                at = insets[at]
                held.append(" ")
                continue
        if tag == "br":
            held.append("\n")
        if tag in BLOCK:
            end()
            closing = CLOSES.get(tag, frozenset())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in closing:
                    del stack[i:]
                elif name in BOUNDS:
                    break
        in_link = in_link or tag == "a"
        if tag not in VOID and not m[3].endswith("/"):
            told = attribute_words(m[3]) if "=" in m[3] or "hidden" in m[3] else ()
            if told or tag in BLOCK:
                stack.append((tag, told))
    end()
    return out


def chain_features(chain: tuple) -> set[str]:
    """Features of a block's ancestors."""
    out = {"bias"}
    for tag, names in chain:
        out.add(f"t={tag}")
        for w in names:
            out.add(f"a={w}")
            out.add(f"b={w[:4]}")
    for tag, _ in chain[-2:]:
        out.add(f"n={tag}")
    return out


def text_features(block: Block, place: int, n: int) -> list[str]:
    """Features of a block's text and place."""
    text = block.text
    count = text.count(" ") + 1
    return [
        f"len={min(7, int(math.log2(count)))}",
        f"link={min(4, 4 * block.linked // max(1, len(text)))}",
        f"end={text[-1] if not text[-1].isalnum() and text[-1].isascii() else 'w'}",
        f"stops={min(4, sum(map(text.count, '.!?')))}",
        f"sign={'©' in text or '|' in text}",
        f"digits={min(3, 10 * len(_DIGIT.findall(text)) // len(text))}",
        f"first={place == 0}",
        f"last={place == n - 1}",
    ]


def features(page: list[Block]) -> list[list[str]]:
    """All features of each block."""
    return [sorted(chain_features(b.chain)) + text_features(b, i, len(page)) for i, b in enumerate(page)]


# Tags and attributes of the pages made to train on.
ARTICLE = ['article', 'main', 'div class="post-content"', 'div id="content"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div itemprop="articleBody"', 'div class="text"', 'div id="main" role="main"', 'div class="post"', 'div class="page-body"', 'div class="blog-entry"', 'div class="column main"', 'td class="column"', None, None]
REST = ['nav', 'header', 'footer', 'aside', 'form', 'menu', 'dialog', 'div class="sidebar"', 'div class="ad"', 'div class="ad-slot"', 'ins class="adsbygoogle"', 'div class="advertisement"', 'div class="advert banner"', 'div class="ads sponsored"', 'div class="cookie-notice"', 'div class="notice"', 'div class="comments"', 'section id="comments"', 'ul class="menu"', 'ol class="comment-list"', 'div class="related"', 'div class="share social"', 'div class="breadcrumbs"', 'div class="newsletter subscribe"', 'div class="popup modal"', 'div role="navigation"', 'div role="banner"', 'div role="contentinfo"', 'div role="complementary"', 'div class="promo promotion"', 'div class="pagination pager"', 'div id="header"', 'div id="footer"', 'div id="masthead"', 'div class="topbar"', 'div class="copyright"', 'div class="banner"', 'div class="site-header masthead"', 'div class="site-footer copyright"', 'div class="navbar navigation"', 'div class="widget"', 'div class="login search"', 'div class="consent gdpr privacy"', 'div class="alert message"', 'div class="toolbar topbar"', 'div class="discussion replies"', 'div class="user-comment reply"', 'div class="disclaimer legal"', 'div class="side right-column"', 'div id="secondary"', 'div class="recommended more-stories"', 'div class="tags categories"', 'div hidden']


# Words of attributes that set a part of an article apart from it.
APART = frozenset("ad ads advert advertisement sponsored promo comment comments replies related recommended share social newsletter subscribe breadcrumbs pagination cookie consent toc".split())
#: Sentences of the pages that are made without a page.
SENTENCES = [
    "The council met on Tuesday to hear what had been found in the spring, and most of those who spoke were in favour of a new bridge.",
    "Rain fell for nine days. On the tenth the river stood at the door of the mill, and the miller moved the flour to the upper floor.",
    "We measured the loss at four temperatures and found that it rises slowly at first, then much faster above sixty degrees.",
    "Add the onions when the butter begins to brown; after five minutes pour in the stock and let it simmer without a lid.",
    "She had come to the city to study law, but within a year she was painting scenery for a small theatre near the harbour.",
    "Why does the second method need fewer steps? Because it never looks at a pair twice, as the figure above shows.",
    "El tren sale a las ocho y llega antes del mediodía, si no hay nieve en el paso.",
    "Der Versuch wurde dreimal wiederholt, und jedes Mal war das Ergebnis dasselbe.",
    "Le vent avait tourné pendant la nuit, et au matin les bateaux étaient tous rentrés au port.",
]
#: What stands in menus, headers, footers and notices.
ODDMENTS = "Home|About us|Contact|Search|Sign in|Subscribe to our newsletter|All rights reserved. © The Site|Privacy policy|We use cookies. Accept|Share this|Read more: ten stories you missed|Next page|Buy one, get one free. Order today!|Great post, thank you for writing it.|Tags: travel, food|Follow us|Terms of use|Skip to content|Advertisement|3 comments".split("|")


def labelled_by_structure(page: list[Block]) -> list[int] | None:
    """1 for blocks of the article; None if the page's tags do not tell.

    The article is what stands in ``article`` or ``main``, but for parts that
    tags or attributes set apart inside it. What encloses it says nothing. A
    header inside an ``article`` holds its title.
    """
    apart = frozenset("nav aside footer form menu dialog button".split())
    labels = []
    for b in page:
        names = [t for t, _ in b.chain]
        start = names.index("article") if "article" in names else names.index("main") if "main" in names else len(names)
        told = {w for _, ws in b.chain[start + 1 :] for w in ws}
        header = "header" in names[start:] and "article" not in names
        labels.append(int(start < len(names) and not header and not apart & set(names) and not APART & told))
    return labels if any(labels) else None


def made_page(texts: list[str], others: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of other make-up from article blocks and from other texts, with its labels."""
    out: list[str] = []
    marks: list[int] = []

    def wrapped(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def rest(deep: bool) -> None:
        opening = rng.choice(REST)
        items = rng.sample(others, min(len(others), rng.randint(1, 4)))
        form = rng.choice(["p", "li", "div", "a", "span"])
        marks.extend([0] * len(items))
        tag = "div" if form in ("a", "span") else form
        heading = rng.choice(["h1", "h2", "h3", "h4"]) if rng.random() < 0.35 else tag
        inner = "".join(wrapped(tag if i else heading, f"<a href='#'>{item}</a>" if form == "a" else item) for i, item in enumerate(items))
        out.append(wrapped(opening, wrapped("div", inner) if deep else inner))

    for _ in range(rng.randint(0, 3)):
        rest(rng.random() < 0.3)
    outer = rng.choice([None, None, 'div class="container"', 'div id="page"', 'div class="wrapper"'])
    # None: the article stands in the body, or in the outer block, by itself.
    opening = rng.choice(ARTICLE)
    out.append(f"<{outer}>" if outer else "")
    out.append(f"<{opening}>" if opening else "")
    inner = rng.choice([None, None, 'div class="inner"', "section"])
    out.append(f"<{inner}>" if inner else "")
    i = 0
    while i < len(texts):
        if rng.random() < 0.12:
            points = texts[i : i + 4]
            out.append(wrapped(rng.choice(["ul", "ol"]), "".join(wrapped("li", t) for t in points)))
            marks.extend([1] * len(points))
            i += len(points)
        else:
            tag = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p"] * 8 + ["h2", "h3", "div", "blockquote", "pre"])
            out.append(wrapped(tag, texts[i]) if rng.random() < 0.8 else wrapped(tag, f"<b>{texts[i]}</b>"))
            marks.append(1)
            i += 1
        if rng.random() < 0.25:
            rest(False)
    out.append(f"</{inner.split()[0]}>" if inner else "")
    out.append(f"</{opening.split()[0]}>" if opening else "")
    out.append(f"</{outer.split()[0]}>" if outer else "")
    for _ in range(rng.randint(0, 4)):
        rest(rng.random() < 0.3)
    return blocks("<html><body>" + "".join(out) + "</body></html>"), marks


def labelled_pages(sampled: list[str], made: int = MADE) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of sampled pages and of pages made from their blocks."""
    read = [(p, labels) for p in map(blocks, sampled) if (labels := labelled_by_structure(p))]
    pool = [b.text for page, _ in read for b in page]
    out = [(features(page), labels) for page, labels in read]

    def remade(texts: list[str], short: list[str], rng: random.Random) -> None:
        for _ in range(made):
            others = [entities.escape(t) for t in rng.sample(pool, min(len(pool), 6)) + rng.sample(short, min(len(short), 8))]
            new, marks = made_page([entities.escape(t) for t in texts[: rng.randint(1, 12)]], others, rng)
            if len(new) == len(marks):
                out.append((features(new), marks))

    for page, labels in read:
        remade([b.text for b, y in zip(page, labels, strict=True) if y], [b.text for b in page if len(b.text) <= SHORT], random.Random(zlib.crc32(page[0].text.encode())))
    pool += SENTENCES
    for nth in range(OWN):
        rng = random.Random(nth)
        texts = [" ".join(rng.choices(SENTENCES, k=rng.randint(1, 4))) for _ in range(rng.randint(2, 12))]
        remade([rng.choice(SENTENCES).partition(",")[0].partition(".")[0], *texts], ODDMENTS, rng)
    return out


@dataclass(frozen=True)
class Crf:
    """Weights for the label article against the rest, and of the steps between labels."""

    weights: dict[str, float]
    steps: tuple[float, float, float, float]

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi labels of blocks whose features score so."""
        if not scores:
            return []
        s00, s01, s10, s11 = self.steps
        low, high, back = 0.0, scores[0], []
        for score in scores[1:]:
            from_low, from_high = low + s01 >= high + s11, low + s00 >= high + s10
            back.append((not from_high, not from_low))
            low, high = max(low + s00, high + s10), max(low + s01, high + s11) + score
        label = int(high > low)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Crf:
    """Maximise the regularised log-likelihood by adaptive gradient steps, page by page."""
    seen = Counter(f for rows, _ in pages for row in rows for f in set(row))
    names = sorted(f for f, n in seen.items() if n > 1)
    place = {f: i for i, f in enumerate(names)}
    data = [([np.array([place[f] for f in row if f in place]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    w, g = np.zeros(len(names)), np.full(len(names), 1e-6)
    step, h = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            rows, labels = data[k]
            emit = np.array([w[r].sum() for r in rows])
            on, pairs = marginals(emit, step)
            slope = labels - on
            flat = np.concatenate(rows)
            grad = np.bincount(flat, weights=np.repeat(slope, [r.size for r in rows]), minlength=w.size)
            at = np.unique(flat)
            d = grad[at] - decay * w[at]
            g[at] += d * d
            w[at] += rate * d / np.sqrt(g[at])
            true = np.zeros((2, 2))
            np.add.at(true, (labels[:-1], labels[1:]), 1)
            d2 = true - pairs - decay * step
            h += d2 * d2
            step += rate * d2 / np.sqrt(h)
    return Crf({f: float(w[i]) for f, i in place.items()}, tuple(map(float, step.ravel())))


def marginals(emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(article) of each block and expected counts of the steps, by forward and backward sums."""
    n = emit.size
    e = np.stack((np.zeros(n), emit), axis=1)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = e[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(forward[i - 1, 0] + step[0], forward[i - 1, 1] + step[1]) + e[i]
    for i in range(n - 2, -1, -1):
        nxt = e[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(step[:, 0] + nxt[0], step[:, 1] + nxt[1])
    total = np.logaddexp(forward[-1, 0], forward[-1, 1])
    on = np.exp(forward[:, 1] + backward[:, 1] - total)
    joint = forward[:-1, :, None] + step[None] + (e[1:] + backward[1:])[:, None, :] - total
    return on, np.exp(joint).sum(0)


def extract(html: str | None, model: Crf, cache: dict | None = None) -> str:
    """The page's main text. ``cache`` keeps the scores of ancestor chains from page to page."""
    page = blocks(html)
    weights = model.weights
    cache = {} if cache is None else cache
    scores = []
    for i, b in enumerate(page):
        score = cache.get(b.chain)
        if score is None:
            score = sum(weights.get(f, 0.0) for f in chain_features(b.chain))
            if len(cache) < 50_000:
                cache[b.chain] = score
        scores.append(score + sum(weights.get(f, 0.0) for f in text_features(b, i, len(page))))
    return "\n\n".join(b.text for b, y in zip(page, model.decode(scores), strict=True) if y)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Crf:
    """Train on at most ``sample`` pages with ``article`` or ``main``, those of least hash, and on pages made."""
    told = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    hashed = told.select("html", F.xxhash64("html").alias("h"))
    # Hashes alone are ranked; the bound is the sample-th of them. Copies of one page are one.
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = hashed.where(F.col("h") <= least).groupBy("h").agg(F.first("html").alias("html")).orderBy("h") if least is not None else hashed.limit(0)
    return train(labelled_pages([r["html"] for r in drawn.collect()]))


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page; without a model one is trained on ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    rows = pages.select("page_id", "url", "html")
    schema = StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = [extract(h, sent.value, cache) for h in batch.column("html").to_pylist()]
            yield arrow_batch(arrow, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts])

    return rows.mapInArrow(run, schema)
