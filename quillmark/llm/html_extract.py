"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser turns a page into block nodes; inline elements belong to the
block around them.  Each block gets features of its tag, its attribute tokens,
its depth, the text and link density of its subtree, and its siblings.  Boosted
regression trees give the log-odds that the block is part of the article.
Decoding then labels the whole tree at once: on every path from the root a block
is outside, then inside, then cut out, in this order only, and the labelling with
the highest total of log-odds, weighed by the text they decide on, wins.  So no
block is kept inside one that was cut out, and none is cut off from its article.

The trees are trained when the model is first needed, on a fixed set of page
layouts that this module generates with known labels (``PAGES`` of them, with a
fixed seed): no page has labels, and layouts rather than words decide.

What is hidden, by the attribute ``hidden``, by ``aria-hidden="true"`` or by a style
of ``display: none`` or ``visibility: hidden``, is no part of the text, nor is what
stands inside it.

Defined results: a null, empty or text-free page gives an empty string; broken
markup is read as far as it goes; a page is one tree in memory, however long, wide
or deep, and is read in linear time; repeated rows are extracted each; an empty
table gives an empty result; columns besides page_id, url and html are ignored,
whatever their names.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES, SEED = 600, 7
TREES, LEVELS, RATE, BINS = 60, 3, 0.2, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe svg math object canvas".split())
#: Elements whose text is never part of an article.
NEVER = RAW | frozenset("head select option datalist button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr input".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th")}
STOPS = frozenset("ul ol dl table div section article main body td th form aside nav header footer".split())
#: Attributes as HTML reads them: an unquoted value may hold quotes; a quote without its partner is a character.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|=|[^\s=>/]++(?:{_VALUE})?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
NAMED = ("id", "class", "role", "itemprop", "aria-label")
PIECE = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

GOOD = frozenset("article body content main post story entry text prose blog news page hentry lede".split())
GROUPS = [
    GOOD,
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc sitemap skip".split()),
    frozenset("footer header masthead banner copyright colophon topbar bottom legal hero logo".split()),
    frozenset("sidebar aside widget related recommended popular trending more teaser rail complementary tags".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion outbrain taboola dfp commercial".split()),
    frozenset("comment comments commentlist reply replies respond disqus discussion feedback thread reader readers".split()),
    frozenset("cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup subscription gdpr warning message toast paywall".split()),
    frozenset("share sharing social follow form search login register contact author byline meta date caption tools print email rating buttons".split()),
]
TAGS = ["p", "div", "section", "article", "main", "h1", "h2", "h3", "ul", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "dl", "body"]


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def unseen(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attrs.get("style", "")))


class Node:
    __slots__ = ("tag", "parent", "kids", "items", "groups", "own", "linked", "hidden")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]) -> None:
        self.tag, self.parent, self.kids, self.items = tag, parent, [], []
        self.own = self.linked = self.groups = 0
        self.hidden = unseen(attrs) or parent is not None and parent.hidden
        tokens = {t for k in NAMED if k in attrs for t in PIECE.findall(attrs[k].lower())}
        for k, group in enumerate(GROUPS):
            if tokens & group:
                self.groups |= 1 << k
        if parent is not None:
            parent.kids.append(self)
            parent.items.append(self)


def parse(page: str) -> list[Node]:
    """Block nodes in page order, the root first; texts stand in their nodes' items."""
    root = Node("html", None, {})
    nodes, links, veils = [root], 0, 0
    # Open blocks and, of inline elements, links and hidden ones: tag, block, whether it hides inline text.
    open_: list[tuple[str, Node, bool]] = [("html", root, False)]
    opened = Counter(["html"])
    at, size = 0, len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))

    def text(raw: str) -> None:
        if veils:
            return
        node = open_[-1][1]
        value = html.unescape(raw) if "&" in raw else raw
        node.items.append(value)
        n = len(value.strip())
        node.own += n
        if links:
            node.linked += n

    def close(upto: int) -> None:
        nonlocal links, veils
        while len(open_) > upto:
            tag, _, veil = open_.pop()
            opened[tag] -= 1
            links -= tag == "a"
            veils -= veil

    while at < size:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    if tag not in INLINE or all(t in INLINE for t, *_ in open_[k:]):
                        close(k)
                    break
            continue
        node = open_[-1][1]
        attrs = attributes(m[3]) if m[3] else {}
        if tag in INLINE:
            if tag == "br":
                node.items.append(" ")
            veil = bool(attrs) and unseen(attrs)
            if tag not in VOID and not m[3].endswith("/") and (tag == "a" or veil):
                if tag == open_[-1][0] == "a":
                    close(len(open_) - 1)
                open_.append((tag, node, veil))
                opened[tag] += 1
                links += tag == "a"
                veils += veil
            continue
        if tag == "html" or tag == "body" and opened["body"]:
            continue
        for k in range(len(open_) - 1, 0, -1):
            t = open_[k][0]
            if t == "p" or t in CLOSES.get(tag, ()):
                close(k)
                if t != "p":
                    break
            elif t in STOPS:
                break
        node = Node(tag, open_[-1][1], attrs)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            open_.append((tag, node, False))
            opened[tag] += 1
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each block."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [0] + [place[id(x.parent)] for x in nodes[1:]]
    text, linked, count, paragraphs = ([0] * n for _ in range(4))
    for i, x in enumerate(nodes):
        if x.tag not in NEVER:
            text[i], linked[i] = x.own, x.linked
        count[i], paragraphs[i] = 1, int(x.tag == "p")
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        linked[p] += linked[i]
        count[p] += count[i]
        paragraphs[p] += paragraphs[i]
    total = max(text[0], 1)
    depth, path, tags_above = [0] * n, [0] * n, [0] * n
    alike = Counter((p, x.tag) for p, x in zip(parent[1:], nodes[1:]))
    below = [0] * n
    for p, x in zip(parent[1:], nodes[1:]):
        below[p] |= x.groups
    kind = {t: k for k, t in enumerate(TAGS)}
    before = 0
    out = np.zeros((n, 22 + len(TAGS) + 3 * len(GROUPS)), np.float32)
    for i, x in enumerate(nodes):
        p = parent[i]
        if i:
            depth[i] = depth[p] + 1
            path[i] = path[p] | nodes[p].groups
            tags_above[i] = tags_above[p] | (1 << kind[nodes[p].tag] if nodes[p].tag in kind else 0)
        at, like = (len(nodes[p].kids), alike[p, x.tag]) if i else (1, 1)
        pt = max(text[p], 1)
        row = out[i]
        row[:22] = (
            depth[i], text[i], text[i] / count[i], linked[i] / max(text[i], 1), x.own, x.own / max(text[i], 1), text[i] / total, text[i] / pt, paragraphs[i], paragraphs[i] / count[i], count[i],
            at, like / max(at, 1), before / total, linked[p] / pt, paragraphs[p], text[p] / count[p], text[p] / total, tags_above[i] >> kind["article"] & 1, tags_above[i] >> kind["main"] & 1, (tags_above[i] >> kind["nav"] & 15) > 0, tags_above[i] >> kind["form"] & 1,
        )
        if x.tag in kind:
            row[22 + kind[x.tag]] = 1
        for k in range(len(GROUPS)):
            row[22 + len(TAGS) + k] = x.groups >> k & 1
            row[22 + len(TAGS) + len(GROUPS) + k] = path[i] >> k & 1
        for k in range(len(GROUPS)):
            row[22 + len(TAGS) + 2 * len(GROUPS) + k] = below[i] >> k & 1
        before += x.own if x.tag not in NEVER else 0
    return out


class Boosted:
    """Boosted regression trees of fixed depth for the logistic loss, over binned features."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        rate = float((y * weight).sum() / weight.sum())
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            leaf = np.zeros(len(y), int)
            feature, cut = np.zeros(2**LEVELS - 1, int), np.zeros(2**LEVELS - 1)
            for level in range(LEVELS):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                pick = np.zeros((width, 2), int)
                for f in range(x.shape[1]):
                    key = leaf * BINS + binned[:, f]
                    gs = np.bincount(key, g, width * BINS).reshape(width, BINS)
                    hs = np.bincount(key, h, width * BINS).reshape(width, BINS)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 2) | (ht - hl < 2)] = 0
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], pick[better, 0], pick[better, 1] = top[better], f, k[better]
                for j in range(width):
                    f, k = pick[j]
                    found = best[j] > 1e-6 and len(self.edges[f]) > 0
                    feature[first + j] = f
                    cut[first + j] = self.edges[f][min(k, len(self.edges[f]) - 1)] if found else np.inf
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[first + leaf]] > cut[first + leaf])
            value = RATE * np.bincount(leaf, g, 2**LEVELS) / (np.bincount(leaf, h, 2**LEVELS) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), int)
            for level in range(LEVELS):
                at = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[at]] > cut[at])
            score += value[leaf]
        return score


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """The best labelling of the tree in which every path is outside, inside, cut out, in this order."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    value = [float(s) * (1 + math.log1p(x.own)) for s, x in zip(score, nodes)]
    for i, x in enumerate(nodes):
        if x.tag in NEVER or x.hidden:
            value[i] = -1e9
    # Best totals of a subtree whose root is outside, inside or cut out; what is not inside counts against its log-odds.
    outside, inside, out = ([0.0] * n for _ in range(3))
    kids_any, kids_in = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        v = value[i]
        out[i] = -v + sum(out[place[id(k)]] for k in nodes[i].kids)
        outside[i] = -v + kids_any[i]
        inside[i] = v + kids_in[i]
        if i:
            p = place[id(nodes[i].parent)]
            kids_any[p] += max(outside[i], inside[i], out[i])
            kids_in[p] += max(inside[i], out[i])
    state, keep = [0] * n, [False] * n
    for i, x in enumerate(nodes):
        above = state[place[id(x.parent)]] if i else 0
        if above == 0:
            state[i] = 1 if inside[i] > max(outside[i], out[i]) else 0
        else:
            state[i] = 1 if above == 1 and inside[i] > out[i] else 2
        keep[i] = state[i] == 1
    return keep


def joined(nodes: list[Node], keep: list[bool]) -> str:
    """Texts of the kept blocks in page order, with one space for any white space and between blocks."""
    kept = {id(x) for x, k in zip(nodes, keep) if k}
    out: list[str] = []
    stack: list[object] = [nodes[0]]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(" ")
        own = id(x) in kept
        stack.append(" ")
        stack.extend(i for i in reversed(x.items) if own or isinstance(i, Node))
    return " ".join("".join(out).split())


def extract(pages: list[str], model: Boosted) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    score = model.log_odds(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        out.append(joined(t, decode(t, score[at : at + len(t)])))
        at += len(t)
    return out


# --- the layouts that the model learns from


class Layouts:
    """Generates pages; elements that carry ``data-main`` are the article's blocks."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioumnrstldk") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))).capitalize() + r.choice([".", ".", "", "?"])

    def some(self, *options: str) -> str:
        return self.r.choice(options)

    def block(self, tag: str, body: str, main: bool = False, attrs: str = "") -> str:
        return f"<{tag}{' ' + attrs if attrs else ''}{' data-main' if main else ''}>{body}</{tag}>"

    def named(self, *names: str) -> str:
        return self.some("", "") if self.r.random() < 0.1 else f'{self.some("class", "class", "id")}="{self.some(*names)}"'

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="#">{self.words(1, 4)}</a></li>' for _ in range(self.r.randint(low, high)))
        return self.block(self.some("ul", "ol"), items)

    def noise(self) -> str:
        r = self.r
        kind = r.randrange(12)
        if kind == 0:
            return self.block("nav", self.links(2, 10), attrs=self.named("menu", "navbar", "main-nav", "breadcrumb"))
        if kind == 1:
            return self.block("div", self.links(2, 10), attrs=self.named("menu", "nav", "navigation", "breadcrumbs", "pagination"))
        if kind == 2:
            return self.block(self.some("div", "aside", "section", "ins"), self.some(self.words(2, 40), self.block("p", self.words(2, 40)), f'<a href="#">{self.words(2, 12)}</a>'), attrs=self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot banner"))
        if kind == 3:
            return self.block("aside", self.some(self.links(2, 8), self.block("h3", self.words(1, 4)) + self.block("p", self.words(3, 60))), attrs=self.named("sidebar", "related", "widget", ""))
        if kind == 4:
            return self.block("div", self.block(self.some("h3", "h4"), self.words(1, 4)) + self.some(self.links(2, 8), self.block("p", self.words(3, 40))), attrs=self.named("sidebar", "related-posts", "recommended", "popular", "widget"))
        if kind == 5:
            return self.block(self.some("div", "section"), self.words(4, 40) + self.some("", "<button>Ok</button>", '<a href="#">More</a>'), attrs=self.named("cookie-notice", "notice", "alert", "consent", "cookie-banner", "newsletter", "popup"))
        if kind == 6:
            return self.block("form", f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>" + self.some("", self.block("p", self.words(2, 25))), attrs=self.named("search", "login", "newsletter", "subscribe", "contact"))
        if kind == 7:
            return self.block("header", self.some(self.block("h1", self.words(1, 4)), self.block("div", self.words(1, 6)), self.block("p", self.words(2, 14)), "") + self.some("", self.links(2, 6)), attrs=self.named("header", "masthead", "site-header", "top"))
        if kind == 8:
            return self.block("div", self.block("p", self.words(2, 14)) + self.some("", self.links(2, 5)), attrs=self.named("header", "top-bar", "site-header", "masthead", "banner"))
        if kind == 9:
            return self.block("div", "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(r.randint(2, 6))), attrs=self.named("share", "social", "tags", "tools"))
        if kind == 10:
            return self.block(self.some("script", "style", "noscript"), self.words(3, 40))
        return self.comments()

    def comments(self) -> str:
        r = self.r
        one = lambda: self.block(self.some("div", "li", "article", "p"), self.some("", self.block("span", self.words(1, 2)), self.block("h4", self.words(1, 3))) + self.some(self.words(3, 60), self.block("p", self.words(3, 60))), attrs=self.named("comment", "comment-body", "reply"))
        return self.block(self.some("div", "section", "ol", "aside"), self.some("", self.block("h3", self.words(1, 3))) + "".join(one() for _ in range(r.randint(1, 8))), attrs=f'{self.some("class", "id")}="{self.some("comments", "comment-list", "reader-comments", "discussion", "responses comments", "disqus_thread")}"')

    def footer(self) -> str:
        body = self.some("&copy; " + self.words(2, 20), self.block("p", "&copy; " + self.words(2, 20)), self.links(2, 8) + self.words(2, 10))
        return self.block("footer", body, attrs=self.named("footer", "site-footer", "")) if self.r.random() < 0.7 else self.block("div", body, attrs=self.named("footer", "site-footer", "copyright", "bottom"))

    def paragraph(self) -> str:
        r = self.r
        body = self.words(1, 90) if r.random() < 0.8 else self.words(1, 4)
        if r.random() < 0.2:
            body = self.some(f"<b>{body}<br>", f"{body} <a href='#'>{self.words(1, 3)}</a> {self.words(1, 20)}", f"<em>{body}</em>")
        return body

    def article(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.8:
            parts.append(self.block(self.some("h1", "h1", "h2"), self.words(2, 20), True))
        style = r.random()
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 10, 18])):
            kind = r.random()
            if kind < 0.75:
                parts.append(self.block("div" if style < 0.1 else "p", self.paragraph(), True) if r.random() < 0.9 else f"<p data-main>{self.paragraph()}")
            elif kind < 0.82:
                parts.append(self.block(self.some("h2", "h3"), self.words(1, 10), True))
            elif kind < 0.88:
                parts.append(self.block(self.some("ul", "ol"), "".join(self.block("li", self.words(1, 30), True) for _ in range(r.randint(2, 6))), True))
            elif kind < 0.92:
                parts.append(self.block("blockquote", self.block("p", self.words(3, 40), True), True))
            elif kind < 0.95:
                parts.append(self.block("table", "".join(self.block("tr", self.block("td", self.words(1, 6), True) * 2, True) for _ in range(3)), True))
            else:
                parts.append(self.some(self.block("div", self.words(2, 30), attrs='class="ad"'), self.block("div", self.links(2, 4), attrs='class="related"'), self.block("form", self.words(2, 10), attrs='class="newsletter"'), self.block("aside", self.words(3, 20)), self.block("div", self.words(3, 20), attrs='class="notice"')))
        body = "".join(parts)
        if r.random() < 0.06:
            body = self.words(5, 200)
        kind = r.random()
        if kind < 0.5:
            return self.block("article", body, True, self.some("", "", self.named("post", "article", "entry", "story")))
        if kind < 0.65:
            return self.block("main", self.block("article", body, True) if r.random() < 0.5 else body, True, self.some("", 'role="main"', 'id="content"'))
        if kind < 0.93:
            inner = self.block("div", body, True, self.named("entry-content", "post-body", "article-text", "prose")) if r.random() < 0.5 else body
            return self.block(self.some("div", "section"), inner, True, self.named("content", "post", "article-body", "entry-content", "story", "main-content", "article"))
        return body

    def page(self) -> str:
        r = self.r
        top = "".join(self.noise() for _ in range(r.randint(0, 4)))
        middle = self.article() + "".join(self.noise() for _ in range(r.choice([0, 0, 1, 2]))) + (self.comments() if r.random() < 0.35 else "")
        if r.random() < 0.35:
            middle = self.block("div", middle, attrs=self.named("wrapper", "container", "layout", "row"))
        if r.random() < 0.2:
            middle = self.block("main", middle)
        end = "".join(self.noise() for _ in range(r.choice([0, 0, 1, 2]))) + (self.footer() if r.random() < 0.85 else "")
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{top}{middle}{end}</body></html>"


def labelled(seed: int, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the blocks of generated pages."""
    make = Layouts(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page = make.page()
        nodes = parse(page.replace(" data-main", ""))
        marks = [bool(m[3] and "data-main" in m[3]) for m in TOKEN.finditer(page) if m[2] and not m[1] and m[2].lower() not in INLINE and m[2].lower() not in ("html",)]
        inside_raw = [x.tag for x in nodes[1:]]
        y = np.array([False, *marks]) if len(marks) == len(inside_raw) else None
        if y is not None:
            xs.append(features(nodes))
            ys.append(y)
            ws.append(np.array([1 + math.log1p(x.own) for x in nodes]))
    return np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)


@lru_cache(1)
def trained() -> Boosted:
    return Boosted().fit(*labelled(SEED, PAGES))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page; the driver trains, tasks get the trees."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = extract([x or "" for x in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
