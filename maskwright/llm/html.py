"""Main text of web pages by a tree-structured model of the DOM with sum-product inference."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's inline, void, raw-text and self-closing elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template svg math iframe object noframes canvas audio video title textarea head".split())
#: Opening one of these ends an open element of the listed kinds that is the nearest of its sort.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
WALLS = frozenset("table ul ol dl select body html div section article main aside nav".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Attributes that end in a slash of their own, not in one of a bare value.
SELF_CLOSED = re.compile(r"""(?<!=)(?:^|[\s"']|(?:^|\s)[^\s"'=>]+)/$""")
PART = re.compile(r"[a-z]+")
MARK = re.compile(r"[.!?;:,]")

#: Kinds of region that the words of a class, id or role point to.
HINTS = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense outbrain taboola teaser",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs toc pagination pager tabs topbar skip skiplink",
    "head": "header masthead logo branding tagline sitename top",
    "foot": "footer foot copyright legal colophon bottom credits imprint contentinfo",
    "side": "sidebar side aside widget widgets rail related recommended popular trending tags tagcloud archive complementary more recent",
    "comment": "comment comments commentlist discussion disqus reply replies respond reader feedback responses thread",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup paywall message toast disclaimer",
    "share": "share sharing social follow facebook twitter like buttons toolbar tools actions print login search form searchform",
    "content": "content article post entry story body main text maintext prose articlebody postcontent page single blogpost hentry",
}
HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = {t: i for i, group in enumerate((
    "article main", "section", "div", "p", "h1 h2", "h3 h4 h5 h6", "li dd dt", "ul ol dl", "table tr tbody thead", "td th", "blockquote pre", "figure figcaption",
    "nav menu", "header", "footer", "aside", "form fieldset", "button select option label input legend", "html body", "noscript dialog")) for t in group.split()}
N_TAGS = len(set(TAGS.values())) + 1
#: Elements that make a region without any hint; all but the last are boilerplate.
REGIONS = tuple(frozenset(r.split()) for r in ("nav menu", "header", "footer", "aside", "form fieldset", "article main"))
N_REGION = len(HINTS) + len(REGIONS)
N_BOILER = N_REGION - 2
N_FEATURES = N_TAGS + len(HINTS) + 10 + N_REGION + N_BOILER
#: Kinds of child that have transition potentials of their own: four, outside and inside boilerplate.
N_KINDS = 8


class Page:
    """The DOM of a page without inline elements: per node its parent, depth, tag, hints; the text blocks in order."""

    __slots__ = ("parent", "depth", "tag", "hints", "label", "blocks", "owner", "linked")

    def __init__(self, html: str):
        self.parent, self.depth, self.tag, self.hints, self.label = [-1], [0], ["html"], [()], [None]
        self.blocks: list[str] = []
        self.owner: list[int] = []
        self.linked: list[int] = []
        stack: list[tuple[str, int]] = [("html", 0)]  # every open element and its node
        pieces: list[str] = []
        links = 0
        in_link = 0

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    self.blocks.append(text)
                    self.owner.append(stack[-1][1])
                    self.linked.append(min(links, len(text)))
                pieces.clear()
            links = 0

        def close(upto: int) -> None:
            nonlocal in_link
            for name, _ in stack[upto:]:
                in_link -= name == "a"
            del stack[upto:]

        def nearest(names: set | frozenset, walls: frozenset = frozenset()) -> int:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in walls:
                    return 0
            return 0

        at, n = 0, len(html)
        for match in TAG.finditer(html):
            if match.start() < at:
                continue
            if match.start() > at:
                piece = html[at:match.start()]
                pieces.append(piece)
                if in_link:
                    links += len(piece)
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            if not name:
                continue
            if match[1] or match[4]:
                if name in HIDDEN or name in VOID:
                    continue
                i = nearest({name}, frozenset() if name not in INLINE else frozenset(WALLS | {"p", "li", "td"}))
                if i:
                    if any(x not in INLINE for x, _ in stack[i:]):
                        flush()
                    close(i)
                continue
            if name == "head":
                end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(html, at)
                at = (end.start() if end and html[end.start() + 1] != "/" else end.end()) if end else at
                continue
            if name in ("svg", "math") and SELF_CLOSED.search(match[3] if match[2] else match[6] or ""):
                continue
            if name in HIDDEN:
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if end or name in ("script", "style"):
                    at = end.end() if end else n
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            attributes = match[3] if match[2] else match[6] or ""
            hints, label = [], None
            if attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    value = a[2].strip("\"'")
                    if a[1].lower() == "data-y":
                        label = int(value == "1")
                    else:
                        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
                        hints += [HINT_OF[w] for w in PART.findall(spaced) if w in HINT_OF]
            if name in INLINE and not hints:
                stack.append((name, stack[-1][1]))
                in_link += name == "a"
                continue
            if name not in INLINE:
                flush()
                if name in CLOSE_P and (i := nearest({"p"}, WALLS)):
                    close(i)
                if name in ENDS and (i := nearest(ENDS[name], WALLS - {"tbody"})):
                    close(i)
                if name in ("tbody", "tfoot", "tr") and (i := nearest(ENDS[name], frozenset({"table"}))):
                    close(i)
            else:
                flush()
            up = stack[-1][1]
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.tag.append(name)
            self.hints.append(tuple(hints))
            self.label.append(label)
            stack.append((name, len(self.parent) - 1))
            in_link += name == "a"
        if at < n:
            pieces.append(html[at:])
        flush()


class Forest:
    """Nodes of many pages as arrays; a parent comes before its children."""

    def __init__(self, pages: Sequence[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(pages) else np.zeros(0, np.int64)
        n = int(sizes.sum())
        self.base, self.n = base, n
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base, strict=True)]) if n else np.zeros(0, np.int64)
        self.depth = np.concatenate([np.array(p.depth) for p in pages]) if n else np.zeros(0, np.int64)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        tags = np.array([TAGS.get(t, N_TAGS - 1) for p in pages for t in p.tag], np.int64)
        x = np.zeros((n, N_FEATURES), np.float32)
        x[np.arange(n), tags] = 1
        for p, b in zip(pages, base.tolist(), strict=True):
            for i, hints in enumerate(p.hints):
                for h in hints:
                    x[b + i, N_TAGS + h] = 1
        own, linked, marks, start = (np.zeros(n) for _ in range(4))
        for p, b in zip(pages, base.tolist(), strict=True):
            so_far = 0
            for text, o, k in zip(p.blocks, p.owner, p.linked, strict=True):
                if not own[b + o]:
                    start[b + o] = so_far
                own[b + o] += len(text)
                linked[b + o] += k
                marks[b + o] += len(MARK.findall(text))
                so_far += len(text)
        whole, whole_linked = own.copy(), linked.copy()
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)] if n else []
        for level in self.levels[:0:-1]:
            np.add.at(whole, self.parent[level], whole[level])
            np.add.at(whole_linked, self.parent[level], whole_linked[level])
        total = np.maximum(whole[base][self.page], 1) if n else own
        self.own = own
        extra = [np.log1p(own) / 5, np.log1p(whole) / 8, linked / np.maximum(own, 1), whole_linked / np.maximum(whole, 1), np.minimum(marks / np.maximum(own, 1) * 20, 2),
                 whole / total, np.minimum(self.depth, 20) / 10, start / total, (own == 0).astype(float), np.ones(n)]
        for i, column in enumerate(extra):
            x[:, N_TAGS + len(HINTS) + i] = column
        region, boilerplate = self._regions(pages, x[:, N_TAGS:N_TAGS + len(HINTS)])
        x[:, N_FEATURES - N_REGION - N_BOILER:N_FEATURES - N_BOILER] = region
        x[:, N_FEATURES - N_BOILER:] = boilerplate
        self.x = x
        hint = x[:, N_TAGS:N_TAGS + len(HINTS)]
        boiler = (hint[:, :8].sum(1) > 0) | np.isin(tags, [TAGS[t] for t in ("nav", "header", "footer", "aside", "form", "button", "noscript")])
        text = np.isin(tags, [TAGS[t] for t in ("p", "h1", "h3", "li", "blockquote", "figure", "td")])
        box = np.isin(tags, [TAGS[t] for t in ("article", "section")]) | (hint[:, 8] > 0)
        self.kind = np.where(boiler, 0, np.where(box, 1, np.where(text, 2, 3))) + 4 * boilerplate.any(1)

    def _regions(self, pages: Sequence[Page], hints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what the nearest hinted or region element above each node is, what kinds of boilerplate lie anywhere above it).

        A bare element so hands on what it stands in, however deep; html and body say nothing.
        """
        own = np.zeros((self.n, N_REGION), np.float32)
        own[:, :len(HINTS)] = hints
        names = [t for p in pages for t in p.tag]
        for i, tags in enumerate(REGIONS):
            own[:, len(HINTS) + i] = [t in tags for t in names]
        own[[t in ("html", "body") for t in names]] = 0
        bad = np.delete(own, [len(HINTS) - 1, N_REGION - 1], axis=1)
        some = own.any(1)
        nearest, above = np.zeros_like(own), np.zeros((self.n, N_BOILER), np.float32)
        for level in self.levels[1:]:
            up = self.parent[level]
            nearest[level] = np.where(some[up][:, None], own[up], nearest[up])
            above[level] = np.maximum(above[up], bad[up])
        return nearest, above

    def labels(self, pages: Sequence[Page]) -> np.ndarray:
        """1 for content: a node's own label or its parent's; a node whose children differ takes what most of its text has."""
        y = np.array([-1 if v is None else v for p in pages for v in p.label])
        for level in self.levels[1:]:
            bare = level[y[level] < 0]
            y[bare] = y[self.parent[bare]]
        y = np.maximum(y, 0)
        inside, whole = self.own * y, self.own.copy()
        for level in self.levels[:0:-1]:
            np.add.at(inside, self.parent[level], inside[level])
            np.add.at(whole, self.parent[level], whole[level])
        return np.where((self.own == 0) & (whole > 0), inside * 2 > whole, y).astype(np.int64)


class Model:
    """unary: weights of the content state; pair[kind][parent state][child state]: log potentials."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def infer(self, forest: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum-product: messages from leaves to roots, then back.

        Returns the marginals of each node [n, 2], of each node with its parent [n, parent state, child state], and
        the log partition sum.
        """
        n = forest.n
        belief = np.zeros((n, 2))
        belief[:, 1] = forest.x @ self.unary
        up = np.zeros((n, 2))
        for level in forest.levels[:0:-1]:
            joint = self.pair[forest.kind[level]] + belief[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(belief, forest.parent[level], up[level])
        roots = forest.levels[0] if forest.levels else np.zeros(0, np.int64)
        total = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
        marginal, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
        down = np.zeros((n, 2))
        for d, level in enumerate(forest.levels):
            if d:
                outer = belief[forest.parent[level]] + down[forest.parent[level]] - up[level]
                joint = self.pair[forest.kind[level]] + outer[:, :, None] + belief[level][:, None, :]
                joint = np.exp(joint - joint.max((1, 2), keepdims=True))
                both[level] = joint / joint.sum((1, 2), keepdims=True)
                moved = self.pair[forest.kind[level]] + outer[:, :, None]
                down[level] = np.logaddexp(moved[:, 0, :], moved[:, 1, :])
            full = belief[level] + down[level]
            full = np.exp(full - full.max(1, keepdims=True))
            marginal[level] = full / full.sum(1, keepdims=True)
        return marginal, both, total


def fit(pages: Sequence[Page], steps: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Maximise the likelihood of the labelled trees: observed less expected features, by Adam steps.

    The potentials start from the observed shares of child states under each parent state."""
    forest = Forest(pages)
    y = forest.labels(pages)
    child = np.concatenate(forest.levels[1:]) if len(forest.levels) > 1 else np.zeros(0, np.int64)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    parts = [np.zeros(N_FEATURES), np.log((seen + 0.5) / (seen + 0.5).sum(2, keepdims=True))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        marginal, both, _ = Model(*parts).infer(forest)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[child], both[child])
        gradients = [forest.x.T @ (y - marginal[:, 1]) / max(len(pages), 1) - ridge * parts[0], (seen - expected) / max(len(pages), 1) - ridge * parts[1]]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parts[i] = parts[i] + rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return Model(*parts)


def extract(htmls: Sequence[str], model: Model) -> list[str]:
    """The text of the blocks whose node is more likely content than not."""
    pages = [Page(h) for h in htmls]
    marginal, _, _ = model.infer(Forest(pages))
    out, base = [], 0
    for page in pages:
        content = marginal[base:base + len(page.parent), 1] > 0.5
        out.append(" ".join(text for text, owner in zip(page.blocks, page.owner, strict=True) if content[owner]))
        base += len(page.parent)
    return out


def label_by_article(html: str) -> str | None:
    """The page with its article element marked as content; None if it has not exactly one."""
    found = re.findall(r"<article[\s>]", html, re.I)
    return re.sub(r"<article(?=[\s>])", '<article data-y="1"', html, flags=re.I) if len(found) == 1 else None


FILLER = ("It was late when they came to the river, and nobody had slept. The old bridge was gone, so they waited.", "She opened the letter at once.",
          "Prices rose by four per cent, the office said on Monday.", "A short walk leads from the station to the market.")


def layouts(texts: Sequence[str], count: int, rng: random.Random) -> list[str]:
    """Labelled pages in made-up layouts, filled with sentences of the given texts.

    Containers, wrappers, class names and the regions around and inside the article vary; content elements carry
    data-y="1", the regions to drop data-y="0".
    """
    sentences = [s for t in texts for s in re.split(r"(?<=[.!?])\s+", t) if s] or list(FILLER)
    name = lambda kind: rng.choice(HINTS[kind].split())

    def prose(low: int, high: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(low, high))).replace("<", "&lt;")

    def words(low: int, high: int) -> str:
        return " ".join(prose(1, 1).split()[:rng.randint(low, high)]) or "more"

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(low, high)}</a>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"

    def hint(kind: str) -> str:
        extra = rng.choice(["", "", " box", " block", " wrap-1", "-inner", "-area"])
        return f'{rng.choice(["class", "class", "id"])}="{name(kind)}{extra}"'

    def bare(body: str) -> str:
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            body = rng.choice(["<div>{}</div>", "<div>{}</div>", "<section>{}</section>", "<div class=row><div>{}</div></div>", "<ul><li>{}</li></ul>"]).format(body)
        return body

    def drop(tag: str, attribute: str, body: str) -> str:
        body = bare(body) if tag not in ("p", "span", "ul", "ol") else body
        return f'<{tag} data-y="0" {attribute}>{body}</{tag}>'

    def comments() -> str:
        item = rng.choice(["li", "div", "article", "section"])
        rows = "".join(f'<{item} {hint("comment") if rng.random() < 0.7 else ""}><b>{words(1, 2)}</b> {bare(f"<p>{prose(1, 3)}</p>")}</{item}>' for _ in range(rng.randint(1, 5)))
        return drop(rng.choice(["section", "div", "ol"]), hint("comment"), rng.choice(["<h2>Comments</h2>", "<h3>3 replies</h3>", ""]) + rows)

    def region(kind: str) -> str:
        if kind == "menu":
            return drop("nav", "", links(rng.randint(2, 8))) if rng.random() < 0.5 else drop(rng.choice(["div", "ul"]), hint("menu"), links(rng.randint(2, 8)))
        if kind == "head":
            body = rng.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 6)}</p>", link()]) + (links(3) if rng.random() < 0.5 else "")
            return drop("header", rng.choice(["", hint("head")]), body) if rng.random() < 0.6 else drop("div", hint("head"), body)
        if kind == "foot":
            body = rng.choice([f"&copy; {words(2, 9)}", f"<p>{words(3, 12)}</p>", f"<p>{prose(1, 2)}</p>" + links(3)])
            return drop("footer", rng.choice(["", hint("foot")]), body) if rng.random() < 0.7 else drop("div", hint("foot"), body)
        if kind == "side":
            body = rng.choice([links(5), f"<h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p>", f"<p>{words(3, 20)}</p>" + links(2)])
            return drop("aside", rng.choice(["", hint("side")]), body) if rng.random() < 0.5 else drop("div", hint("side"), body)
        if kind == "advert":
            return drop(rng.choice(["div", "div", "aside", "section", "p", "span"]), hint("advert"), rng.choice([prose(1, 2), f"<p>{prose(1, 2)}</p>", words(2, 8)]))
        if kind == "notice":
            return drop(rng.choice(["div", "div", "section", "p", "dialog"]), hint("notice"), rng.choice([prose(1, 2), f"<p>{prose(1, 2)}</p><button>OK</button>"]))
        if kind == "share":
            return drop("div", hint("share"), "".join(link() for _ in range(3)))
        if kind == "form":
            return drop("form", rng.choice(["", hint("notice"), hint("share")]), f"<label>{words(1, 4)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{words(3, 9)}</p><button>{words(1, 2)}</button>")
        return comments()

    def paragraph() -> str:
        body = prose(1, 5)
        if rng.random() < 0.15:  # without any punctuation, or with little else
            body = rng.choice([f"{words(1, 1)} " * rng.randint(3, 80), re.sub(r"[.,;:!?]", "", body), re.sub(r" ", "%%% ", body)])
        if rng.random() < 0.2:
            body += f" <a href='/x'>{words(1, 3)}</a> {prose(1, 2)}"
        if rng.random() < 0.3:
            body = f"<b>{body}<br>{prose(1, 1)}"
        return rng.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<div>{body}</div>", f"<p>{words(1, 4)}.</p>"])

    def article() -> str:
        parts = []
        for _ in range(rng.randint(1, 9)):
            parts.append(rng.choice([paragraph, paragraph, paragraph, lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<ul><li>{prose(1, 1)}</li><li>{words(2, 9)}</li></ul>",
                                     lambda: f"<blockquote>{prose(1, 2)}</blockquote>", lambda: f"<table><tr><td>{words(1, 4)}<td>{words(1, 4)}</table>",
                                     lambda: f"<figure><img src=x><figcaption>{words(2, 9)}</figcaption></figure>", lambda: f"<pre>{words(2, 9)}</pre>"])())
            if rng.random() < 0.08:  # a run of short paragraphs, often the same one
                parts += [f"<p>{rng.choice([words(1, 4), line])}</p>" for line in [words(1, 4)] for _ in range(rng.randint(4, 30))]
            if rng.random() < 0.12:
                parts.append(region(rng.choice(["advert", "side", "share", "notice", "form", "menu"])))
        if rng.random() < 0.7:
            parts.insert(0, f"<h1>{words(2, 9)}</h1>")
        if rng.random() < 0.2:
            parts.append(comments())
        if rng.random() < 0.1:
            parts.append(region("foot"))
        if rng.random() < 0.3:
            at = rng.randint(0, len(parts))
            parts[at:] = [f"<{tag}>{''.join(parts[at:])}</{tag}>" for tag in [rng.choice(["div", "div", "section"])]]
        return bare("".join(parts)) if rng.random() < 0.4 else "".join(parts)

    pages = []
    for _ in range(count):
        tag, attribute = rng.choice([("article", ""), ("article", hint("content")), ("main", ""), ("div", hint("content")), ("div", hint("content")), ("section", hint("content")),
                                     ("div", 'role="main"'), ("div", 'class="col-8"'), ("td", "")])
        body = f'<{tag} data-y="1" {attribute}>{article()}</{tag}>'
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        before = "".join(region(k) for k in rng.sample(["menu", "head", "notice", "advert", "side", "form", "share"], rng.randint(0, 4)))
        after = "".join(region(k) for k in rng.sample(["foot", "foot", "comments", "side", "advert", "notice", "form", "share", "menu"], rng.randint(0, 4)))
        for _ in range(rng.randint(0, 2)):
            body = f'<{rng.choice(["div", "div", "main", "section"])} {rng.choice(["", "class=wrapper", "class=container", "id=page", "class=row", f'class="layout with-{name(rng.choice(list(HINTS)))}"'])}>' + (region("side") if rng.random() < 0.2 else "") + body + "</div>"
        pages.append(f'<html><body>{before}{body}{after}</body></html>')
    return pages


def train(pages: DataFrame, sample: int = 150, made_up: int = 450, seed: int = 5, longest: int = 200_000) -> Model:
    """Learn from at most `sample` pages, drawn by hash of their ids, and `made_up` pages in other layouts.

    Pages of more than `longest` characters are not drawn; of an id with several pages up to four are, by hash. Null ids
    and htmls are not drawn, and without any page the made-up ones alone are used. A drawn page with exactly one article element is labelled by it; the made-up ones take their sentences from the
    drawn pages' text, so that words say nothing about a region.
    """
    fitting = pages.filter("page_id is not null and html is not null").filter(F.length("html") <= longest).select("page_id", "html")
    ids = [r["page_id"] for r in fitting.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    drawn = fitting.filter(F.col("page_id").isin(ids)).select("html").distinct().orderBy(F.xxhash64("html"), "html").limit(4 * sample)
    htmls = sorted(r["html"] for r in drawn.collect()) if ids else []
    labelled = [h for h in map(label_by_article, htmls) if h]
    texts = [b for h in htmls for b in Page(h).blocks]
    rng = random.Random(seed)
    rng.shuffle(texts)
    return fit([Page(h) for h in [*labelled, *layouts(texts[:2000], made_up, rng)]])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html.

    White space inside a block becomes one space, blocks are joined in order by one space. A null or empty html
    gives an empty text; null ids and urls pass through; equal rows give equal texts; no rows give none.
    """
    model = model or train(pages)
    kinds = dict(pages.dtypes)
    unary, pair = model.unary, model.pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(unary, pair)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = extract([h or "" for h in part.column(2).to_pylist()], own)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
