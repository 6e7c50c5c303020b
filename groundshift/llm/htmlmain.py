"""Main text of web pages by gradient-boosted trees over DOM nodes and a decoding that follows the tree.

Every page is parsed into a tree. A node is described by its tag, the tokens of its class, id and role, its depth, the size,
tag, link and punctuation density of its subtree, and its place among its sisters. Boosted regression trees, trained here
on pages whose document is known and on invented layouts, give the log-odds that the node's own text is main text. Decoding
looks for the best sum of log-odds over the tree under the rule that below a dropped node nothing is kept, first upwards
(what is a subtree worth?) and then down from the root.

Training reads a bounded sample of the pages (TRAIN_PAGES); the model, some dozens of small trees, travels with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400  # pages at most that the trees are trained on
MADE_UP = 300  # invented pages among them
LONGEST = 200_000  # characters of a page or document used for training
PAGES = 64  # pages whose nodes are scored at a time
TREES, TREE_DEPTH, RATE = 40, 3, 0.3
BINS = 16

# Elements without an end tag, elements whose text is never shown, elements that stand in a line, elements that
# an opening paragraph ends, and attribute tokens that hint at what a block is for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "button", "textarea", "option"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
            "table", "ul"}
BAD_TOKENS = {"nav", "navbar", "menu", "header", "footer", "sidebar", "side", "aside", "ad", "ads", "advert", "advertisement", "banner", "promo",
              "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "popup", "modal", "comment", "comments", "reply", "replies",
              "social", "share", "sharing", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "newsletter", "subscribe", "login",
              "search", "form", "widget", "copyright", "legal", "disclaimer", "toolbar", "tags", "meta", "byline", "contentinfo", "navigation",
              "complementary", "banners", "footnote", "copyright", "gdpr", "respond", "discussion", "rail", "masthead", "skip"}
GOOD_TOKENS = {"article", "content", "main", "body", "post", "entry", "story", "text", "page", "blog", "articlebody", "prose"}
BAD_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
GOOD_TAGS = {"article", "main"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "dd", "dt", "figcaption"}

_TOKEN = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: "Node | None"
    tokens: frozenset = frozenset()
    hidden: bool = False
    items: list = field(default_factory=list)  # texts and nodes in page order


class _Builder(HTMLParser):
    """A forgiving tree: unclosed elements end with their parents, and an opening block ends an open paragraph."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt"):
            self._end_open(tag)
        words: list[str] = []
        hidden = tag in HIDDEN
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id", "role", "itemprop"):
                words += _TOKEN.findall(value)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        node = Node(tag, self.at, frozenset(words), hidden)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end_open(self, tag: str) -> None:
        stops = {"p": {"p"}, "li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dd": {"dl"}, "dt": {"dl"}}
        ends = {"td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}.get(tag, {tag} if tag in stops and tag != "p" else {"p"})
        node = self.at
        while node.parent is not None:
            if node.tag in ends:
                self.at = node.parent
                return
            if node.tag not in INLINE and node.tag != "p":
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def blocks(root: Node) -> list[tuple[Node, str]]:
    """Visible text blocks in page order with the block node that each stands in; line breaks end a block."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []

    def close(owner: Node) -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((owner, text))

    stack: list[tuple[Node, Node, int]] = [(root, root, 0)]
    while stack:
        node, owner, i = stack.pop()
        if i == 0 and node.tag not in INLINE:
            close(owner)
            owner = node
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                parts.append(x)
            elif x.tag in ("br", "hr"):
                close(owner)
            elif not x.hidden:
                stack.append((node, owner, i))
                stack.append((x, owner, 0))
                break
        else:
            if node.tag not in INLINE:
                close(owner)
    return out


FEATURES = ["depth", "length", "words", "commas", "links", "tags", "share", "bad_token", "good_token", "bad_above", "good_above", "bad_tag", "good_tag",
            "bad_tag_above", "good_tag_above", "text_tag", "place", "sisters", "alike_sisters", "heading", "list", "ends"]


@dataclass(eq=False)
class Page:
    """The block nodes of a page in page order (parents first) with their features."""

    nodes: list
    parents: list[int]
    own: list[list[int]]  # blocks of each node itself
    texts: list[str]
    features: np.ndarray


def describe(html: str) -> Page:
    root = parse(html)
    found = blocks(root)
    index: dict[int, int] = {}
    nodes: list[Node] = []
    parents: list[int] = []

    def place(node: Node) -> int:
        chain = []
        while id(node) not in index:
            if node.tag not in INLINE or node.parent is None:
                chain.append(node)
            if node.parent is None:
                break
            node = node.parent
        for n in reversed(chain):
            up = n.parent
            while up is not None and id(up) not in index:
                up = up.parent
            parents.append(-1 if up is None else index[id(up)])
            index[id(n)] = len(nodes)
            nodes.append(n)
        return 0

    own_of: list[int] = []
    for node, _ in found:
        place(node)
        own_of.append(index[id(node)])
    n = len(nodes)
    own: list[list[int]] = [[] for _ in range(n)]
    for b, i in enumerate(own_of):
        own[i].append(b)
    texts = [t for _, t in found]
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return Page(nodes, parents, own, texts, x)
    length, words, commas, links, tags = (np.zeros(n) for _ in range(5))
    for i, node in enumerate(nodes):
        length[i] = sum(len(texts[b]) for b in own[i])
        words[i] = sum(texts[b].count(" ") + 1 for b in own[i])
        commas[i] = sum(texts[b].count(",") + texts[b].count(".") for b in own[i])
        queue = [y for y in node.items if isinstance(y, Node) and y.tag in INLINE]
        while queue:
            y = queue.pop()
            tags[i] += 1
            if y.tag == "a":
                links[i] += sum(len(z) for z in y.items if isinstance(z, str))
            queue += [z for z in y.items if isinstance(z, Node) and z.tag in INLINE]
        tags[i] += 1
    for i in range(n - 1, 0, -1):  # parents come before their children
        p = parents[i]
        for v in (length, words, commas, links, tags):
            v[p] += v[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parents[i]].append(i)
    total = max(length[0], 1.0)
    place_of, sisters, alike = np.zeros(n), np.ones(n), np.ones(n)
    for kids in children:
        same: dict[str, int] = {}
        for k in kids:
            same[nodes[k].tag] = same.get(nodes[k].tag, 0) + 1
        for j, k in enumerate(kids):
            place_of[k], sisters[k], alike[k] = j / len(kids), len(kids), same[nodes[k].tag]
    depth, bad_up, good_up, bad_tag_up, good_tag_up = (np.zeros(n) for _ in range(5))
    for i, node in enumerate(nodes):
        bad, good = bool(node.tokens & BAD_TOKENS), bool(node.tokens & GOOD_TOKENS)
        bad_tag, good_tag = node.tag in BAD_TAGS, node.tag in GOOD_TAGS
        p = parents[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            bad_up[i], good_up[i] = bad_up[p] or x[p, 7], good_up[p] or x[p, 8]
            bad_tag_up[i], good_tag_up[i] = bad_tag_up[p] or x[p, 11], good_tag_up[p] or x[p, 12]
        last = texts[own[i][-1]] if own[i] else ""
        x[i] = [depth[i], np.log1p(length[i]), np.log1p(words[i]), commas[i] / max(words[i], 1), links[i] / max(length[i], 1), np.log1p(tags[i]),
                length[i] / total, bad, good, bad_up[i], good_up[i], bad_tag, good_tag, bad_tag_up[i], good_tag_up[i], node.tag in TEXT_TAGS, place_of[i],
                sisters[i], alike[i] / sisters[i], node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), node.tag in ("ul", "ol", "li"), last[-1:] in ".!?"]
    return Page(nodes, parents, own, texts, x)


@dataclass
class Forest:
    """Boosted trees in arrays: for each tree the feature, the threshold and the leaf values of a complete binary tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = (1 << TREE_DEPTH) - 1
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic gradient boosting with second-order leaf values on at most BINS thresholds for each feature."""
    if not len(x):
        return Forest(0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    inner = (1 << TREE_DEPTH) - 1
    odds = np.full(len(x), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        fs, ts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            here = at == node
            if here.sum() >= 20:
                best = 1e-6
                whole_g, whole_h = g[here].sum(), h[here].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(codes[here, f], g[here], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(codes[here, f], h[here], len(c) + 1))[:-1]
                    gain = gs ** 2 / (hs + 1) + (whole_g - gs) ** 2 / (whole_h - hs + 1) - whole_g ** 2 / (whole_h + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, fs[node], ts[node] = gain[k], f, c[k]
            at = np.where(here, 2 * node + 1 + (x[:, fs[node]] > ts[node]), at)
        leaf = at - inner
        size = 1 << TREE_DEPTH
        vs = RATE * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
        odds += vs[leaf]
        features.append(fs)
        thresholds.append(ts)
        values.append(vs)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def decode(page: Page, odds: np.ndarray) -> str:
    """Kept blocks joined by line feeds. Best sum of log-odds under the rule that a dropped node keeps nothing below it."""
    n = len(page.nodes)
    if not n:
        return ""
    # a node without text of its own only says something about what lies below
    weight = np.array([sum(len(page.texts[b]) for b in o) for o in page.own], float)
    own = np.clip(odds, -8, 8) * np.log1p(weight)
    doubt = np.minimum(np.clip(odds, -8, 8), 0) * np.where(weight > 0, 0, 1)  # keeping an unlikely container costs
    gain = own.copy()
    for i in range(n - 1, 0, -1):
        gain[page.parents[i]] += max(gain[i] + doubt[i], 0.0)
    kept = np.zeros(n, bool)
    for i in range(n):
        p = page.parents[i]
        kept[i] = p < 0 or (kept[p] and gain[i] + doubt[i] > 0)
    chosen = sorted(b for i in range(n) if kept[i] and odds[i] > 0 for b in page.own[i])
    return "\n".join(page.texts[b] for b in chosen)


def node_labels(page: Page, lines: set[str], start: str) -> np.ndarray:
    """1 where a node's text is text of the known document (a line, or the beginning that a heading repeats)."""
    y = np.zeros(len(page.nodes))
    for i, own in enumerate(page.own):
        hits = sum(page.texts[b] in lines or (len(page.texts[b]) >= 2 and start.startswith(page.texts[b])) for b in own)
        y[i] = float(2 * hits > len(own))
    for i in range(len(y) - 1, 0, -1):  # a container is main text if most text below it is
        if not page.own[page.parents[i]]:
            y[page.parents[i]] = max(y[page.parents[i]], y[i])
    return y


def training_pages(pages: DataFrame, docs: DataFrame, most: int = TRAIN_PAGES, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most ``most`` (html, text) of pages whose address ends in the id of a document, chosen by hash of page_id."""
    number = F.expr("try_cast(regexp_extract(url, '([0-9]{1,18})[^0-9/?#]*/?([?#].*)?$', 1) AS BIGINT)")
    known = pages.select("page_id", "html", number.alias("n")).filter((F.length("html") <= longest) & F.col("n").isNotNull() & F.col("page_id").isNotNull())
    picked = known.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()  # ids first: every task offers its own
    some = known.filter(F.col("page_id").isin(sorted({r["page_id"] for r in picked}))).orderBy("page_id", "html").limit(most).collect()
    ids = sorted({r["n"] for r in some})
    wanted = docs.filter(F.col("doc_id").isin(ids) & (F.length("text") <= longest)).select("doc_id", "text").orderBy("doc_id", "text").limit(most)
    texts = {r["doc_id"]: r["text"] for r in wanted.collect()}
    return [(r["html"], texts[r["n"]]) for r in some if r["n"] in texts]


def made_up_pages(count: int = MADE_UP) -> list[tuple[str, str]]:
    """(html, main text) of ``count`` invented layouts, which show the trees markup that the corpus may lack."""
    rng = np.random.default_rng(7)
    bad_tokens, good_tokens = sorted(BAD_TOKENS), sorted(GOOD_TOKENS)
    sounds = ["ba", "re", "ti", "on", "ka", "mel", "sor", "vin", "ta", "lu", "per", "and", "est"]

    def pick(values):
        return values[int(rng.integers(len(values)))]

    def sentence(low: int, high: int) -> str:
        words = ["".join(pick(sounds) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high)))]
        return " ".join(words).capitalize() + pick([".", ".", "", "!"])

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence(4, 20) for _ in range(int(rng.integers(low, high))))

    def links() -> str:
        items = "".join(f"<li><a href='/x'>{sentence(1, 4)}</a></li>" for _ in range(int(rng.integers(3, 9))))
        return f"<ul>{items}</ul>"

    def clutter() -> str:
        inner = pick([links, prose, lambda: f"<p>{prose()}</p>", lambda: f"<h3>{sentence(1, 4)}</h3><p>{prose()}</p><p>{prose(1, 3)}</p>",
                      lambda: f"<p><a href='/y'>{sentence(2, 8)}</a></p>", lambda: f"{sentence(1, 5)} <a href='/z'>{sentence(1, 3)}</a>"])()
        tag = pick([*sorted(BAD_TAGS), "div", "div", "section", "div", "p"])
        named = tag not in BAD_TAGS or rng.random() < 0.4
        if tag == "p":
            inner = sentence(3, 14)
        mark = f" {pick(['class', 'class', 'id'])}='{pick(bad_tokens)}{pick(['', '-box', ' wide', '_1'])}'" if named else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    out = []
    for _ in range(count):
        kept: list[str] = []

        def main() -> str:
            kind = int(rng.integers(9))
            text = prose()
            if kind < 5:
                kept.append(text)
                return f"<p>{text}</p>"
            if kind == 5:
                kept.append(head := sentence(1, 6))
                return f"<h2>{head}</h2>"
            if kind == 6:
                rows = [sentence(2, 10) for _ in range(int(rng.integers(2, 6)))]
                kept.extend(rows)
                return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>"
            kept.append(text)
            return f"<blockquote>{text}</blockquote>" if kind == 7 else f"<div>{text}</div>"

        parts = []
        if rng.random() < 0.7:
            kept.append(title := sentence(2, 9))
            parts.append(f"<h1>{title}</h1>")
        for _ in range(int(rng.integers(1, 12))):
            parts.append(main())
            if rng.random() < 0.15:
                parts.append(clutter())
        tag = pick(["article", "article", "main", "div", "section", "div"])
        mark = f" class='{pick(good_tokens)}'" if tag in ("div", "section") else ""
        body = f"<{tag}{mark}>{''.join(parts)}</{tag}>"
        before, after = ("".join(clutter() for _ in range(int(rng.integers(0, 4)))) for _ in range(2))
        out.append((f"<html><body>{before}{body}{after}</body></html>", "\n".join(kept)))
    return out


def learn(pages: DataFrame, docs: DataFrame, most: int = TRAIN_PAGES) -> Forest:
    """Trees from at most ``most`` pages of the corpus whose document is known, and the invented ones."""
    xs, ys = [], []
    for html, text in [*made_up_pages(), *training_pages(pages, docs, most)]:
        page = describe(html)
        lines = {t for line in text.split("\n") if (t := " ".join(line.split()))}
        if len(page.nodes):
            xs.append(page.features)
            ys.append(node_labels(page, lines, " ".join(text.split("\n")[0].split())))
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, docs: DataFrame, model: Forest | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty html, or one without main text, gives an empty text. Null ids and urls stay, repeated rows are extracted
    each, extra columns are ignored, and an empty table gives an empty result. ``docs`` (doc_id, text) is only used for training.
    """
    forest = model or learn(pages, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                some = b.slice(i, PAGES)
                found = [describe(x or "") for x in some.column(2).to_pylist()]
                odds = forest.odds(np.concatenate([p.features for p in found]))
                ends = np.cumsum([len(p.nodes) for p in found])
                texts = [decode(p, o) for p, o in zip(found, np.split(odds, ends[:-1]))]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].rsplit(",", 1)[0].replace(":", " ") + ", text string, n_chars long")
