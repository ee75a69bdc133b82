"""Main text of web pages by boosted trees over the nodes of the page.

Every block element of a page is a node with features of its subtree (text and
link density, sentences), its attributes, its depth and its siblings.  Boosted
trees score how likely a node belongs to the article; decoding then picks the best
labelling of the whole tree in which nothing below a dropped node is kept.

The trees are fitted to pages laid out at random from a list of common layouts,
whose labels are known: a page table has none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard: inline, void and raw elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Never text of an article, whatever stands in them.
SKIP = RAW | frozenset("head template noscript svg math button select option object canvas audio video".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table article section div body html td th".split())

#: Attribute tokens by what they speak for.
TOKENS = {
    "content": "article content main post entry story text body blog detail",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead top topbar logo branding hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail widget related recommended trending popular tags categories",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsense commercial",
    "notice": "cookie consent notice alert popup modal newsletter subscribe gdpr overlay warning",
    "comment": "comment comments reply replies discussion respond disqus reactions",
    "form": "form search login signup register contact input",
    "share": "share social follow meta byline author date tools",
}
WORD_TO_KIND = {w: k for k, ws in TOKENS.items() for w in ws.split()}
KINDS = tuple(TOKENS)
TAGS = ("p", "div", "article", "main", "section", "h", "li", "list", "nav", "header", "footer",
        "aside", "form", "table", "quote", "other")
TAG_OF = {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "blockquote": "quote",
          "pre": "quote", "td": "table", "th": "table", "tr": "table", "tbody": "table",
          **{f"h{i}": "h" for i in range(1, 7)}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kinds", "parent", "depth", "children", "chars", "link", "stops", "marks",
                 "below", "skip", "order")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.kinds = kinds_of(attributes) if attributes else frozenset()
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.chars = self.link = self.stops = self.marks = self.below = 0
        self.skip = tag in SKIP or (parent is not None and parent.skip)
        self.order = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)


@lru_cache(4096)
def kinds_of(attributes: str) -> frozenset[str]:
    out = set()
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for w in PARTS.findall(html.unescape(a or b or c)):
            if w.lower() in WORD_TO_KIND:
                out.add(WORD_TO_KIND[w.lower()])
    return frozenset(out)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Nodes in page order, and the text blocks with the node each stands in."""
    root = Node("html", "", None)
    nodes, blocks, held = [root], [], []
    open_: list[tuple[str, Node]] = [("html", root)]  # inline elements stay in their node
    links = at = 0

    def flush() -> None:
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((open_[-1][1], text))

    def text(upto: int) -> None:
        if upto > at and not open_[-1][1].skip:
            piece = page[at:upto]
            held.append(piece)
            if links:
                open_[-1][1].link += len(piece.strip())

    def close(names: set[str], scope: frozenset[str]) -> bool:
        nonlocal links
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in names:
                links = max(0, links - sum(t == "a" for t, _ in open_[i:]))
                del open_[i:]
                return True
            if open_[i][0] in scope:
                return False
        return False

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        if not m:
            break
        text(m.start())
        at = pos = m.end()
        if m[2] is None:
            continue
        tag, block = m[2].lower(), m[2].lower() not in INLINE
        if m[1]:
            if block:
                flush()
            close({tag}, frozenset())
            continue
        if block:
            flush()
            if tag in ENDS_P:
                close({"p"}, SCOPE)
            if tag in SAME:
                close(SAME[tag], SCOPE - SAME[tag])
        elif tag == "br":
            held.append(" ")
        if tag in VOID or (m[3].endswith("/") and not block):
            continue
        node = open_[-1][1]
        if block:
            if tag in ("html", "body") and any(t == tag for t, _ in open_):
                continue
            node = Node(tag, m[3], node)
            nodes.append(node)
        open_.append((tag, node))
        links += tag == "a"
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, pos)
            pos = at = stop.start() if stop else end
    text(end)
    flush()
    for node, block_ in blocks:
        node.chars += len(block_)
        node.stops += len(re.findall(r"[.!?]", block_))
        node.marks += 1
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node.  Sums over subtrees are taken from the last node to the first."""
    sums = {id(n): [n.chars, min(n.link, n.chars), n.stops, n.marks, 1, n.tag == "p"] for n in nodes}
    for n in reversed(nodes):
        if n.parent:
            for i, v in enumerate(sums[id(n)]):
                sums[id(n.parent)][i] += v
    total = max(1, sums[id(nodes[0])][0])
    out = np.zeros((len(nodes), 12 + len(TAGS) + 3 * len(KINDS)), np.float32)
    above: dict[int, frozenset[str]] = {}
    tags_above: dict[int, set] = {}
    for i, n in enumerate(nodes):
        chars, link, stops, marks, below, paragraphs = sums[id(n)]
        parent = n.parent
        around = sums[id(parent)] if parent else [chars] * 6
        tag = TAG_OF.get(n.tag, n.tag if n.tag in TAGS else "other")
        above[id(n)] = n.kinds | (above[id(parent)] if parent else frozenset())
        tags_above[id(n)] = ({tag} | tags_above[id(parent)]) if parent else {tag}
        out[i, :12] = (
            np.log1p(chars), link / max(1, chars), stops / max(1, marks), chars / below,
            chars / total, chars / max(1, around[0]), paragraphs, n.depth, n.order,
            len(parent.children) if parent else 1, np.log1p(n.chars), chars / max(1, marks))
        out[i, 12 + TAGS.index(tag)] = 1
        base = 12 + len(TAGS)
        for k, kind in enumerate(KINDS):
            out[i, base + k] = kind in n.kinds
            out[i, base + len(KINDS) + k] = kind in above[id(n)]
        # Structure elements above speak like the attribute tokens do.
        for j, kind in enumerate(("nav", "header", "footer", "aside", "form", "article", "main")):
            out[i, base + 2 * len(KINDS) + j] = kind in tags_above[id(n)]
    return out


class Trees:
    """Gradient boosting of shallow regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gain, weight = y - p, p * (1 - p)
            size = (1 << (self.depth + 1)) - 1
            feature, bound, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), int)
            for i in range(size):
                here = np.flatnonzero(node == i)
                if not len(here):
                    continue
                g, h = gain[here].sum(), weight[here].sum()
                value[i] = self.rate * g / (h + 1.0)
                if 2 * i + 2 >= size or len(here) < 20:
                    continue
                best = (1e-3, -1, 0)
                for j, c in enumerate(self.cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[here, j], gain[here], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[here, j], weight[here], len(c) + 1))[:-1]
                    gains = left_g**2 / (left_h + 1) + (g - left_g)**2 / (h - left_h + 1) - g * g / (h + 1)
                    k = int(gains.argmax())
                    if gains[k] > best[0]:
                        best = (gains[k], j, k)
                if best[1] >= 0:
                    feature[i], bound[i] = best[1], self.cuts[best[1]][best[2]]
                    node[here] = 2 * i + 1 + (binned[here, best[1]] > best[2])
            score += value[node]
            self.trees.append((feature, bound, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                down = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > bound[node])
                node = np.where(f >= 0, down, node)
            out += value[node]
        return out


def decode(nodes: list[Node], score: np.ndarray, most: float = 4.0) -> set[int]:
    """Nodes kept by the best labelling without a kept node below a dropped one."""
    own = {id(n): float(np.clip(s, -most, most)) for n, s in zip(nodes, score)}
    total, keep, choice = {}, {}, {}
    for n in reversed(nodes):
        s = own[id(n)]
        total[id(n)] = s + sum(total[id(c)] for c in n.children)
        keep[id(n)] = s + sum(max(keep[id(c)], -total[id(c)]) for c in n.children)
        choice[id(n)] = keep[id(n)] > -total[id(n)] and not n.skip
    kept: set[int] = set()
    for n in nodes:
        if (n.parent is None or id(n.parent) in kept) and (n.parent is None or choice[id(n)]):
            kept.add(id(n))
    return kept


# --- Training pages -------------------------------------------------------

PIECES = {
    "nav": ("nav", "div.nav", "ul.menu", "div#navigation", "div.navbar", "ol.breadcrumb"),
    "header": ("header", "div.header", "div#masthead", "div.topbar"),
    "footer": ("footer", "div.footer", "div#footer", "div.copyright"),
    "side": ("aside", "div.sidebar", "div#side", "section.related", "div.widget", "div.trending"),
    "ad": ("div.ad", "div.ads", "section.sponsored", "div.promo", "p.advert", "div.banner"),
    "notice": ("div.cookie", "div.notice", "p.notice", "div#consent", "section.newsletter", "div.alert"),
    "comment": ("div.comments", "section#comments", "ol.comment-list", "div.discussion", "ul.replies"),
    "form": ("form", "form.search", "form#login", "div.form"),
    "share": ("div.share", "ul.social", "p.byline", "div.tools"),
}
MAINS = ("article", "main", "div.content", "div#content", "div.post", "section.entry", "div.story",
         "main/article", "div#main/div.article", "div.page/div.text", "div", "div/div", "section")
SYLLABLES = "ka lo mi ten ra so vel dun ar is qua ber ni tos en pra gol um fe st".split()


def training_pages(count: int = 300, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Node features and labels of pages put together at random."""
    rng = np.random.default_rng(seed)

    def words(n: int) -> str:
        ws = ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n)]
        for i in range(0, n, int(rng.integers(6, 15))):
            ws[i] = ws[i].capitalize()
            if i:
                ws[i - 1] += "."
        return " ".join(ws) + ("." if n > 3 else "")

    def tag(spec: str, inner: str) -> str:
        for one in reversed(spec.split("/")):
            name = re.split(r"[.#]", one)[0]
            attr = f' class="{one.split(".")[1]}"' if "." in one else (
                f' id="{one.split("#")[1]}"' if "#" in one else "")
            inner = f"<{name}{attr}>{inner}</{name}>"
        return inner

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))

    def junk(kind: str) -> str:
        spec = str(rng.choice(PIECES[kind]))
        n, name = int(rng.integers(2, 9)), re.split(r"[.#]", spec)[0]
        if name in ("ul", "ol"):
            inner = links(n) if kind != "comment" else "".join(
                f"<li><p>{words(int(rng.integers(5, 40)))}</p></li>" for _ in range(n))
        elif kind in ("nav", "share") and name != "p":
            inner = f"<ul>{links(n)}</ul>" if rng.random() < 0.7 else f'<a href="/">{words(2)}</a> ' * n
        elif kind == "comment":
            inner = "<h3>" + words(2) + "</h3>" + "".join(
                f'<div class="comment"><p>{words(int(rng.integers(5, 60)))}</p></div>' for _ in range(n))
        elif kind == "form":
            inner = f'<label>{words(2)}</label><input name="q"><p>{words(int(rng.integers(2, 9)))}</p>'
        elif kind == "side":
            inner = f"<h4>{words(2)}</h4>" + (f"<ul>{links(n)}</ul>" if rng.random() < 0.6 else (
                f"<p>{words(int(rng.integers(8, 60)))}</p>"))
        elif name == "p":
            inner = words(int(rng.integers(3, 25)))
        else:
            body = words(int(rng.integers(2, 40)))
            inner = body if rng.random() < 0.5 else f"<p>{body}</p>"
        return tag(spec, inner)

    def main() -> str:
        open_p = rng.random() < 0.3
        short = rng.random() < 0.25
        parts = [f"<h1>{words(int(rng.integers(1, 4 if short else 9)))}</h1>"] if (
            rng.random() < 0.9) else []
        for _ in range(int(rng.integers(1, 3 if short else 9))):
            n = int(rng.integers(1, 140) if rng.random() < 0.8 and not short else rng.integers(1, 8))
            roll = rng.random()
            body = words(n)
            if rng.random() < 0.2:
                body = f"<b>{body[:n // 2 + 1]}</b>" + body[n // 2 + 1:]
            if rng.random() < 0.2:
                body += f' <a href="/y">{words(2)}</a> ' + words(3)
            if roll < 0.75:
                parts.append(f"<p>{body}" + ("" if open_p else "</p>"))
            elif roll < 0.83:
                parts.append(f"<h2>{words(4)}</h2>")
            elif roll < 0.9:
                parts.append("<ul>" + "".join(f"<li>{words(int(rng.integers(3, 20)))}</li>"
                                              for _ in range(3)) + "</ul>")
            elif roll < 0.95:
                parts.append(f"<blockquote>{body}</blockquote>")
            else:
                parts.append(f"<div>{body}</div>")
        return "".join(parts)

    xs, ys = [], []
    for _ in range(count):
        def some(*kinds: str) -> str:
            return "".join(f"\x02{junk(k)}\x03" for k in kinds if rng.random() < 0.5)

        body = main()
        if rng.random() < 0.3:
            at = body.rfind("<p>")
            body = body[:at] + some("ad", "share", "side", "notice") + body[at:] if at > 0 else body
        body = tag(str(rng.choice(MAINS)), body + some("share", "comment", "side"))
        page = some("notice", "header", "nav", "form", "ad") + body + some(
            "comment", "side", "ad", "form", "share") + some("footer", "notice")
        if rng.random() < 0.3:
            page = tag(str(rng.choice(["div", "div#page", "div.wrapper", "main"])), page)
        # Marks in the text say which nodes were put in as junk.
        marked = re.sub("\x02<([a-z0-9]+)", r"<\1 data-junk", page).replace("\x03", "")
        nodes, _ = parse(f"<html><body>{marked}</body></html>")
        flags = junk_of(marked, nodes)
        xs.append(features(nodes))
        ys.append(1.0 - flags)
    return np.concatenate(xs), np.concatenate(ys)


def junk_of(marked: str, nodes: list[Node]) -> np.ndarray:
    """1 for the nodes that carry the mark or stand below one that does."""
    marks = iter("data-junk" in m[3] for m in TOKEN.finditer("<html><body>" + marked)
                 if m[2] and not m[1] and m[2].lower() not in INLINE | VOID and m[2].lower() != "html")
    own = {id(nodes[0]): False, **{id(n): next(marks) for n in nodes[1:]}}
    out = np.zeros(len(nodes))
    below: dict[int, bool] = {}
    for i, n in enumerate(nodes):
        below[id(n)] = own[id(n)] or (n.parent is not None and below[id(n.parent)])
        out[i] = below[id(n)]
    return out


def fit(count: int = 300, seed: int = 8) -> Trees:
    return Trees().fit(*training_pages(count, seed))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    score = trees.score(np.concatenate([features(n) for n, _ in parsed])) if parsed else []
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, score[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for n, t in blocks if id(n) in kept))
    return out


def extract(rows: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Blocks of the article in page order, one line each, white space squeezed and
    character references decoded.  Null and empty pages, and pages without an
    article, give an empty text; broken markup is read as browsers do in outline;
    repeated rows are read each, extra columns ignored.
    """
    trees = trees or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
