"""HTML extraction with a tree-structured graphical model.

The block elements of a page form a tree. Each is content (it holds main text or an ancestor does, and nothing in between is
a page part of another kind) or not. A node's potential comes from its tag, the words of its class, id and role, its
amount of text and links; an edge's potential from the labels of parent and child and the pair of their tags. Sum-product
messages go up and down the tree and give each node's exact marginal; the text of nodes above one half is kept.

The weights are learned by gradient ascent on the likelihood of labelled pages, which are made by the rules in
``labelled_pages`` (layouts, names and texts are drawn from a fixed seed): the model is the same on every run. Nodes of all
pages of a batch are worked on together, level by level.

White space inside a block becomes one space; blocks stand in page order, one a line. A null or empty page has an empty
text; a cut-off page counts as far as it goes; repeated rows give repeated results; scripts, styles, templates and other
elements that show no text are never read.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, table

# fixed values: element names of the HTML standard
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
SILENT = frozenset("script style template noscript svg canvas object iframe video audio title head noframes xmp".split())
VOID = frozenset("hr br img input meta link col wbr area base embed source track param".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPES = frozenset("ul ol dl table select body div article section main aside nav header footer form blockquote".split())

# fixed values: names that page parts commonly carry; the weak ones stand on main text as often as beside it
OTHER_NAMES = "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert advertisement adslot banner promo promoted sponsored sponsor cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social recommended recommendations trending tagcloud pagination pager comment comments replies disqus masthead topbar copyright disclaimer toolbar skip hidden tracking outbrain taboola teaser widget footer".split()
WEAK_NAMES = "related more header print meta byline author notice alert search popular tags legal side bottom foot reply respond discussion feedback top info note summary".split()
CONTENT_NAMES = "content article post entry story main body text page container wrapper primary single prose markdown copy richtext maintext section inner wrap layout site app root column col row".split()
OTHER_WORDS, WEAK_WORDS, CONTENT_WORDS = frozenset(OTHER_NAMES), frozenset(WEAK_NAMES), frozenset(CONTENT_NAMES)

#: elements that hold blocks: a stretch of text between their blocks is a node of its own
CONTAINERS = frozenset("body div section article main aside nav header footer form center".split())
RUN = "#text"

# an attribute as the HTML standard reads it: quotes may stand in names, a quoted value ends with its quote. A quote that ends
# right after an equals sign, and beyond a ">", opens the next attribute's value: its own value was never closed.
VALUE = r"(?:\"(?:[^\">]*+\"|[^\"]*+(?<!=)\")|'(?:[^'>]*+'|[^']*+(?<!=)')|[^\s\"'>][^\s>]*+)"
PART = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{VALUE})?+|=)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)({PART}*+)>", re.S)
ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({VALUE}))?+", re.S)
WORDS = re.compile(r"[a-z]+")
CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)
ROOT = 50.0  # the body holds the main text
NAMING = frozenset(("class", "id", "role", "itemprop"))


class Page:
    """Block elements of a page with their features' raw material, and its text runs in order."""

    __slots__ = ("tags", "names", "parents", "chars", "links", "texts")

    def __init__(self):
        self.tags, self.names, self.parents = ["body"], [""], [-1]
        self.chars, self.links = [0], [0]
        self.texts: list[tuple[int, str]] = []  # (node, text run)

    def add(self, tag: str, names: str, parent: int) -> int:
        self.tags.append(tag)
        self.names.append(names)
        self.parents.append(parent)
        self.chars.append(0)
        self.links.append(0)
        return len(self.tags) - 1


@lru_cache(maxsize=50_000)
def _names(attributes: str) -> str:
    """What class, id and role say of an element, as features, and a mark for hidden elements.

    A name with a word of another page part speaks for that; a weak word counts only in a name of weak words.
    """
    out, seen = set(), set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in seen:
            continue
        seen.add(key)
        if key in NAMING:
            for name in value.split():
                words = set(WORDS.findall(name))
                if words & OTHER_WORDS:
                    out.add("k:other")
                    out.update(f"n:{w}" for w in words & OTHER_WORDS)
                elif words and words <= WEAK_WORDS:
                    out.add("k:weak")
                elif words & CONTENT_WORDS:
                    out.add("k:content")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.update(("k:other", "n:hidden"))
    return " ".join(sorted(out))


def parse(source: str | None) -> Page:
    """Lenient reading: unclosed and crossing tags as browsers take them, as far as blocks go."""
    page, stack, run, link_chars, link = Page(), [0], [], 0, False
    if not source:
        return page
    source = CUT.sub("", source) if source.rfind("<") > source.rfind(">") else source

    def flush() -> None:
        nonlocal run, link_chars
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                node = stack[-1]
                if page.tags[node] in CONTAINERS:
                    node = page.add(RUN, "", node)
                page.texts.append((node, text))
                page.chars[node] += len(text)
                page.links[node] += min(link_chars, len(text))
            run, link_chars = [], 0

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        begin = m.start() if m else n
        if begin > at:
            piece = source[at:begin]
            run.append(piece)
            if link:
                link_chars += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag in SILENT:
            if not closing and tag != "head" and not m[0].endswith("/>"):
                end = re.compile(f"</{tag}(?=[\\s>/])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            elif tag == "head":
                flush()
            if run:
                run.append(" ")
            continue
        if tag == "a":
            link = not closing
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag not in BLOCKS:
            if tag in ("img", "input", "wbr") and run and tag != "wbr":
                run.append(" ")
            continue
        flush()
        if tag == "body":
            if not closing and not page.names[0]:
                page.names[0] = _names(m[3])
            continue
        if closing:
            link = False
            for i in range(len(stack) - 1, 0, -1):
                own = page.tags[stack[i]]
                if own == tag or (tag[0] == "h" and own[0] == "h" and len(tag) == len(own) == 2 and own != "hr"):
                    del stack[i:]
                    break
                if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and own in SCOPES:
                    break
            continue
        if tag != "label" and tag != "button":
            if page.tags[stack[-1]] == "p":  # a block ends a paragraph
                stack.pop()
        ends = CLOSED_BY.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                own = page.tags[stack[i]]
                if own in ends:
                    del stack[i:]
                    break
                if own in SCOPES and not (own == "table" and tag in ("tbody", "tfoot")):
                    break
        if tag in VOID:
            continue
        node = page.add(tag, _names(m[3]), stack[-1])
        if not m[3].endswith("/"):
            stack.append(node)
    flush()
    return page


def node_features(tag: str, names: str, chars: int, links: int, symbol: bool) -> tuple[str, ...]:
    size = 0 if chars == 0 else 1 if chars < 25 else 2 if chars < 100 else 3 if chars < 400 else 4
    share = links / chars if chars else 0.0
    dense = 0 if share == 0 else 1 if share < 0.35 else 2 if share < 0.75 else 3
    return ("bias", f"t:{tag}", f"s:{size}", f"l:{dense}", f"tl:{tag}:{dense}", *(("c:copyright",) if symbol else ()), *names.split())


def edge_features(parent: str, child: str) -> tuple[str, ...]:
    return ("e", f"e:{parent}", f"e:{parent}>{child}")


class Forest:
    """Nodes of several pages in one numbering, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tags) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + lo) for p, lo in zip(pages, self.first)]) if pages else np.zeros(0, np.int64)
        depth = np.zeros(len(self.parents), np.int64)
        todo = np.flatnonzero(self.parents >= 0)
        while len(todo):  # a node's depth is known when its parent's is
            new = depth[self.parents[todo]] + 1
            moved = new != depth[todo]
            depth[todo] = new
            if not moved.any():
                break
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]


def marginals(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product: P(content) of each node, P(parent's, child's label) of each edge, and the log-partition.

    ``unary`` has a node's log-potential by label, ``edge`` that of the edge to its parent by (parent's, own) label.
    """
    parents = forest.parents
    up = unary.copy()
    message = np.zeros_like(unary)
    for level in reversed(forest.levels):
        inside = up[level][:, None, :] + edge[level]
        top = inside.max(axis=2)
        message[level] = top + np.log(np.exp(inside - top[:, :, None]).sum(axis=2))
        np.add.at(up, parents[level], message[level])
    down = np.zeros_like(unary)
    pair = np.zeros((len(unary), 2, 2))
    for level in forest.levels:
        above = up[parents[level]] - message[level] + down[parents[level]]
        joint = above[:, :, None] + edge[level] + up[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        outside = above[:, :, None] + edge[level]
        top = outside.max(axis=1)
        down[level] = top + np.log(np.exp(outside - top[:, None, :]).sum(axis=1))
    belief = up + down
    belief -= belief.max(axis=1, keepdims=True)
    belief = np.exp(belief)
    belief /= belief.sum(axis=1, keepdims=True)
    roots = np.flatnonzero(parents < 0)
    top = up[roots].max(axis=1)
    total = float((top + np.log(np.exp(up[roots] - top[:, None]).sum(axis=1))).sum())
    return belief[:, 1], pair, total


class Model:
    """Weights of node features (for content) and of edge features (by labels of parent and child)."""

    def __init__(self, nodes: dict[str, float], edges: dict[str, np.ndarray]):
        self.nodes, self.edges = nodes, edges
        self._node: dict[tuple, float] = {}
        self._edge: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return {"nodes": self.nodes, "edges": self.edges, "_node": {}, "_edge": {}}

    def contents(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of each page's nodes."""
        if not pages:
            return []
        forest = Forest(pages)
        score, edge = [], []
        zero = np.zeros((2, 2))
        for page in pages:
            symbols = {node for node, text in page.texts if "©" in text}
            for i, tag in enumerate(page.tags):
                key = node_features(tag, page.names[i], page.chars[i], page.links[i], i in symbols)
                known = self._node.get(key)
                if known is None:
                    known = sum(self.nodes.get(f, 0.0) for f in key)
                    if len(self._node) < 100_000:
                        self._node[key] = known
                score.append(known)
                parent = page.parents[i]
                if parent < 0:
                    edge.append(zero)
                    continue
                pair = (page.tags[parent], tag)
                own = self._edge.get(pair)
                if own is None:
                    own = sum((self.edges[f] for f in edge_features(*pair) if f in self.edges), zero)
                    if len(self._edge) < 100_000:
                        self._edge[pair] = own
                edge.append(own)
        unary = np.zeros((len(score), 2))
        unary[:, 1] = score
        unary[forest.parents < 0, 1] += ROOT
        content, _, _ = marginals(forest, unary, np.array(edge))
        return [content[a:b] for a, b in zip(forest.first[:-1], forest.first[1:])]


# --- labelled pages: 1 marks content, 0 other parts of a page

def labelled_pages(count: int = 420, seed: int = 20_250_101) -> list[tuple[str, list[int]]]:
    """(html, labels of its block elements in order, the body first) of pages drawn from layout rules."""
    draw = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        text = " ".join("".join(draw.choice("aeioubcdfglmnprst") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(lo, hi)))
        return text.capitalize() + draw.choice([".", ".", ".", ":", "?", "", "!"])

    def tag(name: str, label: int, inner: list, names: list[str] | None = None) -> tuple:
        return (name, label, names, inner)

    def link() -> str:
        return f'<a href="/{draw.randint(1, 99)}">{words(1, 3)}</a>'

    def name(pool: list[str]) -> list[str]:
        return [draw.choice(pool)] if draw.random() < 0.9 else [draw.choice(pool), draw.choice(pool)]

    def own_names(share: float) -> list[str] | None:
        """Names as they stand on main text: of its own kind, or weak ones."""
        if draw.random() >= share:
            return None
        return name(CONTENT_NAMES) if draw.random() < 0.6 else name(WEAK_NAMES)

    def paragraph(depth: int = 0) -> tuple:
        kind = draw.random()
        if kind < 0.60:
            lo, hi = draw.choice([(1, 2), (3, 9), (10, 40), (40, 120)])
            text = words(lo, hi)
            if draw.random() < 0.25:
                text = f"<b>{text}</b>"
            if draw.random() < 0.25:
                text += " " + link() + " " + words(1, 8)
            return tag("p", 1, [text], own_names(0.15))
        if kind < 0.70:
            return tag(draw.choice(["h1", "h2", "h3", "h4"]), 1, [words(1, 9)], own_names(0.15))
        if kind < 0.78:
            return tag(draw.choice(["ul", "ol"]), 1, [tag("li", 1, [words(1, 20) if draw.random() < 0.9 else link() + " " + words(2, 9)]) for _ in range(draw.randint(1, 4))], own_names(0.1))
        if kind < 0.82:
            return tag("blockquote", 1, [tag("p", 1, [words(4, 40)])] if draw.random() < 0.6 else [words(4, 40)])
        if kind < 0.85:
            return tag("pre", 1, [words(3, 20)])
        if kind < 0.88:
            return tag("figure", 1, ["<img src=x>", tag("figcaption", 1, [words(2, 9)])])
        if kind < 0.91:
            return tag("table", 1, [tag("tbody", 1, [tag("tr", 1, [tag("td", 1, [words(1, 4)]) for _ in range(2)]) for _ in range(2)])], own_names(0.2))
        if kind < 0.93:
            return tag("dl", 1, [tag("dt", 1, [words(1, 3)]), tag("dd", 1, [words(2, 30)])])
        if kind < 0.97 and depth < 2:
            inside = [paragraph(depth + 1) for _ in range(draw.randint(1, 4))]
            if draw.random() < 0.3:
                inside.insert(draw.randint(0, len(inside)), words(4, 60))
            return tag(draw.choice(["section", "div"]), 1, inside, own_names(0.5))
        return tag("div", 1, [words(5, 60)], own_names(0.4))

    def other(depth: int = 0) -> tuple:
        kind = draw.random()
        names = name(OTHER_NAMES) if draw.random() < 0.85 else name(WEAK_NAMES)
        if kind < 0.15:
            items = [tag("li", 0, [link()]) for _ in range(draw.randint(2, 7))]
            return tag("nav", 0, [tag("ul", 0, items)] if draw.random() < 0.7 else [link() for _ in range(3)], names if draw.random() < 0.4 else None)
        if kind < 0.27:
            return tag("footer", 0, [draw.choice(["&copy; ", "© ", ""]) + words(2, 20)] + ([tag("p", 0, [words(3, 30)])] if draw.random() < 0.4 else []), names if draw.random() < 0.3 else None)
        if kind < 0.37:
            return tag("header", 0, [tag("h1", 0, [words(1, 4)])] if draw.random() < 0.4 else [words(1, 6), link()], names if draw.random() < 0.3 else None)
        if kind < 0.50:
            return tag("aside", 0, [tag("h3", 0, [words(1, 3)]), tag("p", 0, [words(3, 60)])] if draw.random() < 0.6 else [words(3, 30)], names if draw.random() < 0.5 else None)
        if kind < 0.58:
            return tag("form", 0, [tag("label", 0, [words(1, 3)]), tag("p", 0, [words(2, 10)]), tag("button", 0, [words(1, 2)]), tag("select", 0, [tag("option", 0, [words(1, 1)])])][: draw.randint(1, 4)], names if draw.random() < 0.4 else None)
        if kind < 0.70:  # reader comments
            body = [tag("p", 0, [words(3, 60)])]
            single = tag(draw.choice(["div", "li", "article"]), 0, body, ["comment"])
            return tag(draw.choice(["section", "div", "ol"]), 0, [tag("h3", 0, [words(1, 3)]), single, single], [draw.choice(["comments", "replies", "discussion", "respond", "disqus"])])
        inner = [words(2, 40)] if draw.random() < 0.5 else [tag("p", 0, [words(3, 60)])] * draw.randint(1, 2) + ([tag("ul", 0, [tag("li", 0, [link()])] * 3)] if draw.random() < 0.3 else [])
        return tag(draw.choice(["div", "div", "section", "ul", "p"]) if len(inner) == 1 and isinstance(inner[0], str) else draw.choice(["div", "section"]), 0, inner, names)

    def links() -> tuple:
        """A run of links between blocks, as menus without an element of their own are."""
        return tag(RUN, 0, [" ".join(link() for _ in range(draw.randint(1, 6)))])

    def page() -> tuple:
        layout = draw.random()
        if layout < 0.04:  # a text without elements
            return tag("body", 1, [words(1, 200)])
        blocks = [paragraph() for _ in range(draw.randint(1, 9))]
        if draw.random() < 0.7:
            blocks.insert(0, tag("h1", 1, [words(1, 9)]))
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            blocks.insert(draw.randint(1, len(blocks)), other())
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            blocks.insert(draw.randint(0, len(blocks)), words(3, 80))
        if layout < 0.12:  # cells as columns
            menu = tag("td", 0, [link(), "<br>", link(), "<br>", link()] if draw.random() < 0.6 else [tag("ul", 0, [tag("li", 0, [link()]) for _ in range(3)])])
            bar = tag("tr", 0, [tag("td", 0, [" ".join(link() for _ in range(4))])])
            cells = [menu, tag("td", 1, blocks)] if draw.random() < 0.7 else [tag("td", 1, blocks), menu]
            return tag("body", 1, [tag("table", 1, [tag("tbody", 1, [*([bar] if draw.random() < 0.5 else []), tag("tr", 1, cells)])])])
        kind = draw.random()
        if kind < 0.45:
            main = [tag("article", 1, blocks, own_names(0.3))]
        elif kind < 0.65:
            main = [tag("main", 1, blocks if draw.random() < 0.5 else [tag("article", 1, blocks)])]
        elif kind < 0.87:
            main = [tag(draw.choice(["div", "section"]), 1, blocks, name(CONTENT_NAMES))]
        else:
            main = blocks
        if draw.random() < 0.35 and kind < 0.87:
            main = [tag("div", 1, [*[other() for _ in range(draw.randint(0, 1))], *main, *[other() for _ in range(draw.randint(0, 2))]], name(CONTENT_NAMES) if draw.random() < 0.8 else None)]
        if draw.random() < 0.15:
            main.insert(0, links())
        return tag("body", 1, [*[other() for _ in range(draw.randint(0, 3))], *main, *[other() for _ in range(draw.randint(0, 3))]])

    def written(node, labels: list[int]) -> str:
        own, label, names, inner = node
        if own == RUN:
            labels.append(label)
            return inner[0]
        labels.append(label)
        attribute = "" if not names else f' {draw.choice(["class", "class", "id"])}="{"-".join(names) if draw.random() < 0.3 else " ".join(names)}"'
        text, run = [], False
        for x in inner:
            if isinstance(x, str):
                if own in CONTAINERS and not run:
                    labels.append(label)
                text.append(x)
                run = True
            else:
                text.append(written(x, labels))
                run = x[0] == RUN
        return f"<{own}{attribute}>" + " ".join(text) + f"</{own}>"

    out = []
    for _ in range(count):
        labels: list[int] = []
        out.append((written(page(), labels), labels))
    return out


def fit(pages: list[tuple[str, list[int]]], rounds: int = 260, ridge: float = 0.002, rate: float = 0.25) -> Model:
    """Gradient ascent (with momentum scaled by running squares) on the ridge log-likelihood."""
    parsed = [parse(source) for source, _ in pages]
    kept = [(p, labels) for p, (_, labels) in zip(parsed, pages) if len(p.tags) == len(labels)]
    forest = Forest([p for p, _ in kept])
    truth = np.concatenate([labels for _, labels in kept])
    node_names: dict[str, int] = {}
    edge_names: dict[str, int] = {}
    rows, cols, edge_rows, edge_cols = [], [], [], []
    at = 0
    for page, _ in kept:
        symbols = {node for node, text in page.texts if "©" in text}
        for i, tag in enumerate(page.tags):
            for f in node_features(tag, page.names[i], page.chars[i], page.links[i], i in symbols):
                rows.append(at)
                cols.append(node_names.setdefault(f, len(node_names)))
            if page.parents[i] >= 0:
                for f in edge_features(page.tags[page.parents[i]], tag):
                    edge_rows.append(at)
                    edge_cols.append(edge_names.setdefault(f, len(edge_names)))
            at += 1
    rows, cols, edge_rows, edge_cols = (np.array(x) for x in (rows, cols, edge_rows, edge_cols))
    w, v = np.zeros(len(node_names)), np.zeros((len(edge_names), 2, 2))
    child = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((at, 2, 2))
    seen[child, truth[forest.parents[child]], truth[child]] = 1
    m1, m2, s1, s2 = np.zeros_like(w), np.zeros_like(v), np.zeros_like(w), np.zeros_like(v)
    for step in range(1, rounds + 1):
        unary = np.zeros((at, 2))
        unary[:, 1] = np.bincount(rows, w[cols], at)
        unary[forest.parents < 0, 1] += ROOT
        edge = np.zeros((at, 2, 2))
        np.add.at(edge, edge_rows, v[edge_cols])
        content, pair, _ = marginals(forest, unary, edge)
        g = np.bincount(cols, (truth - content)[rows], len(w)) / len(kept) - ridge * w
        h = np.zeros_like(v)
        np.add.at(h, edge_cols, (seen - pair)[edge_rows])
        h = h / len(kept) - ridge * v
        for weights, gradient, mean, square in ((w, g, m1, s1), (v, h, m2, s2)):
            mean *= 0.9
            mean += 0.1 * gradient
            square *= 0.99
            square += 0.01 * gradient**2
            weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-3)
    return Model({f: float(w[i]) for f, i in node_names.items()}, {f: v[i] for f, i in edge_names.items()})


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract(model: Model, sources: list[str | None], threshold: float = 0.5) -> list[str]:
    """The main texts of pages."""
    pages = [parse(s) for s in sources]
    out = []
    for page, content in zip(pages, model.contents(pages)):
        out.append("\n".join(text for node, text in page.texts if content[node] >= threshold))
    return out


def main_text(spark, model: Model | None = None):
    """Arrow UDF: the main text of a page."""
    shared = spark.sparkContext.broadcast(model or trained())

    @F.arrow_udf("string")
    def text(sources: pa.Array) -> pa.Array:
        out: list[str] = []
        for lo in range(0, len(sources), 256):
            out += extract(shared.value, sources.slice(lo, 256).to_pylist())
        return pa.array(out, pa.string())

    return text


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    out = pages.select("page_id", "url", main_text(pages.sparkSession)(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op8_html_extraction")
def op8(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
