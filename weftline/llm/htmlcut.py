"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes blocks: maximal stretches of text between block-level tags. A
logistic model, trained here on small generated pages with known labels, gives
each block a probability of being content; its log odds are the block's terminal
capacities. Neighbouring blocks are joined by smoothness edges, stronger the
nearer they are in the tree: same parent, or few steps through a common
ancestor. The minimum cut, found by max-flow, labels blocks as content or
boilerplate at the least total cost.

Names of elements (classes, ids, roles) are evidence, word by word, but not those
of the page's principal element, its largest main or article, nor of what holds
it: a wrapper or body may well be named after the sidebar that it has room for.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*')*+)>", re.S)
_CLASS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NO_DISPLAY = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is code or data; it is never text.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "noframes", "xmp"}
#: Elements without content; void br ends no block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Inline elements: their text belongs to the block around them.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are never content, whatever the model says of their text; forms only if they do not hold the article.
OUTSIDE = {"head", "select", "option", "button", "object", "svg", "math", "audio", "video", "canvas", "datalist", "dialog", "noscript"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = {"p", "blockquote", "pre", "li", "td", "dd", "figcaption", *_HEADINGS}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", *_HEADINGS}
_CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}} | dict.fromkeys(_CLOSES_P, {"p"})
_BAD_TAGS = {"nav", "footer", "aside", "menu", "header"}
_GOOD_TAGS = {"article", "main"}
# Words in the names of boilerplate, of comments, of content, and words that may stand beside them in a name.
_COMMENTS = {"comment", "comments", "commenter", "disqus", "replies", "reply", "respond", "responses"}
_BAD_WORDS = _COMMENTS | {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "banners", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookiebar", "cookieconsent", "cookienotice", "cookies", "dialog", "footer", "gdpr", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promos", "promotion", "recommended", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "sponsors", "subnav", "subscribe", "subscription", "toolbar", "topnav", "widget", "widgets"}
_HEADER = {"header"}
_GOOD_WORDS = {"article", "articles", "body", "content", "entry", "hentry", "main", "post", "story", "text"}
_PLAIN_WORDS = _GOOD_WORDS | {"area", "bar", "block", "bottom", "box", "buttons", "col", "column", "container", "global", "group", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "outer", "page", "panel", "posts", "primary", "reader", "region", "right", "row", "secondary", "section", "site", "slot", "stories", "thread", "top", "unit", "user", "wrap", "wrapper", "zone"}
_OWN_HEADER = {"article", "content", "entry", "page", "post", "section", "story", "title"}
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|[0-9]+")

#: Capacities are integers: log odds and smoothness times this.
_UNIT = 100
_LIMIT = 12.0
#: Smoothness of two neighbouring blocks at a tree distance: SMOOTH / distance.
SMOOTH = 1.5
#: Tree distance from which two blocks are not joined.
FAR = 13
#: Tree distance from which two blocks are not joined.
FAR = 13
#: Tree distance from which two blocks are not joined.
FAR = 13
_FEATURES = ("bias", "bad_tag", "bad_name", "good_tag", "good_name", "prose", "heading", "list_item", "links", "words", "stops", "copyright")


class Node:
    """An element that is not inline, with what its own tag and names tell, and what it holds."""

    __slots__ = ("tag", "parent", "depth", "chars", "kinds", "form", "good", "bad", "bad_name", "good_name", "outside")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.chars = tag, parent, 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.kinds = name_kinds(names) if names and tag not in ("html", "body") else ""
        self.good = self.bad = self.bad_name = self.good_name = self.outside = False


class Node:
    """An element that is not inline, with what its own tag and names tell, and what it holds."""

    __slots__ = ("tag", "parent", "depth", "chars", "kinds", "form", "good", "bad", "bad_name", "good_name", "outside")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.chars = tag, parent, 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.kinds = name_kinds(names) if names and tag not in ("html", "body") else ""
        self.good = self.bad = self.bad_name = self.good_name = self.outside = False


class Node:
    """An element that is not inline, with what its own tag and names tell, and what it holds."""

    __slots__ = ("tag", "parent", "depth", "chars", "kinds", "form", "good", "bad", "bad_name", "good_name", "outside")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.chars = tag, parent, 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.kinds = name_kinds(names) if names and tag not in ("html", "body") else ""
        self.good = self.bad = self.bad_name = self.good_name = self.outside = False


class Block:
    __slots__ = ("node", "text", "link_chars")

    def __init__(self, node: Node, text: str, link_chars: int):
        self.node, self.text, self.link_chars = node, text, link_chars


@lru_cache(1 << 16)
def name_kinds(names: str) -> str:
    """What the words of names stand for: b(oilerplate), c(omments, also b), h(eader), g(ood).

    A name counts if all its words are known: a "cookie-notice" is one, something
    that "has-sidebar" is not a sidebar.
    """
    out = set()
    for name in names.split():
        words = [x.lower() for x in _PARTS.findall(name)]
        if not words or "".join(words) != re.sub(r"[-_]", "", name).lower():
            continue
        known = lambda some: any(w in some for w in words) and all(w in some or w in _PLAIN_WORDS or w.isdigit() for w in words)  # noqa: B023, E731
        if known(_BAD_WORDS | _HEADER):
            if any(w in _BAD_WORDS for w in words):
                out |= {"b", "c"} if known(_COMMENTS) else {"b"}
            elif not any(w in _OWN_HEADER for w in words):
                out.add("h")
        elif any(w in _GOOD_WORDS for w in words):
            out.add("g")
        if name.lower() == "main":
            out.add("m")
    return "".join(sorted(out))


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; broken markup is closed the way browsers do in simple cases."""
    out: list[Block] = []
    nodes = [Node("", None)]
    stack: list[tuple[str, Node, bool]] = []  # tag, its node or that of the block around it, whether it is outside
    solid: list[int] = []  # places in the stack of elements that are not inline
    places: dict[str, list[int]] = {}  # places in the stack by tag
    parts: list[str] = []
    links, in_link, outside, at = 0, 0, 0, 0

    def node() -> Node:
        return stack[-1][1] if stack else nodes[0]

    def end_block() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block(node(), text, links))
            node().chars += len(text)
        parts.clear()
        links = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link, outside
        while len(stack) > depth:
            tag, own, out_of = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                solid.pop()
                own.parent.chars += own.chars
            in_link -= tag == "a"
            outside -= out_of

    def add(text: str) -> None:
        nonlocal links
        if text and not outside:
            parts.append(text)
            if in_link:
                links += len(text)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, inline = tag.lower(), tag.lower() in INLINE
        if tag == "br":
            add(" ")
            continue
        if not inline:
            end_block()
        if m[1]:
            # an inline end tag does not reach out of its block
            if places.get(tag) and (not inline or not solid or places[tag][-1] > solid[-1]):
                pop_to(places[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[0].endswith("/>") and tag in {"svg", "path"}:
            continue
        if closes := _CLOSES.get(tag):
            for place in reversed(solid):
                if stack[place][0] in closes:
                    pop_to(place)
                    break
                if stack[place][0] != "p":
                    break
        attributes = m[3] or ""
        hidden = bool(attributes) and not inline and (_NO_DISPLAY.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes))) is not None
        own = node()
        if not inline:
            own = Node(tag, own, " ".join(a or b or c for a, b, c in _CLASS.findall(attributes)) if attributes else "")
            nodes.append(own)
            solid.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        out_of = tag in OUTSIDE or hidden
        stack.append((tag, own, out_of))
        in_link += tag == "a"
        outside += out_of
    end_block()
    pop_to(0)
    _inherit(nodes, out)
    return [x for x in out if not x.node.outside]


def _inherit(nodes: list[Node], found: list[Block]) -> None:
    """What each node has from its ancestors; parents come before their children."""
    root = nodes[0]
    mains = [x for x in nodes if x.tag == "main" or "m" in x.kinds]
    under = {root: False}
    for x in nodes[1:]:
        under[x] = under[x.parent] or "c" in x.kinds
    articles = [x for x in nodes if x.tag == "article" and not under[x]]
    principal = max(mains or articles, key=lambda x: x.chars, default=None)
    if principal is None:  # where the page's heading is
        principal = next((b.node.parent for b in found if b.node.tag == "h1"), None)
    above, x = set(), principal
    while x is not None:
        above.add(x)
        x = x.parent
    prose = {b.node for b in found if b.text.count(" ") >= 24}
    long_form = set()
    for x in prose:
        while x is not None and x not in long_form:
            long_form.add(x)
            x = x.parent
    for x in nodes[1:]:
        p = x.parent
        own = "" if x in above else x.kinds
        x.good = p.good or x.tag in _GOOD_TAGS or "m" in x.kinds
        # a header inside an article is part of it
        x.bad = p.bad or x.tag in _BAD_TAGS and not (x.tag == "header" and p.good)
        x.bad_name = p.bad_name or "b" in own or "h" in own and not p.good
        x.good_name = p.good_name or "g" in x.kinds
        # a form that the whole page is in, as some servers write it, is not a form to fill in
        whole = x in above and bool(mains or articles) or 4 * x.chars > 3 * root.chars and x in long_form
        x.outside = p.outside or x.tag == "form" and not whole


def features(block: Block) -> list[float]:
    node, size = block.node, len(block.text)
    words = block.text.count(" ") + 1
    return [
        1.0,
        float(node.bad),
        float(node.bad_name),
        float(node.good),
        float(node.good_name),
        float(node.tag in _PROSE),
        float(node.tag in _HEADINGS),
        float(node.tag == "li"),
        min(1.0, block.link_chars / size),
        math.log1p(words) / 5,
        min(5, len(re.findall(r"[.!?](?:\s|$)", block.text))) / 5,
        float("©" in block.text or "copyright" in block.text.lower()),
    ]


def _examples(seed: int = 3) -> Iterator[tuple[str, bool]]:
    """Generated pages, a marked fragment at a time: html of one region, and whether it is content."""
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(n))
    sentences = lambda n: " ".join(words(int(rng.integers(4, 18))).capitalize() + "." for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/x">{words(int(rng.integers(1, 3)))}</a></li>' for _ in range(n))
    para = lambda: f"<p>{sentences(int(rng.integers(1, 6)))}</p>"
    for k in range(60):
        body = f"<h1>{words(5)}</h1>" + "".join(para() for _ in range(int(rng.integers(1, 6)))) + f"<ul><li>{sentences(1)}</li></ul><blockquote>{sentences(2)}</blockquote><h2>{words(3)}</h2>" + para()
        yield (f"<article>{body}</article>", f"<main><article><header><h1>{words(4)}</h1></header>{body}</article></main>", f'<div class="post-content">{body}</div>', f'<div id="main"><div class="entry">{body}</div></div>', f"<div>{body}</div>", f"{body}")[k % 6], True
        yield f"<div>{sentences(1)}</div>{words(int(rng.integers(2, 8)))}", True
        yield f"<nav><ul>{links(5)}</ul></nav>", False
        yield f'<div class="menu"><ul>{links(4)}</ul></div>', False
        yield f"<header><div>{words(3)}</div><p>{words(6)}</p></header>", False
        yield f"<footer><p>&copy; {words(3)}. {sentences(1)}</p><p>{sentences(2)}</p></footer>", False
        yield f"<aside><h3>{words(2)}</h3><p>{sentences(int(rng.integers(1, 4)))}</p></aside>", False
        yield f'<div class="{rng.choice(["ad", "advert", "sidebar", "cookie-notice", "newsletter", "comments", "related", "share", "promo banner"])}"><p>{sentences(int(rng.integers(1, 5)))}</p><div>{sentences(1)}</div></div>', False
        yield f'<section id="comments"><h3>{words(2)}</h3><div class="comment"><p>{sentences(int(rng.integers(1, 5)))}</p></div></section>', False
        yield f'<article><div class="comments"><p>{sentences(2)}</p></div><aside><p>{sentences(2)}</p></aside><footer><p>{words(5)}</p></footer></article>', False
        inner = f'<div class="{rng.choice(["ad", "newsletter-box", "related", "share", "promo banner", "sponsored"])}"><p>{sentences(int(rng.integers(1, 6)))}</p></div>'
        yield (f"<article>{inner}</article>", f'<div class="post-content">{inner}</div>', f'<main><div class="entry">{inner}</div></main>')[k % 3], False
        yield f"<div><a href='/x'>{words(2)}</a> | <a href='/y'>{words(2)}</a></div>", False


@lru_cache(1)
def train(steps: int = 2000, rate: float = 2.0) -> np.ndarray:
    """Weights of the block model, by gradient descent on the generated pages."""
    rows = [(features(b), good) for page, good in _examples() for b in blocks(page)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (balance * (p - y)) / len(y) + 1e-4 * w)
    return w


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; Dinic's max-flow on integer capacities.

    source and sink: terminal capacities of each node; edges: (u, v, capacity) in both directions.
    """
    n = len(source)
    s, t = n, n + 1
    to, cap, graph = [], [], [[] for _ in range(n + 2)]

    def arc(u: int, v: int, there: int, back: int) -> None:
        graph[u].append(len(to))
        to.append(v)
        cap.append(there)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            arc(s, i, source[i] - both, 0)
        elif sink[i] > both:
            arc(i, t, sink[i] - both, 0)
    for u, v, c in edges:
        if c:
            arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        begin = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while begin[u] < len(graph[u]):
                e = graph[u][begin[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                begin[u] += 1
            if begin[u] < len(graph[u]):
                path.append(graph[u][begin[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def distance(a: Block, b: Block) -> int:
    """One and the steps in the tree between the parents of two blocks; FAR or more are not counted on."""
    x, y, steps = a.node.parent or a.node, b.node.parent or b.node, 0
    while x is not y and steps < FAR:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 1 + steps


def extract(page: str, weights: np.ndarray) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page)
    if not found:
        return ""
    x = np.array([features(b) for b in found])
    odds = np.clip(x @ weights, -_LIMIT, _LIMIT)
    source = [int(v * _UNIT) if v > 0 else 0 for v in odds]
    sink = [int(-v * _UNIT) if v < 0 else 0 for v in odds]
    edges = [(i, i + 1, int(SMOOTH * _UNIT / distance(found[i], found[i + 1]) ** 2)) for i in range(len(found) - 1)]
    seen: dict[Node | None, int] = {}
    for i, b in enumerate(found):  # siblings further apart
        last = seen.get(b.node.parent)
        if last is not None and last < i - 1:
            edges.append((last, i, int(SMOOTH * _UNIT / 4)))
        seen[b.node.parent] = i
    return "\n".join(b.text for b, keep in zip(found, min_cut(source, sink, edges), strict=True) if keep)


def _extract(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in chunks(batches, 2):
            texts = [extract(x, weights) for x in pages]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty html, and pages without text, have the empty text. Each page
    is labelled alone, so repeated rows have equal results. Other columns are
    ignored. An empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract(train()), f"page_id {kind}, url string, text string, n_chars long")
