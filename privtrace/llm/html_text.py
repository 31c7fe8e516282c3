"""Main text of web pages: gradient-boosted trees over the nodes of the page, decoded down the tree.

A page is read into a tree of elements. Every element that holds text gets a
vector of features: its own and its ancestors' tag and attribute tokens, text
and link density of its subtree, depth, place among its siblings and how these
look. Boosted trees give each element the probability that it holds main text.
Decoding takes the most probable choice for the whole tree under the condition
that an element is kept only if all its ancestors are: sums of log
probabilities go up the tree, the choices come down. Text that stands beside
blocks in one element counts as an element of its own.

The trees are fitted to elements of a bounded sample of pages. Their labels
come from the pages' own semantic markup where it is unambiguous (inside
``article`` or ``main``, or inside ``nav``, ``footer``, ``aside``, ``form`` and
their like). Copies of the sampled trees in which these tags are replaced by
plain containers with usual class names, and in which boilerplate is put inside
the article, make the other features carry the same knowledge. If no sampled
page is marked in this way, the paragraphs of each stand for its article; if
there is nothing to learn from at all, everything is kept.

Cases: null and empty html give an empty text and 0. Broken markup is read as
browsers do where it matters: unclosed elements end with their parent, a new
block closes an open paragraph, a head ends at what cannot stand in it, the end
tag of a script-like element closes what is open inside, a comment, script or style without an end takes
the rest. Pages of any length are read whole. Repeated rows give repeated
results, an empty table an empty one.
"""
from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_texts, texts

#: Pages the fit uses at most, the first by a hash of their id and html.
MAX_PAGES = 300
ROUNDS = 40
DEPTH = 4
RATE = 0.3
BINS = 32

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of these, the ones that part words.
BREAKS = frozenset("br hr".split())
RAW = frozenset("script style noscript template iframe textarea select option head title annotation annotation-xml desc metadata".split())
#: What can stand in a head; the first other element, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
TEXT_ONLY = frozenset("script style textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())

# tokens of class, id and role that speak for or against main text
GOOD = "article body content entry main post story text".split()
BAD = ("ad ads advert advertisement alert author banner breadcrumb breadcrumbs bottom byline categories comment comments consent cookie cookies copyright "
       "date disqus footer form gdpr head header hidden legal links masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination "
       "popup promo promoted recommended related reply replies respond share sharing sidebar signup site skip social sponsor sponsored subscribe "
       "subscription tags teaser toolbar top tracking trending warning widget").split()
TAGS = ("article main section div p h1 h2 h3 ul ol li table td pre blockquote span a header nav footer aside form figure figcaption dl button label "
        "dialog body").split()
MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav footer aside form header dialog menu button label fieldset search".split())

# a quoted value stands behind an equals sign only; no part of a tag is tried twice
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>", re.S)
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENDS = {t: re.compile(f"</{t}\\s*>", re.I) for t in TEXT_ONLY}
_TOKEN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element, or a piece of text (``tag`` is empty)."""

    __slots__ = ("tag", "tokens", "hidden", "parent", "kids", "text", "size", "links", "place", "elements", "paragraphs", "items")

    def __init__(self, tag: str, parent: Node | None, text: str = ""):
        self.tag, self.parent, self.text = tag, parent, text
        self.tokens: frozenset[str] = frozenset()
        self.hidden = False
        self.kids: list[Node] = []
        self.size = self.links = self.place = self.elements = self.paragraphs = self.items = 0


def _attributes(node: Node, text: str) -> None:
    if not text or "=" not in text and "hidden" not in text:
        return
    words = []
    for name, a, b, c in _ATTR.findall(text):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += _TOKEN.findall(_CAMEL.sub(" ", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            node.hidden = True
    node.tokens = frozenset(w.lower() for w in words)


_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table body html article section div main".split())


def _pieces(page: str):
    """(end of the text, tag or None, start of the text) in page order, in time linear in the page.

    Comments without an end, and script-like elements without one, take the
    rest. A ``<`` that no ``>`` follows is text. If a tag's quotes leave it
    without an end, that and all later tags end at their first ``>``.
    """
    begin = at = 0
    n, last, loose = len(page), page.rfind(">"), False
    while (i := page.find("<", at)) >= 0:
        after = page[i + 1:i + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():
            whole = page.startswith("<!--", i)
            end = page.find("-->" if whole else ">", i + (4 if whole else 1))
            if end < 0 and not whole:
                break
            yield i, None, begin
            begin = at = n if end < 0 else end + (3 if whole else 1)
            continue
        if not after.lstrip("/")[:1].isalpha() or not after.lstrip("/")[:1].isascii():
            at = i + 1
            continue
        if i > last:
            break
        m = None if loose else _TAG.match(page, i)
        if m is None:
            loose, m = True, _ANY_TAG.match(page, i)
        yield i, m, begin
        begin = at = m.end()
        tag = m[2].lower()
        if not m[1] and tag in TEXT_ONLY:
            end = _ENDS[tag].search(page, at)
            begin = at = end.end() if end else n
    yield n, None, begin


def parse(page: str) -> Node:
    """The tree of a page."""
    root = node = Node("#root", None)
    n = len(page)
    for stop, m, begin in _pieces(page):
        if stop > begin:
            if node.tag == "head" and not page[begin:stop].isspace():
                node = node.parent
            node.kids.append(Node("", node, page[begin:stop]))
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up.parent is not None and up.tag != tag:
                # an end tag of an inline element doesn't reach beyond the block it stands in
                if up.tag in BLOCK and tag not in BLOCK and tag not in RAW:
                    up = root
                    break
                up = up.parent
            if up.tag == tag and up.parent is not None:
                node = up.parent
            continue
        if node.tag == "head" and tag not in IN_HEAD:
            node = node.parent
        if tag in BLOCK:  # a new block ends an open paragraph, with what is open in it
            up = node
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p" and tag not in ("html", "body"):
                node = up.parent
        if tag in _CLOSES:
            up = node
            while up.parent is not None and up.tag not in _CLOSES[tag] and up.tag not in _HOLDS:
                up = up.parent
            if up.tag in _CLOSES[tag] and up.parent is not None:
                node = up.parent
        new = Node(tag, node)
        _attributes(new, m[3])
        node.kids.append(new)
        if tag not in TEXT_ONLY and tag not in VOID and not m[3].endswith("/"):
            node = new
    return root


def _measure(root: Node) -> None:
    """Text and link sizes, and counts of children, of all subtrees."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if k.tag and k.tag not in RAW]
    for node in reversed(order):
        size = links = elements = paragraphs = items = place = 0
        for kid in node.kids:
            tag = kid.tag
            kid.place = place
            place += 1
            if not tag:
                kid.size = len(kid.text.strip())
                size += kid.size
                continue
            size += kid.size
            links += kid.links
            elements += 1
            paragraphs += tag == "p"
            items += tag == "li" or tag == "a"
        node.size, node.links = size, size if node.tag == "a" else links
        node.elements, node.paragraphs, node.items = elements, paragraphs, items


_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_DENSE = 24
FEATURES = len(TAGS) + _DENSE
_NONE = (0, 0, 0, 0)


def above(node: Node, passed: tuple) -> tuple:
    """What an element hands down: good and bad tokens, main and side tags, its own among them."""
    good, bad, main, side = passed
    if node.tokens:
        good += len(node.tokens & _GOOD)
        bad += len(node.tokens & _BAD)
    return good, bad, main + (node.tag in MAIN_TAGS), side + (node.tag in SIDE_TAGS)


def dense(node: Node, depth: int, page_size: int, passed: tuple) -> tuple:
    """An element's features, but for its tag."""
    parent, size, tokens = node.parent, node.size, node.tokens
    if parent is None:
        mates, around, before, behind, near = 1, size, 0, 0, (0, 0, 0.0)
    else:
        kids, i = parent.kids, node.place
        mates, around = len(kids), parent.size
        before = min(kids[i - 1].size, 300) if i else 0
        behind = min(kids[i + 1].size, 300) if i + 1 < mates else 0
        near = (min(parent.paragraphs, 5), min(parent.items, 10), parent.links / around if around else 0.0)
    return (
        len(tokens & _GOOD) if tokens else 0, len(tokens & _BAD) if tokens else 0, len(tokens), node.hidden, *passed,
        min(size, 1000), node.links / size if size else 0.0, size / (page_size or 1), size / (around or 1),
        min(depth, 8), min(mates, 30), min(node.elements, 20), min(node.paragraphs, 10), min(node.items, 10),
        min(size / (1 + node.elements), 1000), before, behind, *near, parent is not None and parent.tag == "body")


def matrix(listed: list[tuple[Node, int, tuple]]) -> np.ndarray:
    """The features of a page's listed elements."""
    page_size = listed[0][0].size
    x = np.zeros((len(listed), FEATURES))
    x[:, len(TAGS):] = [dense(n, d, page_size, p) for n, d, p in listed]
    for i, (n, _, _) in enumerate(listed):
        j = _TAG_AT.get(n.tag)
        if j is not None:
            x[i, j] = 1.0
    return x


@dataclass
class Boosted:
    """Boosted trees as arrays of equal length: feature (-1 in leaves), limit, left child, value."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, v, nxt, value in zip(self.feature, self.limit, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = f[at]
                right = x[rows, np.maximum(split, 0)] > v[at]
                at = np.where(split >= 0, nxt[at] + right, at)
            total += value[at]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    """Newton-boosted trees on binned features, logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, limit, left, value = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, own, depth = todo.pop()
            gs, hs = g[own].sum(), h[own].sum()
            value[at] = RATE * float(gs / (hs + 1.0))
            best = (1e-3, -1, 0)
            if depth < DEPTH and len(own) >= 8:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                margin[own] += value[at]
                continue
            _, j, k = best
            first = len(feature)
            feature += [-1, -1]
            limit += [0.0, 0.0]
            left += [0, 0]
            value += [0.0, 0.0]
            feature[at], limit[at], left[at] = j, float(edges[j][k]), first
            go = binned[own, j] <= k
            todo += [(first, own[go], depth + 1), (first + 1, own[~go], depth + 1)]
        trees.append((feature, limit, left, value))
    most = max([1, *(len(t[0]) for t in trees)])
    pad = lambda k, kind: np.array([t[k] + [0 if k else -1] * (most - len(t[k])) for t in trees], kind).reshape(len(trees), most)
    return Boosted(start, pad(0, np.int64), pad(1, np.float64), pad(2, np.int64), pad(3, np.float64))


_LOOSE = "#text"


def settle(root: Node) -> list[tuple[Node, int, tuple]]:
    """The elements to judge, parents first, each with its depth and what it inherits.

    Text beside blocks is wrapped first. Inline elements without tokens go with
    the element they stand in; elements without text are left out.
    """
    todo = [root]
    while todo:
        node = todo.pop()
        kids = [k for k in node.kids if k.tag and k.tag not in RAW]
        if len(kids) < len(node.kids) and any(k.tag in BLOCK for k in kids):
            for i, k in enumerate(node.kids):
                if not k.tag and not k.text.isspace():
                    loose = Node(_LOOSE, node)
                    k.parent = loose
                    loose.kids = [k]
                    node.kids[i] = loose
        todo += kids
    _measure(root)
    out, todo = [], [(root, 0, _NONE)]
    while todo:
        node, depth, passed = todo.pop()
        if node.tag in RAW or not node.size:
            continue
        out.append((node, depth, passed))
        down = above(node, passed)
        inner = list(node.kids)
        while inner:
            kid = inner.pop()
            if not kid.tag or not kid.size:
                continue
            if kid.tag in BLOCK or kid.tokens or kid.hidden or kid.tag == _LOOSE or kid.elements and _holds_block(kid):
                todo.append((kid, depth + 1, down))
            elif kid.elements:
                inner += kid.kids
    return out


def _holds_block(node: Node) -> bool:
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if k.tag in BLOCK:
                return True
            if k.elements:
                todo.append(k)
    return False


def decode(listed: list[tuple[Node, int, tuple]], margins: np.ndarray) -> tuple[set[int], set[int]]:
    """The kept and the dropped elements, by ``id``: the likeliest choice in which no kept element has a dropped ancestor."""
    place = {id(n): i for i, (n, _, _) in enumerate(listed)}
    yes, no = (-np.logaddexp(0, -margins)).tolist(), (-np.logaddexp(0, margins)).tolist()
    up = []
    for n, _, _ in listed:
        n = n.parent
        while n is not None and id(n) not in place:
            n = n.parent
        up.append(place[id(n)] if n is not None else -1)
    # children stand behind their parents
    for i in range(len(listed) - 1, 0, -1):
        yes[up[i]] += max(yes[i], no[i])
        no[up[i]] += no[i]
    kept, dropped = set(), set()
    for i, (n, _, _) in enumerate(listed):
        fine = (i == 0 or id(listed[up[i]][0]) in kept) and yes[i] > no[i]
        (kept if fine else dropped).add(id(n))
    return kept, dropped


def render(root: Node, dropped: set[int]) -> str:
    """The text outside the dropped elements (given by ``id``), one line per block."""
    lines: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            line = " ".join("".join(run).split())
            if line:
                lines.append(line)
            run.clear()

    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, leave = todo.pop()
        if leave:
            close()
        elif not node.tag:
            run.append(_html.unescape(node.text))
        elif node.tag in VOID:
            run.append(" " if node.tag in BREAKS else "")
        elif id(node) not in dropped and node.tag not in RAW:
            if node.tag in BLOCK:
                close()
                todo.append((node, True))
            todo += [(k, False) for k in reversed(node.kids)]
        elif node.tag in BLOCK:
            close()
    close()
    return "\n".join(lines)


def extract(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page; the trees of a few hundred pages are judged together."""
    out = []
    for first in range(0, len(pages), 200):
        trees = [parse(p) for p in pages[first:first + 200]]
        listed = [settle(t) for t in trees]
        x = [matrix(some) for some in listed if some]
        margins, at = model.margins(np.concatenate(x)) if x else np.empty(0), 0
        for root, some in zip(trees, listed, strict=True):
            dropped = decode(some, margins[at:at + len(some)])[1] if some else set()
            at += len(some)
            out.append(render(root, dropped))
    return out


# ---- the fit -------------------------------------------------------------------------------------------------

def marked(page: str) -> tuple[list[Node], list[Node]] | None:
    """The parts of a page with unambiguous markup: the article's children, and the elements beside it."""
    root = parse(page)
    settle(root)
    mains, sides, todo = [], [], [root]
    while todo:
        node = todo.pop()
        if node.tag in MAIN_TAGS:
            mains.append(node)
        elif node.tag in SIDE_TAGS or _BAD & node.tokens:
            sides.append(node)
        elif node.tag and node.tag not in RAW:
            todo += reversed(node.kids)
    if len(mains) != 1:
        return None
    return mains[0].kids, sides


def _copy(node: Node, parent: Node | None) -> Node:
    top = Node(node.tag, parent, node.text)
    todo = [(node, top)]
    while todo:
        old, new = todo.pop()
        new.tokens, new.hidden = old.tokens, old.hidden
        new.kids = [Node(k.tag, new, k.text) for k in old.kids]
        todo += zip(old.kids, new.kids)
    return top


def _box(tag: str, tokens: str, kids: list[Node]) -> Node:
    new = Node(tag, None)
    new.tokens = frozenset(tokens.split())
    new.kids = [_copy(k, new) for k in kids]
    return new


def _words(text: str, tag: str = "p", tokens: str = "") -> Node:
    new = _box(tag, tokens, [])
    new.kids = [Node("", new, text)]
    return new


_SIDE_BOXES = (
    ("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "nav"), ("footer", ""), ("div", "footer"), ("div", "site footer"), ("aside", ""), ("div", "sidebar"),
    ("div", "ad"), ("div", "advert"), ("div", "banner"), ("section", "comments"), ("div", "comments"), ("ol", "comment list"), ("div", "comment"),
    ("div", "related posts"), ("div", "share"), ("div", "social links"), ("div", "newsletter"), ("form", ""), ("header", ""), ("div", "header"),
    ("div", "cookie notice"), ("div", "notice"), ("div", "promo"), ("div", "breadcrumbs"), ("div", "popup"), ("section", "related"), ("div", "copyright"),
    ("p", "copyright"), ("p", "notice"), ("p", "ad"), ("div", "sponsored"), ("section", "sidebar"), ("div", "widget"), ("dialog", ""), ("div", "alert"))
_MAIN_BOXES = (
    ("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post content"), ("div", "entry content"), ("section", "story"), ("div", ""), ("div", "main"),
    ("article", "post"), ("div", "post"), ("section", ""), ("div", "text"))


def paragraphs(page: str) -> list[Node]:
    """The texts of a page's paragraphs, or of its longer pieces where it has none."""
    root = parse(page)
    texts_ = [" ".join(_html.unescape(n.text).split()) for n in _texts(root)]
    inside = [" ".join(_html.unescape(n.text).split()) for n in _texts(root) if n.parent is not None and n.parent.tag == "p"]
    return [_words(t) for t in inside or [t for t in texts_ if len(t) >= 40] if t]


def variants(page: str, rng: np.random.Generator, spare: list[str], unmarked: bool = False) -> list[tuple[Node, dict[int, int]]]:
    """Trees made from a page's parts, with the label of every element that has one.

    A page without markup has none, unless its paragraphs are to stand for the article (``unmarked``).
    """
    parts = marked(page)
    if parts is None and unmarked:
        body = paragraphs(page)
        parts = (body, []) if body else None
    if parts is None:
        return []
    body, sides = parts
    out = []
    for turn in range(4):
        label: dict[int, int] = {}
        holder = _box("article", "", body) if turn == 0 else _box(*_MAIN_BOXES[int(rng.integers(len(_MAIN_BOXES)))], body)
        boxes = [_box(s.tag, " ".join(s.tokens), s.kids) for s in sides]
        inside: list[Node] = []
        if turn:
            for _ in range(int(rng.integers(3, 8))):
                tag, tokens = _SIDE_BOXES[int(rng.integers(len(_SIDE_BOXES)))]
                texts_ = [spare[int(rng.integers(len(spare)))] for _ in range(int(rng.integers(1, 5)))]
                shape = int(rng.integers(4))
                if tag == "p" or shape == 0:
                    box = _words(texts_[0], tag, tokens)
                elif shape == 1:
                    box = _box(tag, tokens, [_box("ul", "", [_box("li", "", [_words(" ".join(t.split()[:3]), "a")]) for t in texts_])])
                elif shape == 2:
                    box = _box(tag, tokens, [_box("div", "comment" if "comment" in tokens else "", [_words(t)]) for t in texts_])
                else:
                    box = _box(tag, tokens, [_words(texts_[0], "h3"), *map(_words, texts_[1:])])
                (inside if rng.random() < 0.35 else boxes).append(box)
            for _ in range(int(rng.integers(0, 5))):  # headings, lists, quotations and tables of the text
                some = [spare[int(rng.integers(len(spare)))] for _ in range(3)]
                short = [" ".join(t.split()[:int(rng.integers(1, 7))]) or t for t in some]
                holder.kids.insert(int(rng.integers(len(holder.kids) + 1)), (
                    lambda: _words(short[0], "h2"), lambda: _words(short[0], "h3"), lambda: _words(some[0], "blockquote"),
                    lambda: _box("blockquote", "", [_words(some[0])]), lambda: _box("ul", "", [_words(t, "li") for t in some]),
                    lambda: _box("ol", "", [_words(t, "li") for t in short]), lambda: _words(some[0], "pre"), lambda: _words(some[0], "div"),
                    lambda: _box("table", "", [_box("tr", "", [_words(t, "td") for t in short]) for _ in range(2)]),
                    lambda: _box("section", "", [_words(short[0], "h2"), _words(some[1])]), lambda: _words(short[1], "p"),
                )[int(rng.integers(11))]())
        for box in inside:
            holder.kids.insert(int(rng.integers(1, len(holder.kids) + 1)), box)
        top = Node("body", None)
        if turn == 3 and rng.random() < 0.4:  # no container at all
            top.kids = holder.kids
            main = [k for k in top.kids if k not in inside]
        else:
            holder_in = _box("div", ("", "container", "wrapper", "page")[int(rng.integers(4))], []) if turn and rng.random() < 0.5 else None
            if holder_in is not None:
                holder_in.kids = [holder]
            top.kids = [holder_in or holder]
            main = [holder]
        for box in boxes:
            top.kids.insert(int(rng.integers(len(top.kids) + 1)), box)
        root = Node("#root", None)
        html_ = Node("html", root)
        root.kids, html_.kids, top.parent = [html_], [top], html_
        _adopt(top)
        for n, v in ((root, 1), (html_, 1), (top, 1)):
            label[id(n)] = v
        for k in top.kids:
            label[id(k)] = 1  # wrappers; boxes are set below
        for m in main:
            _label(m, 1, label)
        for b in [*boxes, *inside]:
            _label(b, 0, label)
        out.append((root, label))
    return out


def _adopt(node: Node) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        for k in n.kids:
            k.parent = n
        todo += n.kids


def _label(node: Node, value: int, label: dict[int, int]) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        label[id(n)] = value
        todo += n.kids


def train(pages: list[str], seed: int = 5) -> Boosted:
    """Fit the trees to pages with unambiguous markup and to their variants."""
    rng = np.random.default_rng(seed)
    spare = []
    for p in pages:
        parts = marked(p)
        for side in parts[1] if parts else ():
            text = " ".join(_html.unescape(n.text) for n in _texts(side)).strip()
            spare += [text] if text else []
        for kid in parts[0][1:3] if parts else ():
            text = " ".join(_html.unescape(n.text) for n in _texts(kid)).strip()
            spare += [text[:600]] if text else []
    x, y = [], []
    for unmarked in (False, True):
        if y:
            break
        for p in pages:
            for root, label in variants(p, rng, spare or ["text"], unmarked):
                listed = settle(root)
                known = [label.get(id(n.kids[0] if n.tag == _LOOSE else n), -1) for n, _, _ in listed]
                x.append(matrix(listed)[np.array(known) >= 0])
                y += [k for k in known if k >= 0]
    if not y:
        return Boosted(1.0, *(np.zeros((0, 1), k) for k in (np.int64, np.float64, np.int64, np.float64)))
    return boost(np.concatenate(x), np.array(y, np.float64))


def _texts(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if not n.tag:
            out.append(n)
        elif n.tag not in RAW:
            todo += reversed(n.kids)
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, max_chars: int = 200_000) -> Boosted:
    """Trees from at most ``max_pages`` pages of at most ``max_chars`` characters; pages of any length are extracted."""
    rows = texts(pages, id_col, html_col, "page_id").where((F.length("text") > 0) & (F.length("text") <= max_chars))
    # the bound is found on hashes alone, so that no task sends pages that are not taken
    hashed = rows.select("text", F.xxhash64("page_id", "text").alias("h"))
    last = hashed.select("h").orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    return train(sorted(r.text for r in hashed.where(F.col("h") <= last).select("text").limit(max_pages).collect()))


def main_text(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    model = model or fit(pages, id_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    out = map_texts(rows, "text string", lambda: lambda batch: [extract(batch, model)], "html")
    return out.withColumn("n_chars", F.length("text").cast("long"))
