"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text between block-level tags, and blocks of one kind under one parent
form a node. A linear classifier gives each node a cost for the label content and one for boilerplate,
which are the capacities of its edges to the two terminals. Neighbours on the page, and nodes that are
close in the element tree, are joined by edges whose capacity is the price of labelling them
differently. The minimum cut is the cheapest labelling; the blocks on the side of content, in page
order, are the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML: fixed values of that format.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav"
    " ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SPACING = frozenset(["br", "wbr", "img", "hr"])
# elements whose content is never text of the page; that of the first ones is not markup either
RAW = frozenset("script style title textarea iframe noframes xmp".split())
DROPPED = RAW | frozenset(
    "noscript template select option button svg math object audio video canvas datalist".split()
)
FOREIGN = frozenset(["svg", "math"])
# pages that hide all they have until a script has run are read
ROOTS = frozenset(["html", "body"])
CLOSED_BY_BLOCK = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
LISTS = frozenset("ul ol dl table menu article section div body main nav aside footer header".split())

# Weights of the classifier: positive for content, per element on the path to the block.
TAG_WEIGHT = {
    "article": 4.0, "main": 4.0, "p": 1.0, "pre": 1.0, "blockquote": 0.8, "h1": 0.8, "h2": 0.5,
    "h3": 0.4, "nav": -9.0, "menu": -9.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "dialog": -9.0,
    "search": -8.0, "fieldset": -6.0, "label": -3.0, "address": -1.5, "header": -2.5,
}
# Words in class, id, role and label attributes.
CONTENT_WORDS = frozenset("article content main post entry story body text prose".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert archive author banner bar breadcrumb"
    " breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright"
    " dialog discussion disqus disclaimer footer footnav form gdpr header login masthead menu meta"
    " modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination"
    " pagenav popup popular promo promoted promotion recommended related replies reply respond"
    " search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe"
    " tabs tag tags taboola teaser toc toolbar topbar trending warning widget".split()
)
WORD_WEIGHT = {"content": 2.0, "boilerplate": -7.0}
BASE = -1.2
PER_LOG_CHARS = 0.8
PER_SENTENCE = 0.4
LINK_SHARE = -5.0
# Prices of different labels: for neighbours on the page, and by distance in the tree.
NEIGHBOURS = 0.25
PROXIMITY = 0.4
NEAR = 6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


@dataclass(slots=True)
class Element:
    """An open element: its name, weight with all above it, and whether it is hidden."""

    name: str
    number: int
    parent: Element | None
    depth: int
    weight: float
    kind: str
    hidden: bool = False


@dataclass(slots=True)
class Node:
    """Blocks of one kind that share a parent."""

    parent: Element
    blocks: list[int] = field(default_factory=list)
    weight: float = 0.0
    chars: int = 0
    link_chars: int = 0
    sentences: int = 0


def _attributes(raw: str) -> tuple[float, str, bool]:
    """The weight of an element's attributes, its class as written, and whether it is hidden."""
    weight, kind, hidden = 0.0, "", False
    words: set[str] = set()
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), double or single or bare
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
            kind += value
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    if words & BOILERPLATE_WORDS:
        weight += WORD_WEIGHT["boilerplate"]
    elif words & CONTENT_WORDS:
        weight += WORD_WEIGHT["content"]
    return weight, kind, hidden


class _Reader:
    """Builds the blocks of one page. Tags that are missing or too many are made up for.

    What stands in a hidden element is left out up to where the element ends, by its closing tag or by
    the rules that imply one; so a hidden element that nothing closes ends with the one around it.
    """

    def __init__(self) -> None:
        self.top = Element("", 0, None, 0, 0.0, "")
        self.stack = [self.top]
        self.number = 0
        self.parts: list[str] = []
        self.links = 0
        self.in_link = 0
        self.blocks: list[tuple[str, Element, int]] = []
        # open hidden elements within a block: name, how many of that name are open, elements around it
        self.hidden: list[list] = []

    def text(self, raw: str) -> None:
        if raw and not self.hidden and not self.stack[-1].hidden:
            self.parts.append(raw)
            if self.in_link:
                self.links += len(raw.strip())

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((text, self.stack[-1], self.links))
            self.parts, self.links = [], 0

    def _cut_stack(self, size: int) -> None:
        del self.stack[size:]
        while self.hidden and self.hidden[-1][2] > size:
            self.hidden.pop()

    def open(self, name: str, raw: str) -> None:
        if name in BLOCK:
            self.end_block()
            if self.stack[-1].name in CLOSED_BY_BLOCK:
                self._cut_stack(len(self.stack) - 1)
            if name in SIBLINGS:
                self._close_siblings(SIBLINGS[name])
        elif name == "a":
            self.in_link = 1
        elif name in SPACING:
            self.parts.append(" ")
        if name in VOID:
            return
        weight, kind, hidden = _attributes(raw) if raw.strip() else (0.0, "", False)
        if name in BLOCK:
            above = self.stack[-1]
            self.number += 1
            own = weight + TAG_WEIGHT.get(name, 0.0)
            hides = above.hidden or hidden and name not in ROOTS
            self.stack.append(
                Element(name, self.number, above, above.depth + 1, above.weight + own, kind, hides)
            )
        elif self.hidden and self.hidden[-1][0] == name:
            self.hidden[-1][1] += 1
        elif hidden:
            self.hidden.append([name, 1, len(self.stack)])

    def _close_siblings(self, names: set[str]) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name in names:
                self._cut_stack(at)
                return
            if self.stack[at].name in LISTS:
                return

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        if name not in BLOCK:
            if self.hidden and self.hidden[-1][0] == name:
                self.hidden[-1][1] -= 1
                if not self.hidden[-1][1]:
                    self.hidden.pop()
            return
        self.end_block()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name == name:
                self._cut_stack(at)
                return


@cache
def _tags(name: str) -> re.Pattern:
    """Opening and closing tags of a name; A-Z in either case, and no other letters that fold to them."""
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+>", re.IGNORECASE | re.ASCII)


def _end_of(page: str, name: str, at: int) -> int | None:
    """Where the element ends that was opened just before ``at``; None if nothing closes it."""
    depth = 1
    for tag in _tags(name).finditer(page, at):
        if tag[1]:
            depth -= 1
        elif name not in RAW and not tag[0].endswith("/>"):
            depth += 1
        if not depth:
            return tag.end()
    return None


def blocks_of(page: str) -> list[tuple[str, Element, int]]:
    """(text, element, characters in links) of every block, in page order.

    Of elements that are never text, scripts and the like reach to the end of the page when nothing
    closes them; of others only the tag is dropped then.
    """
    reader = _Reader()
    at = 0
    never_closed: set[str] = set()
    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        reader.text(page[at : token.start()])
        at = token.end()
        if token[0].startswith("<![CDATA["):
            reader.text(entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, raw = bool(token[1] or token[4]), token[3] or token[6] or ""
        if closing:
            reader.close(name)
        elif name in DROPPED:
            reader.text(" ")
            if name in FOREIGN and raw.endswith("/") or name in never_closed:
                continue
            end = _end_of(page, name, at)
            if end is not None:
                at = end
            elif name in RAW:
                at = len(page)
            else:
                # nor is any later one
                never_closed.add(name)
        else:
            reader.open(name, raw)
    reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def _nodes(blocks: list[tuple[str, Element, int]]) -> list[Node]:
    """Neighbouring blocks whose elements have one parent, name, class and weight."""
    nodes: list[Node] = []
    last = None
    for i, (text, element, links) in enumerate(blocks):
        parent = element.parent or element
        kind = (parent.number, element.name, element.kind, element.weight)
        if kind != last:
            nodes.append(Node(parent, weight=element.weight))
            last = kind
        node = nodes[-1]
        node.blocks.append(i)
        node.chars += len(text)
        node.link_chars += min(links, len(text))
        node.sentences += len(_SENTENCE.findall(text))
    return nodes


def content_score(node: Node) -> float:
    """The classifier: how much more the label boilerplate costs than content."""
    size = max(1, node.chars)
    return (
        BASE
        + node.weight
        + PER_LOG_CHARS * math.log1p(size / 20)
        + PER_SENTENCE * min(4, node.sentences)
        + LINK_SHARE * node.link_chars / size
    )


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut, by blocking flows over levels.

    A positive score is the capacity from the source, a negative one that to the sink; an edge has its
    capacity both ways. Each round finds the distances from the source and then pushes flow along
    shortest paths until none is left, so there are as many rounds as there are lengths of paths.
    """
    size = len(scores)
    source, sink = size, size + 1
    # an arc and its reverse stand next to each other
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(size + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, score in enumerate(scores):
        if score > 0:
            connect(source, i, score, 0.0)
        else:
            connect(i, sink, -score, 0.0)
    for a, b, price in edges:
        connect(a, b, price, price)
    tiny = 1e-9
    while True:
        level = [-1] * (size + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for arc in arcs[a]:
                if room[arc] > tiny and level[to[arc]] < 0:
                    level[to[arc]] = level[a] + 1
                    queue.append(to[arc])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(size)]
        tried = [0] * (size + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[arc] for arc in path)
                for arc in path:
                    room[arc] -= flow
                    room[arc ^ 1] += flow
                # back to where the path has become full
                full = next(k for k, arc in enumerate(path) if room[arc] <= tiny)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            own, further = arcs[a], level[a] + 1
            while tried[a] < len(own):
                arc = own[tried[a]]
                if room[arc] > tiny and level[to[arc]] == further:
                    break
                tried[a] += 1
            if tried[a] < len(own):
                path.append(own[tried[a]])
                a = to[path[-1]]
            elif path:
                # a dead end: no path of this round goes through here
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, one per line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    nodes = _nodes(blocks)
    scores = [content_score(node) for node in nodes]
    edges = []
    for i, node in enumerate(nodes):
        for j in range(i + 1, min(len(nodes), i + 1 + NEAR)):
            near = PROXIMITY * 2.0 ** -_distance(node.parent, nodes[j].parent)
            price = near + (NEIGHBOURS if j == i + 1 else 0.0)
            if price > 0.05:
                edges.append((i, j, price))
    content = minimum_cut(scores, edges)
    return "\n".join(blocks[i][0] for node, kept in zip(nodes, content) if kept for i in node.blocks)


def extract_text(pages: DataFrame, html_col: str = "html", name: str = "main_text") -> DataFrame:
    """All columns and rows of ``pages``, and the main text of each; empty if there is none.

    A null or empty page has an empty text; pages of any length are read whole; broken markup is
    read as far as it goes. A column that has the new name is replaced.
    """

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([main_text(page) for page in texts], dtype=object)

    return pages.withColumn(name, extract(F.col(html_col)))
