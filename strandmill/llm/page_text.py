"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A linear classifier over the block's elements, names, length,
links and punctuation gives each block a log-odds of being content, which is its capacity to the
source or, negative, to the sink.  Neighbouring blocks and blocks of one parent are tied by
smoothness edges, stronger the closer they are in the document tree.  The minimum cut labels the
blocks: content is what stays with the source.

A block whose terminal capacity exceeds all its ties keeps its sign in any minimum cut; it is
settled first and its ties move to its neighbours' terminals.  Maximum flow then runs on the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.words import slices

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice alert popup modal overlay subscribe subscription newsletter signup login register share sharing social "
    "related recommended recommendations comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager widget widgets "
    "toolbar search copyright legal disclaimer paywall teaser topbar toplinks tags".split()
)
MAIN = frozenset("article content main post entry story body articlebody text".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Element:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "link")

    def __init__(self, tag: str, parent: _Element | None, good: float, bad: float, link: bool):
        self.tag, self.parent, self.good, self.bad, self.link = tag, parent, good, bad, link
        self.depth = parent.depth + 1 if parent else 0


def _signal(tag: str, attrs: str, inside_main: bool) -> tuple[float, float]:
    """(evidence for content, evidence against) of an element by itself."""
    good = 4.0 if tag in ("article", "main") else 0.0
    bad = 9.0 if tag in OUTSIDE else 3.0 if tag == "header" and inside_main else 9.0 if tag == "header" else 0.0
    if attrs and tag not in ("html", "body"):
        names: set[str] = set()
        for m in _ATTR.finditer(attrs):
            key = (m[1] or m[5]).lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "itemprop"):
                names.update(_NAME.findall(value))
            elif key == "role":
                bad += 9.0 if value.strip() in ROLES else 0.0
                good += 4.0 if value.strip() in ("main", "article") else 0.0
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                bad += 12.0
        if names & MAIN and not names & BOILER:
            good = max(good, 3.0)
        elif names & BOILER and not names & {"article", "post", "entry", "story", "content"}:
            bad += 9.0
        elif names & BOILER:
            bad += 3.0
    return good, bad


class Block:
    __slots__ = ("text", "linked", "element", "heading")

    def __init__(self, text: str, linked: int, element: _Element, heading: bool):
        self.text, self.linked, self.element, self.heading = text, linked, element, heading


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, titles and comments give none."""
    root = _Element("", None, 0.0, 0.0, False)
    stack, out = [root], []
    pieces: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            element = stack[-1]
            while element.tag in INLINE and element.parent:
                element = element.parent
            out.append(Block(text, linked, element, element.tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
        pieces, linked = [], 0

    def write(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1].link:
                linked += len(text)

    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            write(page[at:])
            break
        if low > at:
            write(page[at:low])
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), low):
            end = page.find(">", low)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, low) or _LOOSE_TAG.match(page, low)
        if not m:
            write("<")
            at = low + 1
            continue
        at = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in RAW and not closing:
            if tag not in INLINE:
                pieces.append(" ")
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            close()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in INLINE:  # inline ends leave blocks open
                        if any(e.tag not in INLINE for e in stack[i + 1 :]):
                            break
                    del stack[i:]
                    break
            continue
        shut = CLOSES.get(tag) or (() if tag in INLINE else ("p",))
        if shut and stack[-1].tag not in INLINE and stack[-1].tag in shut:
            stack.pop()
        elif shut == ("p",):
            # An inline element left open in a paragraph ends with it.
            i = len(stack) - 1
            while i > 0 and stack[i].tag in INLINE:
                i -= 1
            if i > 0 and stack[i].tag == "p":
                del stack[i:]
        top = stack[-1]
        good, bad = _signal(tag, attrs, top.good >= 4.0)
        stack.append(_Element(tag, top, max(top.good, good), top.bad + bad, top.link or tag == "a"))
    close()
    return out


def log_odds(block: Block) -> float:
    """Classifier: evidence of the elements around, and of the text itself."""
    e, size = block.element, len(block.text)
    ends = sum(block.text.count(c) for c in ".!?")
    value = e.good - e.bad - 0.5
    value += min(1.5, 0.4 * math.log1p(size / 20)) + min(1.0, 0.3 * ends)
    value -= 3.0 * (block.linked / size) if block.linked else 0.0
    if block.heading:
        value += 0.5
    return value


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours, and between blocks whose elements share a parent."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, 1.2 / (1 + 0.5 * _distance(blocks[i - 1].element, block.element))))
        key = id(block.element.parent)
        if key in last and last[key] < i - 1:
            out.append((last[key], i, 0.4))
        last[key] = i
    return out


def cut(weights: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: True for nodes on the source side; ties of cuts go to the sink."""
    n = len(weights)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    value = list(weights)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(value[i]) > sum(near[i].values()):
            label[i] = value[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                value[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, value, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], value: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (shortest paths by levels)."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if value[i] > 0:
            left[source][i] = value[i]
            left[i][source] = 0.0
        elif value[i] < 0:
            left[i][sink] = -value[i]
            left[sink][i] = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, room in left[a].items():
                if room > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return {i for i in nodes if i in level}
        arcs = {a: iter(list(left[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(left[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    left[x][y] -= flow
                    left[y][x] = left[y].get(x, 0.0) + flow
                full = next(k for k, (x, y) in enumerate(zip(path, path[1:], strict=False)) if left[x][y] <= 1e-12)
                arcs_of = path[full]
                arcs[arcs_of] = iter([b for b in left[arcs_of] if left[arcs_of][b] > 1e-12])
                del path[full + 1 :]
                continue
            for b in arcs[a]:
                if left[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                if a != source:
                    del level[a]  # a dead end


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    keep = cut([log_odds(b) for b in blocks], ties_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``main_text``, empty for null or empty pages and such without
    content."""
    @F.pandas_udf("string")
    def text_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            out = []
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], ["html"])
            for part in slices(batch, "html"):
                out += [main_text(p or "") for p in part.column("html").to_pylist()]
            yield pd.Series(out, dtype=object)

    return pages.withColumn("main_text", text_of(F.col(html_col)))
