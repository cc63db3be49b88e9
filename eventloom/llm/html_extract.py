"""Main text of web pages by tag-path ratios.

A page is cut into blocks; a block belongs to the path of tags from the root down to it. Text length
and punctuation are summed per path and set in proportion to the number of the path's blocks; the two
ratios are fused and smoothed over paths that share a beginning, in proportion to the page's best. What
a path says of itself (article and main on one side, navigation, footers, forms, comments, adverts on
the other) adds or takes a bounded weight, and paths above one threshold give the content, in page order.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices

# Kinds of HTML elements.
_SKIPPED = frozenset("script style template noscript svg math iframe object canvas select textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table ul".split())
# Elements that end the one before them, and the elements that they do not reach beyond.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select", "datalist")),
}
_BOILER_TAGS = frozenset("head nav header footer aside form button menu dialog fieldset".split())
_CONTENT_TAGS = frozenset("article main".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer footnav gdpr header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promos promoted related replies reply respond search share sharing "
    "sidebar sidebars signup skip social sponsor sponsors sponsored subscribe subscription toolbar widget widgets".split())
_CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
# What may follow such a word in a name without changing what it says: sidebar-left, comments-area.
_FRAMES = frozenset(
    "area bar block bottom box col column container first form group holder inner item items last left links list outer "
    "panel region right row section slot top unit wrap wrapper zone".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT_ROLES = frozenset(("main", "article"))

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?、。，؟،]")
#: Score that a path must reach. Ratios lie in [0, 1]; what a path says of itself adds or takes these.
#: No mark reaches the threshold without a ratio.
_THRESHOLD, _FOR, _AGAINST = 0.55, 0.35, 0.5
#: Beginnings of a path, from itself up, that its ratio is smoothed over; further ones weigh under e^-18.
_NEAR = 6


def _names(value: str) -> int:
    """What the class tokens or the id of an element say, token by token."""
    cue = 0
    for token in value.lower().split():
        first, *rest = re.split(r"[-_]+", token.strip("-_"))
        last = rest[-1] if rest else first
        if token in _BOILER_WORDS or last in _BOILER_WORDS or first in _BOILER_WORDS and all(
                r in _FRAMES or r in _CONTENT_WORDS or r.isdigit() for r in rest):
            return -1
        cue = max(cue, int(token in _CONTENT_WORDS or last in _CONTENT_WORDS))
    return cue


def _cue(tag: str, attributes: str) -> int:
    """-1: says that it is not the article; 1: says that it is; 0: says nothing."""
    if tag in _BOILER_TAGS:
        return -1
    cue = 1 if tag in _CONTENT_TAGS else 0
    if not attributes:
        return cue
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return -1
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -1
        if name == "role":
            if value.lower() in _BOILER_ROLES:
                return -1
            cue = max(cue, int(value.lower() in _CONTENT_ROLES))
        elif name in ("class", "id"):
            said = 0 if tag in ("html", "body") else _names(value)
            if said < 0:
                return -1
            cue = max(cue, said)
        elif name == "itemprop" and value.lower() == "articlebody":
            cue = 1
    return cue


class _Blocks:
    """Blocks of a page in order, as (node, text, length of text in links).

    Nodes are those of the tree of tag paths: elements with the same path and marks share a node, and a
    node is known by its parent, so that neither time nor memory grows with the square of the depth.
    """

    def __init__(self) -> None:
        self.found: list[tuple[int, str, int]] = []
        self.nodes: dict[tuple[int, str, int], int] = {}
        self.parent, self.cue, self.against = [-1], [0], [-1]       # `against`: the outermost node marked so
        self.stack: list[tuple[str, int]] = []      # (tag, node)
        self.open: dict[str, list[int]] = {}        # depths at which a tag is open
        self.pieces: list[str] = []
        self.links, self.link_chars = 0, 0

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.links:
                self.link_chars += len(raw.strip())

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.found.append((self.stack[-1][1] if self.stack else 0, text, self.link_chars))
            self.pieces, self.link_chars = [], 0

    def _cut(self, depth: int) -> None:
        self.end_block()
        while len(self.stack) > depth:
            self.open[self.stack.pop()[0]].pop()

    def _deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close_upto(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        depth = self._deepest(tags)
        if depth >= 0 and depth >= self._deepest(walls):
            self._cut(depth)

    def _push(self, tag: str, attributes: str) -> None:
        said, above = _cue(tag, attributes), self.stack[-1][1] if self.stack else 0
        cue = -1 if -1 in (said, self.cue[above]) else max(said, self.cue[above])
        key = (above, tag if said >= 0 else f"-{tag}", cue)
        if key not in self.nodes:
            node = self.nodes[key] = len(self.parent)
            self.parent.append(above)
            self.cue.append(cue)
            self.against.append(node if said < 0 and self.against[above] < 0 else self.against[above])
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.nodes[key]))

    def start(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            self.links += tag == "a"
            return
        if tag in _VOID:
            if tag in ("br", "wbr"):
                self.pieces.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.end_block()
            return
        self.end_block()
        if tag in _ENDS_PARAGRAPH:
            self._close_upto(("p",), ("td", "th", "button", "object"))
        if tag in _SIBLINGS:
            self._close_upto(*_SIBLINGS[tag])
        if tag == "body":
            self._close_upto(("head",), ())
        self._push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in _INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if self.open.get(tag):
            self._cut(self.open[tag][-1])
            self.links = 0
        elif tag == "p":
            self.end_block()


def _blocks(page: str) -> _Blocks:
    walk, at = _Blocks(), 0
    while found := _MARKUP.search(page, at):
        walk.text(page[at:found.start()])
        closing, tag, attributes = found.groups()
        at = found.end()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            walk.end(tag)
        elif tag in _SKIPPED or tag == "title":
            # Its text is not text of the page, whatever it holds, up to its end tag.
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = over.end() if over else len(page)
        else:
            walk.start(tag, attributes)
    walk.text(page[at:])
    walk.end_block()
    return walk


def path_scores(walk: _Blocks) -> list[float]:
    """Score of every path (node) that has blocks: its ratio, fused and smoothed, and its marks."""
    n = len(walk.parent)
    chars, marks, count = [0] * n, [0] * n, [0] * n
    for node, text, linked in walk.found:
        chars[node] += max(0, len(text) - linked)
        marks[node] += len(_PUNCTUATION.findall(text))
        count[node] += 1
    # Text ratio times punctuation ratio, on a log scale so that one long block does not hide others.
    fused = [math.log1p(c / k * (1 + m / k)) if k else 0.0 for c, m, k in zip(chars, marks, count)]
    # Sums over the paths below every beginning; a node comes after its parent.
    total, paths, held = fused[:], [int(k > 0) for k in count], chars[:]
    for node in range(n - 1, 0, -1):
        above = walk.parent[node]
        total[above] += total[node]
        paths[above] += paths[node]
        held[above] += held[node]
    smooth = [0.0] * n
    for node in range(n):
        if count[node]:
            top, weight, at, steps = 0.0, 0.0, node, 0
            while at >= 0 and steps <= _NEAR:
                near = math.exp(-0.5 * steps ** 2)
                top, weight = top + near * total[at], weight + near * paths[at]
                at, steps = walk.parent[at], steps + 1
            smooth[node] = 0.5 * fused[node] + 0.5 * top / weight
    used = [node for node in range(n) if count[node]]
    most = max((smooth[node] for node in used if walk.cue[node] >= 0), default=0.0) or max(
        (smooth[node] for node in used), default=0.0) or 1.0
    marked = any(walk.cue[node] > 0 for node in used)
    scores = [0.0] * n
    for node in used:
        cue, ratio = walk.cue[node], min(1.0, smooth[node] / most)
        if cue < 0 and not marked:
            # Where nothing is marked as the article, a mark against most of the page's text says little.
            share = held[walk.against[node]] / max(1, held[0])
            scores[node] = ratio - _AGAINST * (1 - share)
        else:
            scores[node] = ratio + (_FOR if cue > 0 else -_AGAINST if cue < 0 else 0.0)
    return scores


def main_text(page: str | None) -> str:
    """The article of a page; empty for null, for no text, and where no path reaches the threshold."""
    walk = _blocks(page or "")
    scores = path_scores(walk)
    return " ".join(text for node, text, _ in walk.found if scores[node] >= _THRESHOLD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 4 << 20):
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` for every row; no shuffle, a page at a time.

    Null or empty html gives an empty text; rows that repeat give the same text again; null ids and
    URLs pass through. Paths of the same score are all taken or all left. Markup that is never closed,
    long pages and deep ones take time and memory in proportion to their size. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
