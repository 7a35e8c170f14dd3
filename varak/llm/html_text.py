"""HTML extraction by minimum-cut labelling.

A page becomes a list of text blocks. A linear classifier over tags, class names and the text gives each block the
log-odds of being content: positive odds are its capacity from the source, negative odds its capacity to the sink. No
tag or name outweighs the rest: what a container says is worth at most 3, a text says up to 2 and neighbours say as much.
Neighbours under one DOM parent are joined by strong smoothness edges, other blocks next to each other by weak ones. The
minimum cut separates content from boilerplate: blocks that outweigh all their edges are folded into the terminals, and
max-flow labels the others.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<empty>svg)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>"""
    r"|<(?P<raw>script|style|noscript|template|svg|annotation|iframe|object|textarea|select|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden)(?![\w:.-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption search".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of the left closes an open tag of the right, if that is the innermost block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
CELLS = frozenset(("td", "th"))

#: Log-odds of content that a tag or role gives to all it contains.
TAG_ODDS = {
    "article": 3.0, "main": 2.5, "nav": -3.0, "footer": -3.0, "aside": -3.0, "form": -3.0, "menu": -3.0, "header": -3.0, "button": -3.0,
    "dialog": -3.0, "fieldset": -3.0, "search": -3.0, "address": -1.0, "label": -2.0,
}
ROLE_ODDS = {r: -3.0 for r in "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split()} | {"main": 2.5, "article": 3.0}
#: Log-odds that words of a class or id give: signs of boilerplate, strong and weak, and of content.
STRONG, WEAK, GOOD = -3.0, -1.0, 1.5
_STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login paywall comment comments commentlist "
    "disqus pagination".split()
)
_WEAK_WORDS = frozenset("promo promos promotion promoted replies respond share sharing social related recommended recommendations widget widgets pager skip copyright disclaimer legal alert tags".split())
_STRONG_STARTS = ("advert", "comment", "cookie", "sidebar", "sponsor", "newsletter", "breadcrumb", "navbar", "disqus")
_GOOD_WORDS = frozenset("article articlebody post entry story content main maincontent bodytext prose".split())
#: Smoothness: between blocks in page order under one parent and otherwise, and between neighbours under one parent.
NEXT_TO, APART, SIBLINGS = 0.8, 0.4, 1.5


@dataclass
class Block:
    text: str
    odds: float
    parent: int
    tag: str


def _attributes(attrs: str) -> tuple[float, bool]:
    """(odds by role, class and id; is the element hidden)."""
    odds, hidden = 0.0, False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name == "role":
            odds += ROLE_ODDS.get(value.strip(), 0.0)
        elif name in ("class", "id"):
            words = set(_WORD.findall(value))
            good = bool(words & _GOOD_WORDS)
            if words & _STRONG_WORDS or any(w.startswith(_STRONG_STARTS) for w in words):
                odds += STRONG / 2 if good else STRONG
            elif words & _WEAK_WORDS:
                odds += WEAK / 2 if good else WEAK
            elif good:
                odds += GOOD
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        else:
            hidden = hidden or name == "hidden" or value == "true"
    return max(-3.0, min(1.5 if odds < 2.5 else 3.0, odds)), hidden


def _inside(outer: float, own: float) -> float:
    """Odds of what an element contains: its own come first, boilerplate around it counts on, content hardly."""
    return (own + (outer if outer < 0 else 0.1 * outer)) if own else outer


def _own_odds(text: str, linked: int, tag: str) -> float:
    """What the block's own text says, -2.5 to 2: links speak against content, sentences and length for it."""
    share = linked / len(text)
    odds = min(len(text), 200) / 200 * (1 - share) - 2.0 * share * (share > 0.3)
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "p"):
        odds += 0.5
    if len(text) < 25 and tag not in ("", "body", "h1", "h2", "h3", "p", "tr"):
        odds -= 0.5
    if text[-1:] in ".!?:;\"'”…":
        odds += 0.5
    return odds


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, without what isn't shown; character references are decoded and white space is single."""
    out: list[Block] = []
    stack: list[tuple[str, float, int, bool]] = [("", 0.0, 0, False)]  # tag, odds of all it contains, number, hidden
    buffer: list[str] = []
    numbers = linked = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = "" if stack[-1][3] else " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                tag, odds, number, _ = stack[-1]
                parent = stack[-2][2] if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dd", "dt", "pre") and len(stack) > 1 else number
                out.append(Block(text, odds + _own_odds(text, min(linked, len(text)), tag), parent, tag))
        linked = 0

    def enter(name: str, own: float, hidden: bool) -> None:
        nonlocal numbers
        numbers += 1
        stack.append((name, _inside(stack[-1][1], own), numbers, hidden or stack[-1][3]))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["raw"] or m["empty"]:
                buffer.append(" ")
            continue
        name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if name == "a":
                anchors = 0
                continue
            if name in CELLS:
                buffer.append(" ")
                continue
            block = name in BLOCK_TAGS
            if block:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if not block:
                        flush()
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCK_TAGS:
                    break
            if block:
                anchors = 0
            continue
        if name == "a":
            anchors = 1
            continue
        if name == "br" or name in CELLS:
            buffer.append(" ")
            continue
        if name in VOID_TAGS and name != "hr":
            continue
        odds, hidden = _attributes(attrs) if attrs else (0.0, False)
        if name not in BLOCK_TAGS:
            if (odds <= STRONG or hidden or name == "label") and not attrs.endswith("/"):
                flush()
                enter(name, odds + TAG_ODDS.get(name, 0.0), hidden)
            continue
        flush()
        anchors = 0
        if name == "head":
            hidden = True
        elif len(stack) > 1 and any(s[0] == "head" for s in stack[:4]):  # nothing else belongs there: it was left open
            del stack[next(k for k, s in enumerate(stack) if s[0] == "head") :]
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
            stack.pop()
        if name == "hr":
            continue
        given = TAG_ODDS.get(name, 0.0)
        if name == "header" and any(s[0] in ("article", "main") for s in stack):
            given = 0.0
        enter(name, 0.0 if name in ("html", "body") else odds + given, hidden)  # classes there describe the whole page
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


def _max_flow(odds: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Labels of a minimum cut by Dinic's algorithm: True on the source's side. Undirected edges, by node."""
    n = len(odds)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [dict(e) for e in edges] + [{}, {}]
    for i, o in enumerate(odds):
        if o > 0:
            graph[source][i], graph[i][source] = o, 0.0
        elif o < 0:
            graph[i][sink], graph[sink][i] = -o, 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(n)]
        ahead = {u: [v for v in graph[u] if level.get(v, -1) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= flow
                    graph[b][a] = graph[b].get(a, 0.0) + flow
                path = [source]
                continue
            while ahead[u] and graph[u][ahead[u][-1]] <= 1e-9:
                ahead[u].pop()
            if ahead[u]:
                path.append(ahead[u][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()  # a dead end


def label(odds: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Minimum-cut labels. A block whose odds outweigh all its edges keeps its side in every minimum cut: it is folded into
    that terminal, so that its edges become odds of its neighbours. Max-flow labels the rest."""
    side = [o > 0 if abs(o) > sum(e.values()) or not e else None for o, e in zip(odds, edges)]
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        index = {i: k for k, i in enumerate(rest)}
        own = [odds[i] + sum(w if side[j] else -w for j, w in edges[i].items() if side[j] is not None) for i in rest]
        for i, found in zip(rest, _max_flow(own, [{index[j]: w for j, w in edges[i].items() if j in index} for i in rest])):
            side[i] = found
    return [bool(s) for s in side]


def graph_of(blocks: list[Block]) -> list[dict[int, float]]:
    """Smoothness edges of each block: to the next one in the page, and to the next one under the same parent."""
    edges: list[dict[int, float]] = [{} for _ in blocks]
    last: dict[int, int] = {}

    def join(i: int, j: int, w: float) -> None:
        edges[i][j] = edges[j][i] = edges[i].get(j, 0.0) + w

    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, NEXT_TO if blocks[i - 1].parent == b.parent else APART)
        if b.parent in last:
            join(last[b.parent], i, SIBLINGS)
        last[b.parent] = i
    return edges


def extract(page: str | None) -> str:
    """The page's main text: content blocks in page order, joined by blank lines; empty if there are none."""
    blocks = blocks_of(page or "")
    keep = label([b.odds for b in blocks], graph_of(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


@F.pandas_udf(StructType([StructField("text", StringType())]))
def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame({"text": [extract(p) for p in pages]})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text (empty if none), n_chars (its code points).

    Null html counts as empty. Pages are read whole and judged alone, so ids may be null or repeat and the empty table
    gives an empty result. Sloppy pages (unclosed tags, cut ends, stray angle brackets) are read as browsers would,
    roughly. Table rows are blocks; their cells are joined by a space, as are lines broken by br.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), _extracted(F.col(html_col))["text"].alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
