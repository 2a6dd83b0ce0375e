"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks, the text between the tags that break lines. A linear classifier gives each block a score from its
place in the page, its length, links and punctuation; what it costs to call the block boilerplate or content are its terminal
capacities. Neighbouring blocks, and consecutive blocks of one container, are joined by edges that cost if the two are labelled
differently. The minimum cut is the labelling of least cost. Blocks whose score outweighs all their edges are settled first,
which does not change the cut; the rest is solved by maximum flow.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from math import exp, log1p, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)\]\]>|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^'">]|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>""",
    re.DOTALL,
)
# their content is no text; up to the closing tag nothing else counts as a tag
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "canvas", "audio", "video"}
SKIPPED_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in SKIPPED}
# elements whose missing end tag makes the rest of a page theirs
SWALLOWING = {"script", "style", "textarea", "title", "iframe"}
BREAKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_CONTENT = {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.IGNORECASE)
WORD_BREAK = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
# names of parts that are never part of an article, whatever surrounds them
APART = re.compile(
    r" (?:comments?|commentlist|respond|replies|disqus|ads?|adverts?|advertisements?|advertising|adsense|sponsors?|sponsored|promos?|"
    r"promotions?|banners?|cookies?|consent|gdpr|newsletters?|subscribe|subscriptions?|signup|login|popups?|modals?|overlays?|share|"
    r"sharing|social|related|recommended|recommendations?|breadcrumbs?|pagination|pager|navigation|navbar|navs?|menus?|toolbars?|"
    r"notices?|alerts?|widgets?|contentinfo|complementary|search|forms?|toc|skip|copyright|legal|trending|outbrain|taboola) "
)
BESIDE = re.compile(r" (?:sidebars?|side|aside|rail|headers?|masthead|topbar|footers?|foot|bottom|top|tags?|meta|byline|hidden|print|social) ")
INSIDE = re.compile(r" (?:article|articles|main|content|post|entry|story|articlebody|text|body) ")

# score of a block
BASE, BY_LENGTH, BY_LINKS, BY_SENTENCE = -0.5, 0.8, -4.0, 1.0
IN_ARTICLE, IN_BESIDE, IN_APART = 4.0, -6.0, -16.0
# cost of different labels on neighbours, and on consecutive blocks of one container
NEAR, TOGETHER = 0.6, 0.9


class _Block:
    __slots__ = ("parts", "links", "container", "score", "heading")

    def __init__(self, container: int, score: float, heading: bool) -> None:
        self.parts: list[str] = []
        self.links = 0
        self.container, self.score, self.heading = container, score, heading


_PLACES: dict[tuple[str, str], tuple[float, bool]] = {}


def _place(name: str, more: str) -> tuple[float, bool]:
    """Score of being inside an element, 0 if it says nothing; whether nothing inside it can take that back."""
    key = (name, more)
    if key in _PLACES:
        return _PLACES[key]
    words = " " + " ".join(WORD_BREAK.sub(" ", v.strip("\"'")).lower() for _, v in ATTRIBUTE.findall(more)) + " "
    words = words.replace(" ", "  ")
    if name in ("nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "head"):
        found = (IN_APART, True)
    elif more and UNSEEN.search(more):
        found = (IN_APART, True)
    elif name in ("html", "body"):
        found = (0.0, False)
    elif APART.search(words):
        found = (IN_APART, name not in ("article", "main") or " comment" in words)
    elif name in ("article", "main"):
        found = (IN_ARTICLE, False)
    elif name == "header" or BESIDE.search(words):
        found = (IN_BESIDE, False)
    elif INSIDE.search(words):
        found = (IN_ARTICLE, False)
    else:
        found = (0.0, False)
    if len(_PLACES) < 50_000:
        _PLACES[key] = found
    return found


def blocks(page: str) -> list[tuple[str, float, int]]:
    """Text, score and container of every block with text, in page order."""
    found: list[_Block] = []
    # open elements: name, number, score of the place, whether it is final
    stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]
    number, links, at, current = 0, 0, 0, None
    unclosed: set[str] = set()

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text.strip():
                return
            top = stack[-1]
            current = _Block(stack[-2][1] if len(stack) > 1 and top[0] in PARAGRAPHS else top[1], top[2], top[0] in HEADINGS)
            found.append(current)
        current.parts.append(text)
        if links:
            current.links += len(text)

    while True:
        hit = TAG.search(page, at)
        if hit is None:
            if at < len(page):
                add(page[at:])
            break
        if hit.start() > at:
            add(page[at : hit.start()])
        at = hit.end()
        name = hit["name"] or hit["name2"]
        if name is None:
            if hit["raw"]:
                add(hit["raw"].replace("&", "&amp;"))
            continue
        name = name.lower()
        closing = bool(hit["end"] or hit["end2"])
        if name == "br" or name == "wbr":
            if current is not None and name == "br":
                current.parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in SKIPPED:
            if not closing and not (hit["more"] or hit["more2"] or "").endswith("/"):
                end = None if name in unclosed else SKIPPED_END[name].search(page, at)
                if end is not None:
                    at = end.start()
                else:
                    # no later one has an end either; only these swallow the page then, of others the tag alone goes
                    unclosed.add(name)
                    if name in SWALLOWING:
                        at = len(page)
            continue
        if name not in BREAKS:
            continue
        current = None
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            links = 0
            continue
        if name == "p" or name in HEADINGS:
            # a paragraph ends the one before it
            if stack[-1][0] == "p":
                stack.pop()
        elif stack[-1][0] == "p" and name != "button":
            stack.pop()
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
            stack.pop()
        if name in NO_CONTENT:
            continue
        number += 1
        _, _, outer, final = stack[-1]
        score, ends = _place(name, hit["more"] or hit["more2"] or "")
        if final:
            score, ends = outer, True
        elif name == "header" and outer > 0:
            score, ends = outer, False
        elif score == 0:
            score = outer
        stack.append((name, number, score, ends))

    out = []
    for block in found:
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            words = text.count(" ") + 1
            score = BASE + block.score + BY_LENGTH * min(log2(1 + words / 5), 4) + BY_LINKS * min(1.0, block.links / len(text))
            if text[-1] in ".!?…。:\"»”" or block.heading:
                score += BY_SENTENCE
            out.append((text, score, block.container))
    return out


PARAGRAPHS = HEADINGS | {"p", "li", "td", "th", "dt", "dd", "blockquote", "pre", "figcaption"}


def costs(score: float) -> tuple[float, float]:
    """Of calling a block content, and boilerplate: the logistic losses of its score."""
    if score > 30:
        return 0.0, score
    if score < -30:
        return -score, 0.0
    return log1p(exp(-score)), log1p(exp(score))


def label(scores: list[float], containers: list[int]) -> list[bool]:
    """Whether each block is content: the minimum cut. Ties go to content."""
    n = len(scores)
    edges: list[dict[int, float]] = [{} for _ in range(n)]
    last: dict[int, int] = {}
    for k in range(n):
        for other, weight in ((k - 1, NEAR), (last.get(containers[k], -1), TOGETHER)):
            if other >= 0:
                edges[k][other] = edges[other][k] = edges[k].get(other, 0.0) + weight
        last[containers[k]] = k
    lean = []
    for s in scores:
        content, boiler = costs(s)
        lean.append(boiler - content)
    known: list[bool | None] = [None] * n
    total = [sum(e.values()) for e in edges]
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if known[k] is not None or abs(lean[k]) < total[k] or lean[k] == 0 < total[k]:
            continue
        known[k] = lean[k] >= 0
        for other, weight in edges[k].items():
            if known[other] is None:
                lean[other] += weight if known[k] else -weight
                total[other] -= weight
                waiting.append(other)
    open_blocks = [k for k in range(n) if known[k] is None]
    if open_blocks:
        place = {k: i for i, k in enumerate(open_blocks)}
        inner = [(place[a], place[b], w) for a in open_blocks for b, w in edges[a].items() if a < b and b in place]
        for k, content in zip(open_blocks, min_cut([lean[k] for k in open_blocks], inner)):
            known[k] = content
    return [bool(k) for k in known]


def min_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes not cut off from the source: maximum flow by shortest augmenting levels.

    A positive lean is the capacity from the source, a negative one that to the sink.
    """
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, value in enumerate(lean):
        if value > 0:
            join(source, k, value, 0.0)
        elif value < 0:
            join(k, sink, -value, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        turn = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= least)
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[node] < len(arcs[node]):
                e = arcs[node][turn[node]]
                if room[e] > least and level[to[e]] == level[node] + 1:
                    break
                turn[node] += 1
            else:
                if not path:
                    break
                node = to[path.pop() ^ 1]
                turn[node] += 1
                continue
            path.append(e)
            node = to[e]
    # what cannot reach the sink any more is content
    reaches = [False] * (n + 2)
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in arcs[b]:
            if room[e ^ 1] > least and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return [not reaches[k] for k in range(n)]


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    content = label([b[1] for b in found], [b[2] for b in found])
    return " ".join(b[0] for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page: its content blocks in page order, joined by one space.

    A missing or empty page, and one without content, has an empty text. Repeated rows stay repeated, missing identifiers
    and addresses are carried along, columns besides the three are left out; no rows give no rows. Whole pages are read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            found = pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
