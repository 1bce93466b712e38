"""Main text of web pages by minimum cut.

A page is cut into text blocks. A linear classifier gives each block the cost of calling it content
and of calling it boilerplate; these are its capacities to the two terminals of a graph. Neighbouring
blocks, and blocks close together in the page's tree, are joined by edges whose capacity is the cost
of labelling them differently. The minimum cut, found by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.jobs import prepare

SKIPPED = frozenset("head script style template noscript textarea select button svg iframe object canvas audio video".split())
#: Of these, elements that the next block ends if they were left open.
LEFT_OPEN = frozenset("head select svg object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and words of class, id and role that speak for boilerplate or for content.
BAD_TAGS = frozenset("nav footer aside form menu dialog header search".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner banners breadcrumb breadcrumbs byline comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu menus "
    "meta modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar tracking widget widgets".split()
)
#: Bad words that say nothing on an article or main element, where they tell its features or topics.
FEATURES = frozenset("byline footer header legal login meta modal nav notice notices search share sharing sidebar social tags tracking".split())
#: Beginnings of class names that tell what stands beside the element, not what it is.
_BESIDE = re.compile(r"(?:has|with|without|no)[-_]")
GOOD_WORDS = frozenset("article articlebody content entry main post story text".split())
#: Classifier: weights of a block's features; above 0 is content.
WEIGHTS = {"bias": -0.4, "bad": -6.0, "good": 3.0, "links": -3.0, "length": 0.35, "sentence": 0.8, "prose": 0.6, "rights": -2.0}
#: Cost of a different label for neighbours, and for blocks under one parent; per level of distance less.
NEAR, SIBLING = 0.5, 0.8
_WORDS = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"^\s*(©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    tag: str
    path: tuple[int, ...]  # numbers of the open elements
    bad: int
    good: int


class _Blocks(HTMLParser):
    """Text blocks in page order; unclosed and stray tags are taken as browsers do, roughly."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # open elements: tag, number, bad, good
        self.open: list[tuple[str, int, int, int]] = []
        self.number = self.skipping = self.links = self.linked = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, _, bad, good = next((o for o in reversed(self.open) if o[0] in BLOCK), ("", 0, 0, 0))
            path = tuple(o[1] for o in self.open if o[0] in BLOCK)
            self.blocks.append(Block(text, self.linked, tag, path, bad, good))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            if tag in SKIPPED and tag not in VOID:
                self.skipping += tag == self.skip_tag
            if not (self.skip_tag in LEFT_OPEN and tag in BLOCK):
                return
            self.skipping = 0  # the element was not closed
        if tag in SKIPPED:
            if tag != "button":
                self.skip_tag, self.skipping = tag, 1
                return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if self.open and tag not in ("html", "body"):
                self._implied_end(tag)
        if tag in VOID:
            return
        _, _, bad, good = self.open[-1] if self.open else ("", 0, 0, 0)
        words = set()
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                for part in re.split(r"[\s]+", value.lower()):
                    if not _BESIDE.match(part):
                        words.update(_WORDS.findall(part))
        if tag in GOOD_TAGS:
            words -= FEATURES
        hidden = any(n == "hidden" or (n == "style" and v and "display:none" in v.replace(" ", "").lower()) for n, v in attrs)
        bad += (tag in BAD_TAGS or tag == "button") + bool(words & BAD_WORDS and tag not in ("html", "body")) + hidden
        good += (tag in GOOD_TAGS) + bool(words & GOOD_WORDS)
        self.number += 1
        self.links += tag == "a"
        self.open.append((tag, self.number, bad, good))

    def _implied_end(self, tag: str) -> None:
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
        ends = closes.get(tag, ()) + ("p",)
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in ends:
                self._pop(i)
                return
            if name in BLOCK:
                return

    def _pop(self, at: int) -> None:
        self.links -= sum(o[0] == "a" for o in self.open[at:])
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            self.skipping -= tag == self.skip_tag
            return
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.open[i][0] in BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def content_score(b: Block) -> float:
    """Linear classifier over a block's features; positive for content."""
    w = WEIGHTS
    words = b.text.count(" ") + 1
    score = w["bias"] + w["bad"] * min(2, b.bad) + w["good"] * min(1, b.good)
    score += w["links"] * min(1.0, b.linked / len(b.text)) + w["length"] * min(4.0, words / 10)
    score += w["sentence"] * (b.text[-1] in ".!?…:\"'»”") + w["prose"] * (b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"))
    return score + w["rights"] * bool(_RIGHTS.match(b.text))


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    Node i has capacity score[i] from the source if positive, else -score[i] to the sink. Flow is
    pushed along shortest augmenting paths, level by level.
    """
    n = len(score)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(score):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if room[e] <= least)
                u = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while at[u] < len(graph[u]):
                e = graph[u][at[u]]
                if room[e] > least and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(graph[u]):
                path.append(graph[u][at[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by distance in the tree, and between blocks of one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        parent = b.path[:-1]
        if i:
            a = blocks[i - 1]
            common = next((k for k, (x, y) in enumerate(zip(a.path, b.path)) if x != y), min(len(a.path), len(b.path)))
            distance = len(a.path) + len(b.path) - 2 * common
            edges.append((i - 1, i, NEAR / (1 + distance)))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING / 2))
        elif parent in last:
            edges.append((i - 1, i, SIBLING))
        last[parent] = i
    return edges


def main_text(html: str | None) -> str:
    """Content blocks in page order, one on a line; empty for null and pages without content."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    score = [content_score(b) for b in blocks]
    kept = minimum_cut(score, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null and empty html give an empty text. Other columns are ignored; rows that repeat give repeated
    results. A page is parsed in one task, so its size is bounded by what a row may hold.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT")
