"""Main text of web pages by minimum cut.

A page is read into text blocks with their place in the document tree. A naive Bayes classifier on length, link
share, element and closing mark gives each block log odds of being content; it is trained on all pages of
the table, by counts of those blocks whose surroundings say what they are (``article``, ``nav``, …). Odds and
surroundings become a block's capacities to source and sink; neighbours in reading order and blocks of
one container get smoothness edges. The minimum cut parts content from boilerplate: blocks whose own
capacity outweighs all their edges are settled at once, max-flow decides the rest.

Defined results: null, empty and text-free html give an empty text; a page without any block judged as content
too. Broken markup is read as far as it goes: an unclosed script hides the rest, a stray ``<`` is text. Repeated rows and
null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and words in class, id and role that tell what a part of a page is for.
BOILER_TAGS = frozenset("nav footer aside menu button select dialog noscript".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar"
    " navigation menu breadcrumb breadcrumbs sidebar side aside complementary footer contentinfo cookie"
    " cookies consent notice alert popup modal overlay comment comments respond disqus replies share sharing"
    " social related recommended newsletter subscribe signup login search widget pagination pager".split()
)
CONTENT_WORDS = frozenset("article content story post entry".split())
CONTENT_HEADS = CONTENT_WORDS | frozenset("body text".split())
# Names with these tell how a page is laid out or what state it is in, not what the element holds.
LAYOUT_WORDS = frozenset(
    "has have no not with without is open closed enabled disabled wrap wrapper container outer inner layout grid"
    " row col column columns theme page site results".split()
)
HEADER = "header"
HEADER_NAMES = frozenset("header site-header page-header".split())
# Names here tell of the whole page's layout.
ROOT_TAGS = frozenset("html body".split())
HIDDEN_TAGS = frozenset("script style title textarea template iframe svg math object".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    boiler: bool
    content: bool
    container: int
    outer: int
    form: int = 0


@dataclass
class _Open:
    tag: str
    boiler: bool
    content: bool
    container: int
    outer: int
    nearest: str
    form: int = 0  # number of the outermost form around, if any


def named_kind(token: str) -> bool | None:
    """What a name says of its element: boilerplate (False), content (True) or nothing.

    The last word of a compound is what the thing is, earlier ones what it belongs to: ``article-comments``
    are comments, and ``related-posts``, with a head of no meaning here, is told by its first word.
    """
    parts = _WORD.findall(token)
    if not parts:
        return None
    if parts[-1] in CONTENT_WORDS or (parts[0] in CONTENT_WORDS and parts[-1] in CONTENT_HEADS):
        return True
    if not LAYOUT_WORDS.isdisjoint(parts):
        return None
    return False if parts[-1] in BOILER_WORDS or parts[0] in BOILER_WORDS else None


def _opened(tag: str, attributes: str, above: _Open, number: int) -> _Open:
    tokens: set[str] = set()
    if "=" in attributes and tag not in ROOT_TAGS:
        for found in _NAMES.findall(attributes):
            tokens.update("".join(found).lower().split())
    kinds = {named_kind(t) for t in tokens}
    header = (tag == HEADER or not HEADER_NAMES.isdisjoint(tokens)) and not above.content
    inherited = above.boiler and tag not in CONTENT_TAGS
    boiler = inherited or header or tag in BOILER_TAGS or False in kinds
    content = above.content or tag in CONTENT_TAGS or True in kinds
    form = number if tag == "form" and not above.form else above.form
    if tag in INLINE_TAGS:
        return _Open(tag, boiler, content, above.container, above.outer, above.nearest, form)
    return _Open(tag, boiler, content, number, above.container, tag, form)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, white space made plain, references decoded."""
    blocks: list[Block] = []
    stack = [_Open("", False, False, 0, -1, "")]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = number = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            blocks.append(
                Block(
                    text, min(linked, len(text)), top.nearest, top.boiler, top.content,
                    top.container, top.outer, top.form,
                )
            )
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links else 0

    def close(tag: str) -> None:
        nonlocal links
        if not depth[tag]:
            return
        if tag not in INLINE_TAGS:
            flush()
        while True:
            top = stack.pop()
            if parts and (top.boiler, top.content) != (stack[-1].boiler, stack[-1].content):
                stack.append(top)
                flush()
                stack.pop()
            depth[top.tag] -= 1
            links -= top.tag == "a"
            if top.tag == tag:
                return

    size = len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            close(tag)
            continue
        if tag in HIDDEN_TAGS:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in SELF_CLOSING and stack[-1].nearest == tag:
            close(tag)
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS:
            if tag not in INLINE_TAGS:
                flush()
            continue
        number += 1
        opened = _opened(tag, found[3], stack[-1], number)
        same = (opened.boiler, opened.content) == (stack[-1].boiler, stack[-1].content)
        if tag not in INLINE_TAGS or not same:
            flush()
        stack.append(opened)
        depth[tag] += 1
        links += tag == "a"
    flush()
    return _with_forms(blocks)


def _with_forms(blocks: list[Block]) -> list[Block]:
    """Mark what stands in forms, but for a form that holds most of the page's text: it only wraps the page."""
    held: Counter[int] = Counter()
    for block in blocks:
        held[block.form] += len(block.text)
    for block in blocks:
        if block.form and 2 * held[block.form] <= held.total():
            block.boiler = True
    return blocks


# --- classifier -----------------------------------------------------------------------------


def features(block: Block) -> tuple[str, ...]:
    """Discrete features, of a few dozen values in all. Unusual elements share one."""
    tag = block.tag if block.tag in _TAGS else "other"
    return (
        f"length {len(block.text).bit_length()}",
        f"linked {4 * block.linked // len(block.text)}",
        f"tag {tag}",
        f"closed {block.text[-1] in '.!?…:'}",
    )


_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th div section blockquote pre figcaption body dd dt".split())


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, bool]] = Counter()
    for batch in batches:
        for page in batch.column("html"):
            for block in blocks_of(page.as_py() or ""):
                if block.boiler or block.content:
                    counts.update((f, not block.boiler) for f in (*features(block), "all"))
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        ["feature", "content", "n"],
    )


def train(pages: DataFrame) -> dict[str, float]:
    """Log odds by feature, from all pages; a few dozen rows reach the driver."""
    parts = pages.select("html").mapInArrow(_counting, "feature string, content boolean, n long")
    rows = parts.groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()
    n = {(r["feature"], r["content"]): r["n"] for r in rows}
    totals = {kind: n.get(("all", kind), 0) + 20 for kind in (True, False)}
    return {
        f: float(
            np.log((n.get((f, True), 0) + 10) / totals[True])
            - np.log((n.get((f, False), 0) + 10) / totals[False])
        )
        for f in sorted({f for f, _ in n} - {"all"})
    }


# --- cut ------------------------------------------------------------------------------------

# With the best odds and its edges a marked block can still be content.
BOILER_COST, CONTENT_GAIN, MOST_ODDS = 4.0, 4.0, 3.0
ADJACENT, TOGETHER, APART = 0.6, 0.8, 0.15


def unary(block: Block, odds: Mapping[str, float]) -> float:
    """Capacity from the source (content) less capacity to the sink (boilerplate)."""
    own = sum(odds.get(f, 0.0) for f in features(block))
    own = max(-MOST_ODDS, min(MOST_ODDS, own))
    return own - BOILER_COST * block.boiler + CONTENT_GAIN * (block.content and not block.boiler)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow one another, more if they share a container, and
    between successive blocks of a container or of its parent."""
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            near = {before.container, before.outer} & {block.container, block.outer}
            edges.append((i - 1, i, ADJACENT if near else APART))
        for container in {block.container, block.outer}:
            if container in last:
                edges.append((last[container], i, TOGETHER))
            last[container] = i
    return edges


def min_cut(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True is the source side (content)."""
    around: list[list[tuple[int, float]]] = [[] for _ in own]
    for i, j, weight in edges:
        around[i].append((j, weight))
        around[j].append((i, weight))
    own, open_sum = list(own), [sum(w for _, w in a) for a in around]
    label: list[bool | None] = [None] * len(own)
    waiting = [i for i in range(len(own)) if abs(own[i]) >= open_sum[i]]
    while waiting:
        i = waiting.pop()
        if label[i] is not None:
            continue
        # Whatever its undecided neighbours become, this side costs no more.
        label[i] = own[i] > 0
        for j, weight in around[i]:
            if label[j] is None:
                own[j] += weight if label[i] else -weight
                open_sum[j] -= weight
                if abs(own[j]) >= open_sum[j] - 1e-9:
                    waiting.append(j)
    rest = [i for i in range(len(own)) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, own, around), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], own: list[float], around) -> list[bool]:
    """Dinic's algorithm on the undecided blocks; capacities in millionths."""
    place = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    head: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    left: list[int] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((round(forth * 1e6), round(back * 1e6)))

    for i in nodes:
        edge(source, place[i], max(own[i], 0), 0)
        edge(place[i], sink, max(-own[i], 0), 0)
        for j, weight in around[i]:
            if j in place and i < j:
                edge(place[i], place[j], weight, weight)
    while True:
        level = [-1] * len(head)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * len(head)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not left[e])
                a = to[path[full] ^ 1]
                del path[full:]
            elif turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if left[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    turn[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None, odds: Mapping[str, float]) -> str:
    blocks = blocks_of(page or "")
    labels = min_cut([unary(b, odds) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, kept in zip(blocks, labels, strict=True) if kept)


def _extracting(odds: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), odds) for page in batch.column("html")]
            kept = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"]
            )

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    slim = pages.select("page_id", "url", "html")
    id_type = pages.schema["page_id"].dataType.simpleString()
    found = slim.mapInArrow(
        _extracting(train(pages)), f"page_id {id_type}, url string, text string"
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
