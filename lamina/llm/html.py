"""Main text of web pages by a minimum cut.

A page falls into blocks of text within a tree of elements; both are nodes of a flow network. What a classifier says of a
block's text (its length, links, tag and ending) is the block's capacity to the source or the sink; what an element's tag or
names say of all that is in it is the element's. Smoothness edges link each node to the element around it, firmly within an
element that a tag or name speaks of, and blocks that follow one another, the more so the nearer they are in the DOM. The
minimum cut between both ends is the labelling of least cost: a short line goes with the paragraphs around it, a paragraph with
its sidebar. The classifier is fitted to pages themselves: blocks that elements of a clear meaning hold are its examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, table

#: Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template textarea title svg math iframe object canvas select option datalist audio video".split())
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
_OPENS, _NAME, _CLOSES = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])"), re.compile(r"[^\s/>]+"), re.compile(r"=\s*([\"'])|>")
#: Elements inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Log-odds that text within such an element is boilerplate (above 0) or content.
ELEMENTS = {"nav": 8.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "button": 6.0, "menu": 6.0, "dialog": 6.0, "fieldset": 6.0, "header": 4.0, "head": 8.0, "article": -5.0, "main": -4.0}
#: The same of words in class, id and role.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies copyright disclaimer disqus "
    "feedback foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup print promo promoted promotion "
    "recommended recommendations register related replies reply respond reviews rss search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud tags teaser toolbar "
    "topbar tracking warning widget widgets".split()
)
#: Those of them that name what others wrote, or other articles: an article within is not the page's own.
OTHERS = frozenset("comment comments commentlist disqus recommended recommendations related replies reply respond reviews promoted sponsored teaser".split())
CONTENT = frozenset("article articlebody blogpost body content entry main maincontent post postcontent prose story text".split())
WORD_ODDS, CONTENT_ODDS = 7.0, -2.0
#: Capacity between neighbouring blocks of one parent, between a node and an element that says nothing, and one that does.
NEXT, LOOSE, FIRM = 0.5, 1.0, 4.0
#: A block's text says so much at most: less than a firm edge, as much as some loose ones.
TEXT_MOST = 3.0
_WORDS = re.compile(r"[a-z]+")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: The classifier's features of a block, with the weights that it has without examples.
PLAIN_WEIGHTS = {"": 0.0, "short": 0.8, "long": -1.5, "some links": 0.0, "links": 4.0, "paragraph": -1.0, "heading": 0.0, "item": 0.0, "sentence": 0.0}
_KINDS = {**dict.fromkeys(("h1", "p", "pre", "blockquote"), "paragraph"), **dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("li", "dt", "dd", "td", "th"), "item")}
#: Pages that the classifier is fitted to at most, and blocks that its examples count as, both kinds alike: against weights
#: that each are held near the plain ones as by one example.
SAMPLE, EVIDENCE = 2_000, 200.0


class Block:
    __slots__ = ("depth", "odds", "parent", "says", "shared", "text")

    def __init__(self, text: str, says: tuple[str, ...], parent: int, depth: int, shared: int):
        """says: the classifier's features; parent: the number of the innermost element, -1 for none; depth: elements around
        the block, and shared: those of them around the block before as well."""
        self.text, self.says, self.parent, self.depth, self.shared, self.odds = text, says, parent, depth, shared, 0.0


class Element:
    """words: those of BOILERPLATE in its names, with the class "comment" or "reply" as such; content: whether one is of CONTENT;
    above: articles and mains that it is in; before: how many blocks came before; held: characters in it, and in articles in it."""

    __slots__ = ("above", "articles", "before", "blocks", "content", "firm", "held", "odds", "others", "own", "parent", "reply", "tag", "up", "words")

    def __init__(self, tag: str, attributes: str, parent: Element | None, up: int, before: int):
        self.tag, self.parent, self.up, self.before = tag, parent, up, before
        self.above = (parent.above | {parent.tag} if parent.tag in ("article", "main") else parent.above) if parent else frozenset()
        self.held = self.articles = self.blocks = 0
        self.words, self.content, self.reply = set(), False, False
        for m in _NAMED.finditer(attributes):
            value = m[1] or m[2] or m[3] or ""
            words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            self.words.update(w for w in words if w in BOILERPLATE and not (self.above and w == "header"))  # an article's header is its own
            self.content = self.content or any(w in CONTENT for w in words)
            self.reply = self.reply or not {"comment", "reply"}.isdisjoint(value.lower().split())

    def within(self, *tags: str) -> bool:
        return self.tag in tags or not self.above.isdisjoint(tags)


def _boilerplate(e: Element, total: int, in_articles: int, after_text: bool) -> bool:
    """Whether the words that e is named by speak of the text in it, and not of the page that it wraps.

    total, in_articles: characters of the page; after_text: a paragraph of content came before e.
    """
    if not e.words or e.tag in ("html", "body", "main"):
        return False
    most = 2 * e.held > total
    others = not e.words.isdisjoint(OTHERS)
    if e.tag == "article":
        return (e.reply or others and "article" in e.above) and (after_text or not most)
    # What is left outside of e must not be the article itself, as beside a long notice.
    wraps = 0 < in_articles <= 2 * e.articles or most and (bool(e.above) or 4 * (in_articles - e.articles) < e.held)
    return not wraps or others and after_text


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """What isn't text, in order: (begin, end, name, whether it ends an element, attributes); the name is empty for what is
    dropped whole. In linear time: nothing is looked for again once the rest of the page was seen not to have it."""
    at, size, quoted = 0, len(html), True
    while m := _OPENS.search(html, at):
        begin, at = m.start(), m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = size if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        end = -1
        if quoted and m[0][-1] not in "!?":
            end = at
            while c := _CLOSES.search(html, end):
                end = c.start() if c[0] == ">" else html.find(c[1], c.end()) + 1
                if c[0] == ">" or not end:
                    break
            if not c or not end:
                quoted, end = False, -1  # an open quote: from here on quotes hide nothing
        if end < 0:
            end = html.find(">", at)
        if end < 0:  # no tag ends any more; a comment may begin
            begin = html.find("<!--", at)
            if begin >= 0:
                yield begin, size, "", False, ""
            return
        if m[0][-1] in "!?":
            at = end + 1
            yield begin, at, "", False, ""
            continue
        name = _NAME.match(html, at - 1)
        tag, ends, attributes = name[0].lower(), m[0][1] == "/", html[name.end() : end]
        at = end + 1
        if tag in DROPPED:
            if not ends and not (tag in ("svg", "math") and attributes.endswith("/")):
                close = _ENDS[tag].search(html, at)
                at = close.end() if close else size
            yield begin, at, "", False, ""
        else:
            yield begin, at, tag, ends, attributes


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks in order: runs of text between block elements; and its elements."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []  # the elements that are open
    opened: Counter = Counter()
    parts: list[str] = []
    linked = in_link = lowest = 0

    def close_block() -> None:
        nonlocal parts, linked, lowest
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                n, share = len(text), min(1.0, linked / len(text))
                says = ["", "short" if n < 40 else "long" if n >= 100 else "", "links" if share > 0.5 else "some links" if share else ""]
                says += [_KINDS.get(elements[stack[-1]].tag, "") if stack else "", "sentence" if text[-1] in ".!?…。！？" else ""]
                out.append(Block(text, (says[0], *filter(None, says)), stack[-1] if stack else -1, len(stack), lowest))
                lowest = len(stack)
        parts, linked = [], 0

    def pop() -> None:
        nonlocal lowest
        opened[elements[stack.pop()].tag] -= 1
        lowest = min(lowest, len(stack))

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            parts.append(html[a:b])
            if in_link:
                linked += b - a

    at = 0
    for begin, end, tag, ends, attributes in tags_of(html):
        text(at, begin)
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        close_block()
        in_link = 0
        if ends:
            if opened[tag]:
                while elements[stack[-1]].tag != tag:
                    pop()
                pop()
        elif tag not in VOID:
            if stack and elements[stack[-1]].tag == "p":
                pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and elements[stack[-1]].tag == tag:
                pop()
            up = stack[-1] if stack else -1
            elements.append(Element(tag, attributes, elements[up] if stack else None, up, len(out)))
            stack.append(len(elements) - 1)
            opened[tag] += 1
    text(at, len(html))
    close_block()
    return out, elements


def classify(blocks: list[Block], elements: list[Element], weights: dict[str, float]) -> None:
    """Sets each block's odds, from its text alone, and each element's own, from its tag and names; an element's odds are what
    it and those around it say together."""
    for b in blocks:
        b.odds = max(-TEXT_MOST, min(TEXT_MOST, sum(weights[f] for f in b.says)))
        if b.parent >= 0:
            elements[b.parent].held += len(b.text)
            elements[b.parent].blocks += 1
    total = in_articles = 0
    for e in reversed(elements):
        inside = e.held if e.tag in ("article", "main") else e.articles
        if e.parent:
            e.parent.held += e.held
            e.parent.articles += inside
            e.parent.blocks += e.blocks
        else:
            in_articles += inside
    total = sum(len(b.text) for b in blocks)
    done, after_text = 0, False

    def finish(end: int) -> None:
        nonlocal done, after_text
        for b in blocks[done:end]:
            e = elements[b.parent] if b.parent >= 0 else None
            odds = b.odds + (e.odds if e else 0.0)
            after_text = after_text or odds < -1.0 and (len(b.text) >= 100 or e is not None and (e.within("article") or e.tag == "p" and e.within("main")))
        done = max(done, end)

    for e in elements:
        finish(e.before)
        above, e.firm, e.others = (e.parent.odds, e.parent.firm, e.parent.others) if e.parent else (0.0, False, False)
        if _boilerplate(e, total, in_articles, after_text):
            own = WORD_ODDS
            e.others = e.others or not e.words.isdisjoint(OTHERS)
        else:
            own = CONTENT_ODDS if e.content else 0.0 if e.above and e.tag == "header" else ELEMENTS.get(e.tag, 0.0)
            e.firm = e.firm or own > 0
        if own > 0 and above < 0:
            above = 0.0  # boilerplate within the article
        elif own < 0 and above > 0:
            if e.tag in ("article", "main") and not e.firm and not e.others:
                above = 0.0  # only names spoke against it
            else:
                own = 0.0  # a comment's own article stays a comment
        e.own, e.odds = own, max(-6.0, above + own)


def network(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal odds of all nodes, the blocks first, then the elements with blocks in them; and the smoothness edges.

    What an element says counts for each block in it, and so does a firm edge, so that more blocks don't outweigh it.
    """
    number, odds, edges = {}, [b.odds for b in blocks], []
    for i, e in enumerate(elements):
        if e.blocks:
            number[i] = len(odds)
            odds.append(e.own * (1 + e.blocks))
            if e.parent:
                edges.append((number[e.up], number[i], FIRM * e.blocks if e.parent.odds else LOOSE))
    for i, b in enumerate(blocks):
        if b.parent >= 0:
            edges.append((number[b.parent], i, FIRM if elements[b.parent].odds else LOOSE))
        if i and b.shared:
            edges.append((i - 1, i, NEXT * b.shared / max(b.depth, blocks[i - 1].depth)))
    return odds, edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, content: node i costs odds[i] there if that is above 0, else -odds[i] at the sink;
    an edge costs its capacity when it is cut. By blocking flows in layers."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    links: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        links[a].append(len(to))
        links[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, x in enumerate(odds):
        if x < 0:
            link(source, i, -x, 0.0)
        elif x > 0:
            link(i, sink, x, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        layer = [-1] * (n + 2)
        layer[source], queue = 0, [source]
        for x in queue:
            for e in links[x]:
                if room[e] > 1e-9 and layer[to[e]] < 0:
                    layer[to[e]] = layer[x] + 1
                    queue.append(to[e])
        if layer[sink] < 0:
            return [k >= 0 for k in layer[:n]]
        left = [len(x) for x in links]  # edges of each node that aren't used up in this layering
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= 1e-9 and not cut:
                        cut = k + 1
                del path[max(0, cut - 1) :]
                x = to[path[-1]] if path else source
                continue
            while left[x]:
                e = links[x][left[x] - 1]
                if room[e] > 1e-9 and layer[to[e]] == layer[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                left[x] -= 1
            else:
                if not path:
                    break
                x = to[path.pop() ^ 1]
                left[x] -= 1


def labelled(html: str | None, weights: dict[str, float] = PLAIN_WEIGHTS) -> tuple[list[Block], list[bool]]:
    """The blocks of a page with the classifier's odds, and which of them the cut makes content."""
    blocks, elements = blocks_of(html or "")
    classify(blocks, elements, weights)
    return blocks, minimum_cut(*network(blocks, elements))[: len(blocks)]


def main_text(html: str | None, weights: dict[str, float] = PLAIN_WEIGHTS) -> str:
    """The content blocks of a page, white space within each made one space, joined by line feeds; empty if there is none."""
    return "\n".join(b.text for b, k in zip(*labelled(html, weights), strict=True) if k)


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """The classifier's weights from about ``sample`` of pages (page_id, html): a logistic fit to blocks that an element of a
    clear meaning holds (an article or main without boilerplate around; a menu, footer, sidebar, form), counted by their
    features. A null html has no blocks, repeated pages count as often; without blocks of both kinds the weights are the plain ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                blocks, elements = blocks_of(html or "")
                kinds: list[int] = []
                for e in elements:
                    around = kinds[e.up] if e.up >= 0 else 0
                    says = ELEMENTS.get(e.tag, 0.0) if e.tag != "header" else 0.0
                    kinds.append(1 if says > 0 or around > 0 else -1 if says < 0 else around)
                counts.update((b.says, kinds[b.parent] > 0) for b in blocks if b.parent >= 0 and kinds[b.parent])
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"says": pa.array([list(k) for k, _ in keys], pa.list_(pa.string())), "boilerplate": pa.array([k for _, k in keys], pa.bool_()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    taken = bounded_sample(pages.select("page_id", "html"), sample, "page_id").select("html")
    cells = taken.mapInArrow(counted, "says array<string>, boilerplate boolean, n long").groupBy("says", "boilerplate").agg(F.sum("n").alias("n")).collect()  # as many as combinations of features
    names, plain = list(PLAIN_WEIGHTS), np.array(list(PLAIN_WEIGHTS.values()))
    if len({r.boilerplate for r in cells}) < 2:
        return dict(PLAIN_WEIGHTS)
    x = np.array([[name in r.says for name in names] for r in cells], float)
    y = np.array([r.boilerplate for r in cells], float)
    n = np.array([r.n for r in cells], float)
    n *= np.where(y > 0, EVIDENCE / 2 / n[y > 0].sum(), EVIDENCE / 2 / n[y == 0].sum())
    w = plain.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (n * (y - p)) - (w - plain))
    return dict(zip(names, w.tolist(), strict=True))


def extracted(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html counts as empty: no text. Rows that repeat, or have no page_id, each have their own row; equal pages have equal
    texts; where two labellings cost the same, a block is boilerplate. Other columns are left out, so none can clash; an empty
    table gives an empty one. A page takes time in proportion to its size. Without weights they are fitted to the pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html_col).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(weights or learn(rows))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted() of all pages, by a classifier fitted to them."""
    return extracted(table(spark, sf_dir, "pages"))
