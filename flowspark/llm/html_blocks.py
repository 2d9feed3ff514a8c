"""Main text of web pages by line-block distribution.

A page becomes a list of lines, one for each block of markup.  Elements that are never article text
(menus, page headers and footers, sidebars, adverts, scripts, reader comments) leave a run of empty
lines behind.  Class, id and role only hint at them: a name all of whose parts are known (``ad-box``)
marks an element, but not the article in it; a name with a known part (``google-ads``), like a form,
marks it unless it holds an article or half of the page's text.  Names of states (``has-sidebar``,
``comments-open``) mark nothing, and articles are only marked as comments or adverts.  The text lengths of ``WIDTH`` neighbouring lines are summed; the text between a
surge (the sum reaches the threshold) and the next dive (the sum falls to zero) is kept.

The threshold is ``SURGE``, or a quarter of the page's largest sum if that is less.  A line counts
with its characters outside links; inside ``<article>`` or ``<main>`` with all its characters, and
``INSIDE`` times if half of the page's text or more is inside.  Lines outside are weighted by the
share of the text that is outside.  So a page's whole article outweighs what stands around it, and a
teaser in an ``<article>`` does not outweigh a body in a ``<div>``.  No run crosses the edge of an
article.  A line with text outside links that no run has, between two kept lines of the same parent,
is kept as well: a short paragraph between two adverts belongs to its neighbours.  So are the paragraphs of
the element that has most of the kept text, and its headings in front of that text: a heading above a share
bar, and a last sentence below an advert.  The headings of the article around that element are kept too, or
else the last ``h1`` around it.  Inside an article, a name (but for adverts and comments) drops an
element only if it holds less than half of the article's text.

Defined results: null or empty html gives an empty text; html without markup is one line and is
kept; an element that is never closed ends where its parent ends, at the next article, or at the end
of the page; a tag cut off by the end of the page is dropped.  Pages are independent, so repeated
rows give repeated results, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import map_rows, pick

#: Lines in a window.
WIDTH = 3
#: Characters in a window at which text starts.
SURGE = 80
#: Weight of a character inside an article that holds half of the page's text or more.
INSIDE = 20

# Names of HTML elements and the words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
DROPPED = frozenset(
    "head script style noscript template textarea title iframe svg canvas object audio video map nav aside footer "
    "button select option datalist fieldset label dialog menu menuitem header".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related reply replies share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo alert alertdialog search".split()
)
#: Words beside these in a name that say where or how large, and words that name a state.
LAYOUT = frozenset("area article bar block body bottom box container content div group inner item list main outer page panel post row section site slot text top unit wrap wrapper".split())
STATES = frozenset("allow closed disabled enabled has hidden hide is no not off on open show with without".split())
#: What names a part as an article's own header, and what an article itself can be marked as.
OWN = frozenset("article entry post story".split())
LESSER = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored".split())
NEVER_BY_CLASS = frozenset("html body main".split())
FRAME = ("article", "main")
#: Blocks that stand for one paragraph: their lines belong to the element around them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("br dd dt h1 h2 h3 h4 h5 h6 hr li p pre".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marked(name: str, attrs: str, inside: bool) -> str:
    """How class, id or role name boilerplate: "surely", "maybe" or "".  A header inside an article is
    its own."""
    if name in NEVER_BY_CLASS:
        return ""
    best = "maybe" if name == "form" else ""
    for found in _MARK.finditer(attrs):
        for word in (found[1] or found[2] or found[3] or "").split():
            parts = {p.lower() for p in _PART.findall(word)}
            hits = parts & BOILERPLATE - (frozenset(("header", "byline")) if inside or parts & OWN else frozenset())
            if not hits or parts & STATES:
                continue
            known = all(p in LAYOUT or p in hits or p.isdigit() for p in parts)
            if name == "article":
                known, hits = known and bool(hits & LESSER), ()
            if known:
                if not inside or hits & LESSER or name == "article":
                    return "surely"
                best = "maybe"  # it may hold most of the article
            best = "maybe" if hits else best
    return best


class Marked:
    """An element that its names mark, with what was counted before it and in it."""

    def __init__(self, above: Marked | None, surely: bool, depth: int, articles: int, chars: int, frames: int) -> None:
        self.inside = articles > 0
        self.above, self.surely, self.depth, self.articles = above, surely, depth, articles
        self.chars, self.frames = -chars, -frames

    def close(self, chars: int, frames: int) -> None:
        self.chars += chars
        self.frames += frames

    def judge(self, total: int, within: int) -> None:
        """Whether all lines in it are lost, and how many articles a line must stand in not to be.  ``total``
        and ``within``: characters of the page and of its articles."""
        above = self.above
        lost = not self.frames and (self.surely or 2 * self.chars < (within if self.inside else total))
        self.lost = lost or above is not None and above.lost
        self.within = self.articles + 1 if self.surely else above.within if above else 0


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, int, str]], dict[int, int]]:
    """(text with markup stripped, characters outside links, inside an article, parent, block) for each line,
    and the parent of each parent."""
    lines: list[tuple[str, int, int, int, str, Marked | None]] = []
    text: list[str] = []
    plain = 0  # characters of the line so far that are not in a link
    open_tags: list[str] = []
    places: dict[str, list[int]] = {}  # depths of the open elements of a name
    blocks: list[int] = []  # depths of the open blocks
    parents = [0]  # the number of the last open element that is no paragraph, for each depth
    up: dict[int, int] = {}
    articles = links = elements = frames = chars = 0
    dropped_at: int | None = None  # depth at which a dropped element was opened
    marked: Marked | None = None
    every: list[Marked] = []

    def end_line() -> None:
        nonlocal plain, chars
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append((line, plain, articles, parents[-1], open_tags[blocks[-1]] if blocks else "", marked))
                chars += len(line)
        text.clear()
        plain = 0

    def add(piece: str) -> None:
        nonlocal plain
        if piece and dropped_at is None:
            text.append(piece)
            if not links:
                plain += len(piece.strip())

    def gap() -> None:
        end_line()
        lines.extend([("", 0, 0, 0, "", None)] * WIDTH)

    def leave(depth: int) -> None:
        """Close every element from ``depth`` up."""
        nonlocal articles, links, dropped_at, marked
        was, inner = articles, False
        if marked is not None and marked.depth >= depth or any((places.get(name) or [-1])[-1] >= depth for name in FRAME):
            end_line()
        for name in open_tags[depth:]:
            articles -= name in FRAME
            links -= name == "a"
            places[name].pop()
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        while marked is not None and marked.depth >= depth:
            marked.close(chars, frames)
            marked, inner = marked.above, True
        del open_tags[depth:], parents[depth + 1 :]
        if dropped_at is not None and depth <= dropped_at:
            dropped_at = None
            gap()
        elif dropped_at is None and (inner or was and not articles):
            gap()

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = m["close"] or m["close2"]
        attrs = m["attrs"] or m["attrs2"] or ""
        block = name in BLOCKS
        if closing:
            if block and dropped_at is None:
                end_line()
            # The innermost open element of this name; inline elements do not close a block.
            here = places.get(name)
            if here and (block or not blocks or blocks[-1] < here[-1]):
                leave(here[-1])
            continue
        mark = _marked(name, attrs, articles > 0) if dropped_at is None or name in FRAME else ""
        if name in FRAME and dropped_at is not None and not articles and not places.get(name) and not mark:
            leave(dropped_at)  # the element before it was never closed
        if block and dropped_at is None:
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and open_tags and open_tags[-1] == name:
                end_line()
                leave(len(open_tags) - 1)
            end_line()
        if name in VOID or attrs.endswith("/") and not block:
            continue
        open_tags.append(name)
        places.setdefault(name, []).append(len(open_tags) - 1)
        if block:
            blocks.append(len(open_tags) - 1)
        elements += 1
        if block and name not in PARAGRAPHS:
            up[elements] = parents[-1]
        parents.append(elements if block and name not in PARAGRAPHS else parents[-1])
        if dropped_at is None and name in DROPPED and not (name == "header" and articles):
            gap()
            dropped_at = len(open_tags) - 1
        elif dropped_at is None and mark:
            gap()
            marked = Marked(marked, mark == "surely", len(open_tags) - 1, articles, chars, frames)
            every.append(marked)
        if name in FRAME and dropped_at is None:
            if not articles:
                gap()
            frames += not mark
        articles += name in FRAME
        links += name == "a"
    add(page[at:])
    end_line()
    while marked is not None:
        marked.close(chars, frames)
        marked = marked.above
    within = sum(len(line) for line, _, depth, *_ in lines if depth)
    for one in every:  # outer elements come first
        one.judge(chars, within)
    return [(line, plain, depth > 0, parent, block) for line, plain, depth, parent, block, by in lines if by is None or not by.lost and depth >= by.within], up


def main_text(page: str | None) -> str:
    """The text between surges and dives, blocks joined by one space."""
    if not page:
        return ""
    lines, up = lines_of(page)
    length = [len(line) if inside else plain for line, plain, inside, *_ in lines]
    within = sum(n for n, line in zip(length, lines, strict=True) if line[2])
    share = within / max(1, sum(length))
    size = [n * ((INSIDE if share >= 0.5 else 1) if line[2] else 1 - share) for n, line in zip(length, lines, strict=True)]
    sums = [sum(size[i : i + WIDTH]) for i in range(len(size))]
    surge = max(1, min(SURGE, max(sums, default=0) // 4))
    kept: set[int] = set()
    i = 0
    while i < len(lines):
        if sums[i] < surge:
            i += 1
            continue
        while i < len(lines) and sums[i] > 0:
            if lines[i][0]:
                kept.add(i)
            i += 1
    # First and last kept line of each parent.
    ends: dict[int, tuple[int, int]] = {}
    for i in sorted(kept):
        ends[lines[i][3]] = (ends.get(lines[i][3], (i,))[0], i)
    between = {i for i, n in enumerate(size) if n > 0 and lines[i][3] in ends and ends[lines[i][3]][0] < i < ends[lines[i][3]][1]}
    # The element with most of the kept text: its headings with text behind them, and all its paragraphs.
    weight: dict[int, int] = {}
    for i in kept:
        weight[lines[i][3]] = weight.get(lines[i][3], 0) + len(lines[i][0])
    body = max(weight, key=lambda p: (weight[p], -p), default=None)
    own = {i for i, line in enumerate(lines) if line[0] and line[3] == body and (line[4] == "p" or line[4] in HEADINGS and i < ends[body][1])}
    return " ".join(lines[i][0] for i in sorted(kept | between | own | set(above(lines, up, body, ends.get(body, (0,))[0]))))


def above(lines: list[tuple[str, int, bool, int, str]], up: dict[int, int], body: int | None, start: int) -> list[int]:
    """Headings in front of the body in an element around it: all of its article's, else the last ``h1``."""
    around = set()
    while body in up:
        body = up[body]
        around.add(body)
    found = [i for i in range(start) if lines[i][4] in HEADINGS and lines[i][0] and lines[i][3] in around]
    return [i for i in found if lines[i][2]] or [i for i in found if lines[i][4] == "h1"][-1:]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; no shuffle, one pass."""

    def start():
        def work(rows: dict[str, list]) -> dict[str, list]:
            texts = [main_text(x) for x in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pick(pages, page_id=page_id, url=url, html=html_col), "page_id long, url string, text string, n_chars long", start)
