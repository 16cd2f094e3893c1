"""Main text of HTML pages from text-to-tag ratios.

The standard library's parser reads a page once and sends events.  Block elements end
lines; a line has its text, the tags met since the line before it, and its place in the
tree of open blocks.  Lines inside menus, page headers, footers, sidebars, notices,
adverts, forms and reader comments (by element, role, or class and id names) have no
weight.  The other lines weigh the logarithm of text per tag, and a Gaussian smooths the
weights along the page.  Lines at or above one standard deviation of the smoothed weights
are seeds; as a root mean square is never above a maximum, a page with text has a seed.

Seeds are gathered by the blocks around them.  The content region is the article (or main)
element of the greatest seed weight; on pages without one, the smallest block that holds
all seeds.  All lines of weight in the region are the main text, whether seeds or not,
and so is a heading straight before it; on pages without an article element, list and
layout lines that are links almost whole are left out as unnamed menus.

Defined cases: null or empty html has an empty text; a page without tags is one line;
broken nesting, open comments and stray end tags are read the way browsers do; equal
rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqthin.llm.batches import small_batches, text_slices

SIGMA, RADIUS = 1.0, 3
#: Share of a line that is links, from which a line outside paragraphs counts as a menu's.
LINKED = 0.8
#: Other text outweighs article elements by so much: they are teasers.
TEASERS = 4.0
#: Depth to which end tags that are left out are looked for, as in browsers.
DEPTH = 512

# Elements and names of HTML and of usual page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset header hgroup hr html legend li main menu nav noscript ol optgroup p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head script style template noscript svg iframe object canvas audio video title noframes".split())
CONTROLS = frozenset("button select textarea label option datalist output meter progress legend fieldset".split())
CHROME = frozenset("nav aside footer header form dialog menu".split()) | CONTROLS
WRAPS = frozenset("form header fieldset label".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar masthead header footer sidebar aside "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe "
    "subscription paywall share sharing social related recommended recommendations comment comments commentlist disqus "
    "respond reply replies login signin signup search searchbox widget widgets copyright colophon skip outbrain taboola".split()
)
#: Next to such a part a name tells of something else than its chrome ("no-sidebar", "entry-header").
OTHER_SENSE = frozenset("no has with without free not".split())
TITLE_PARTS = frozenset("article post entry story content title".split())
CONTENT_NAMES = frozenset(
    "content main main-content maincontent article article-body article-content post post-body post-content entry "
    "entry-content story story-body page-content body-content".split()
)
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}), **{h: (set(HEADINGS), {"div", "section", "article", "body"}) for h in HEADINGS},
}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TAG_MARK, NAME_MARK, GONE, MAIN, NAMED = 1, 2, 4, 8, 16
COMMENT_END = re.compile("--!?>")
RAW_END = re.compile(r"</(script|style)[\s/][^>]*>", re.I)
#: Elements that only hold a line or two, never a page's content.
NARROW = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote figure figcaption caption tr tbody table".split())


def marks_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element's tag, role, class and id say about it."""
    marks = TAG_MARK * (tag in CHROME) | GONE * (tag in UNSEEN) | MAIN * (tag in ("article", "main"))
    if not attrs:
        return marks
    held = {k: v or "" for k, v in reversed(attrs)}
    role = held.get("role", "").strip().lower()
    marks |= TAG_MARK * (role in CHROME_ROLES)
    marks |= MAIN * (role in ("main", "article") or "articleBody" in held.get("itemprop", ""))
    if "hidden" in held or held.get("aria-hidden", "").strip().lower() == "true" or INVISIBLE.search(held.get("style", "")):
        marks |= GONE
    for name in f"{held.get('class', '')} {held.get('id', '')}".split():
        parts = [p.lower() for p in PART.findall(name)]
        chrome = CHROME_NAMES.intersection(parts)
        if chrome == {"header"} and TITLE_PARTS.intersection(parts):
            continue
        # A page or an article may be named for what it has besides; a comment may be an article, too.
        whole = tag in ("html", "body", "main") or tag == "article" and not {"comment", "comments", "reply"} & chrome
        if chrome and not whole and not OTHER_SENSE.intersection(parts):
            marks |= NAME_MARK
        if name.lower() in CONTENT_NAMES:
            marks |= NAMED
    return marks


def _ended(html: str) -> str:
    """Without a tag that the page's end cuts, and with plain ends of scripts and styles."""
    end = cut = len(html)
    while (at := html.rfind("<", 0, end)) >= 0 and html.find(">", at, end) < 0:
        if html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] in ("/", "!", "?"):
            cut = at if html[at : at + 4] != "<!--" else cut
        end = at
    return RAW_END.sub(r"</\1>", html[:cut])


class PageLines(HTMLParser):
    """Lines of a page, and the tree of blocks around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Of each node: its parent (never a later one), marks and tag.
        self.parent, self.marks, self.tag_of = [-1], [0], ["#page"]
        self.stack: list[tuple[str, int, bool]] = []
        self.open: Counter[str] = Counter()
        self.at = self.unseen = self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        #: (node, text, tags, characters of links)
        self.lines: list[tuple[int, str, int, int]] = []

    def read(self, html: str) -> "PageLines":
        self.feed(_ended(html))
        self.close()
        self.end_line()
        return self

    def updatepos(self, i: int, j: int) -> int:
        # Lines and columns of the source are not asked for.
        return j

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i + 3) + 1 or len(self.rawdata)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.lines.append((self.at, text, self.tags, self.linked))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _push(self, tag: str, marks: int, unseen: bool) -> None:
        self.parent.append(self.at)
        self.marks.append(marks)
        self.tag_of.append(tag)
        self.at = len(self.parent) - 1
        self.stack.append((tag, self.at, unseen))
        self.open[tag] += 1
        self.unseen += unseen

    def _leave(self, size: int) -> None:
        """Close what is open beyond the first ``size`` elements."""
        while len(self.stack) > size:
            tag, node, unseen = self.stack.pop()
            self.open[tag] -= 1
            self.unseen -= unseen
            self.at = self.parent[node]

    def _leave_alike(self, tag: str) -> None:
        """Close the element that this one follows where its end tag is left out."""
        same, over = SAME_LEVEL[tag]
        if any(self.open[t] for t in same):
            for i in range(len(self.stack) - 1, max(-1, len(self.stack) - DEPTH), -1):
                if self.stack[i][0] in over:
                    return
                if self.stack[i][0] in same:
                    return self._leave(i)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.end_line()
            if self.open["p"]:
                self.handle_endtag("p")
                self.tags -= 1
            if tag in SAME_LEVEL:
                self._leave_alike(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.links += tag == "a"
        marks = 0 if self.open["pre"] or self.open["code"] else marks_of(tag, attrs)
        if block or marks or self.open[tag] or tag == "code":
            # Inline chrome is taken out of the line it stands in.
            self._push(tag, marks, bool(marks & GONE or not block and marks & (TAG_MARK | NAME_MARK)))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        block = tag in BLOCKS
        if block:
            self.end_line()
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    return self._leave(i)
                if not block and self.stack[i][0] in BLOCKS:
                    return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0


def smoothed(weights: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(weights, kernel / kernel.sum())[radius : radius + len(weights)]


def _chrome(page: PageLines, chars: list[int]) -> list[int]:
    """Of each node: 0 content, 1 chrome, 2 chrome but for its headings (the header of an article)."""
    n = len(page.parent)
    below, paragraphs, title = [False] * n, [0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        below[up] |= below[i] or bool(page.marks[i] & MAIN)
        paragraphs[up] += paragraphs[i] + (page.tag_of[i] == "p")
        title[up] |= title[i] or page.tag_of[i] == "h1"
    out, inside = [0] * n, [False] * n
    for i in range(1, n):
        up, marks, tag = page.parent[i], page.marks[i], page.tag_of[i]
        inside[i] = inside[up] or bool(marks & MAIN)
        out[i] = out[up]
        if out[i] == 1 or not marks & (TAG_MARK | NAME_MARK | GONE):
            continue
        # What holds most of a page, its article included, is around the content, whatever its name.
        around = 2 * chars[i] >= chars[0] and (below[i] or tag != "header" and title[i] and paragraphs[i] > 2)
        if not marks & GONE and around and (tag in WRAPS or not marks & TAG_MARK):
            continue
        out[i] = 2 if tag == "header" and inside[up] and not marks & (NAME_MARK | GONE) else 1
    return out


def content_lines(page: PageLines) -> list[int]:
    """Indexes of the lines that are main text."""
    lines, parent, marks = page.lines, page.parent, page.marks
    n = len(parent)
    chars = [0] * n
    for node, text, _, _ in lines:
        chars[node] += len(text)
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
    chrome = _chrome(page, chars)
    live = [chrome[node] == 0 or chrome[node] == 2 and page.tag_of[node] in HEADINGS for node, *_ in lines]
    if not any(live):
        return []
    weights = smoothed(np.array([np.log1p(len(t) / max(1, tags)) if ok else 0.0 for ok, (_, t, tags, _) in zip(live, lines)]))
    seeds = [ok and w >= d for ok, w, d in zip(live, weights, np.full(len(lines), weights.std()))]
    if not any(seeds):
        seeds = live
    mass, seeded, alive, held = [0.0] * n, [0] * n, [0] * n, [0] * n
    for (node, text, _, _), ok, seed, w in zip(lines, live, seeds, weights.tolist()):
        if ok:
            alive[node] += len(text)
            held[node] += 1
        if seed:
            mass[node] += w
            seeded[node] += 1
    for i in range(n - 1, 0, -1):
        up = parent[i]
        mass[up] += mass[i]
        seeded[up] += seeded[i]
        alive[up] += alive[i]
        held[up] += held[i]

    def heaviest(which) -> int:
        """The first of the heaviest nodes with text, 0 for none."""
        return max((i for i in range(1, n) if alive[i] and which(i)), key=lambda i: (mass[i], alive[i], -i), default=0)

    region = heaviest(lambda i: marks[i] & MAIN and page.tag_of[i] != "main")
    main = heaviest(lambda i: marks[i] & MAIN)
    region = main if mass[main] > 2 * mass[region] else region
    if region and mass[0] - mass[region] > TEASERS * mass[region]:
        region = 0
    menus = not region
    if not region:
        region = heaviest(lambda i: marks[i] & NAMED)
        if 2 * mass[region] < mass[0]:
            region = 0
    if not region:
        # Blocks around all seeds lie within each other, so the last is the smallest.
        region = max(i for i in range(n) if seeded[i] == seeded[0])
        while region and (page.tag_of[region] in NARROW or held[region] < 2):
            region = parent[region]
    inside = [False] * n
    for i in range(n):
        inside[i] = i == region or i > 0 and inside[parent[i]]

    def listed(line) -> bool:
        node, text, _, linked = line
        return page.tag_of[node] not in HEADINGS | {"p"} and linked >= LINKED * len(text.replace(" ", ""))

    out = [j for j, line in enumerate(lines) if live[j] and inside[line[0]] and not (menus and listed(line))]
    before = (out[0] if out else 0) - 1
    while before >= 0 and live[before] and page.tag_of[lines[before][0]] in HEADINGS:
        out.insert(0, before)
        before -= 1
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = PageLines().read(html or "")
    return "\n".join(page.lines[j][1] for j in content_lines(page))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, name="html"):
                texts = [main_text(h) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    small_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
