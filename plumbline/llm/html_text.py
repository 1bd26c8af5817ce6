"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams over the whole page. Its events build lines: a line is the text between
two block boundaries, with the number of tags that were opened in it, its characters inside links and the container it
lies in. Elements that never hold main text (menus, forms, scripts, and elements whose class, id or role says so) are
left out as they stream by. A class, id or role says so if it is one of ``SKIPPED_WORDS`` or made of such words only, or
if it is a compound that begins or ends with one of ``SKIPPED_ENDS`` (``ad-slot``, ``left-sidebar-box``) and is no mere state
(``has-sidebar``). It never leaves out a main or heading, an article that is not inside another article or main, nor an
element around an article, main or h1 (such a page is read twice).

If the page has a ``main`` with text, only its lines are candidates; else those of its ``article`` elements; else all.
Each line has a text-to-tag ratio: its characters outside links, over its tags, counted up to ``LONG`` so that no line
sets the scale of the page. The ratios of the candidates are smoothed with a Gaussian along the page, and lines above a
threshold (half the standard deviation of the smoothed ratios, never above the largest) form the content cluster.
Content regions are the containers whose text lies mostly in it (a line of an ``article`` or ``main`` belongs to that
element however deep it lies); of each region all lines are kept, so a heading or a one-word paragraph between long
ones stays. If no region has most of its text in the cluster, all candidates are kept.

Edge cases: null and empty html give an empty text, and so does a page without text. Character references are
decoded once, white space inside a block becomes one space. An element ends with its end tag, with a start tag that
ends it (p, li, dd, dt, headings and table parts need no end tag) or with an element around it. Marked sections and
declarations of any kind are comments up to the next ``>``; a tag, comment or declaration that the page's end cuts off is
dropped. If leaving out compounds leaves no text, the page is read without that rule. A page that the parser refuses
altogether gives the text between its tags. Repeated page_ids are separate rows, a null page_id or url is passed on.
There is no limit on length. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that never hold main text, and words in class, id or role that say the same.
SKIPPED = {
    "head", "title", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select",
    "textarea", "iframe", "object", "svg", "canvas", "menu", "dialog",
}
SKIPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "complementary", "contentinfo", "search",
}
SKIPPED_ENDS = {  # first or last word of a compound
    "ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "related", "sidebar", "sponsor", "sponsored", "subscribe",
}
NEUTRAL = {"area", "block", "box", "container", "inner", "outer", "section", "wrap", "wrapper"}  # last words that say nothing
STATES = {"has", "have", "is", "no", "not", "on", "with", "without", "hide", "show", "open", "opened", "close", "closed", "enabled", "disabled", "active", "status", "count"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
HOLDERS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Fixed values of the HTML syntax: what a start tag ends, and the elements that an end looks no further than.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main", "h1"}  # an element around one of them is not skipped by class, id or role
UNNAMED = {"article", "body", "html", "main", *HEADINGS, *VOID}  # nor is one of these
HEAD = {"base", "head", "link", "meta", "noscript", "script", "style", "template", "title"}
SCOPE = {"caption", "html", "object", "table", "td", "template", "th"}
LISTS = {"ol", "ul", "menu"}
TABLE_PARTS = {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", *HEADINGS,
}
_SPECIAL = (BLOCKS | SKIPPED) - {"address", "div", "p"}
ENDED_BY = {  # start tag: (elements it ends, barrier, whether the outermost one ends)
    "li": ({"li"}, _SPECIAL, False), "dd": ({"dd", "dt"}, _SPECIAL, False), "dt": ({"dd", "dt"}, _SPECIAL, False),
    "td": ({"td", "th", "caption"}, {"table", "template"}, True), "th": ({"td", "th", "caption"}, {"table", "template"}, True),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "template"}, True), "button": ({"button"}, SCOPE, False),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (TABLE_PARTS, {"table", "template"}, True)),
}
SIGMA, RADIUS = 1.0, 2
LONG = 200.0  # ratio of a line that is surely text; higher ones count as this
_PART = re.compile("[-_]+")
_CUT_OFF = re.compile(r"<(?:[!?]|/?[A-Za-z])")
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


def _says_skipped(attrs, compounds: bool = True) -> bool:
    """Whether a class, id or role is one of the words, consists of them, or is a compound with one at an end."""
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.lower().split():
                parts = [p for p in _PART.split(token) if p]
                if token in SKIPPED_WORDS or parts and SKIPPED_WORDS.issuperset(parts):
                    return True
                while len(parts) > 1 and parts[-1] in NEUTRAL:
                    parts.pop()
                if compounds and "-" in token.replace("_", "-") and not SKIPPED_ENDS.isdisjoint((parts[0], parts[-1])) and STATES.isdisjoint(parts):
                    return True
    return False


def _hidden(attrs) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


class LineReader(HTMLParser):
    """Lines of a page with their tag counts and regions."""

    def __init__(self, kept: set[int] = frozenset(), compounds: bool = True):
        super().__init__(convert_charrefs=True)
        self.kept = kept  # numbers of start tags that attributes do not skip
        self.compounds = compounds
        self.number = 0  # start tags so far
        self.found: set[int] = set()  # skipped by attributes although they hold main text
        self.named: list[tuple[int, int]] = []  # open elements skipped by class, id or role: place in open, number
        self.lines: list[tuple[str, int, int, int, str]] = []  # text, tags, characters in links, region, holder
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.open: list[tuple[str, bool, int, str]] = []  # open elements: name, skipped, region, holder they lie in
        self.count: Counter[str] = Counter()  # open elements by name
        self.skips = 0  # open elements that are skipped
        self.regions = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            region, holder = self.open[-1][2:] if self.open else (0, "")
            self.lines.append((text, self.tags, self.linked, region, holder))
        if self.parts:
            self.parts = []
        self.tags = self.linked = 0

    def parse_marked_section(self, i, report=1):
        """Everything from ``<![`` to the next ``>`` is a comment."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    parse_html_declaration = parse_declaration = parse_marked_section

    def read(self, html: str) -> LineReader:
        self.feed(html)
        if _CUT_OFF.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self.flush()
        return self

    def _remove(self, k: int):
        tag, skipped, _, _ = self.open.pop(k)
        self.count[tag] -= 1
        self.skips -= skipped
        k %= len(self.open) + 1
        self.named = [(at - (at > k), number) for at, number in self.named if at != k]

    def _close(self, names: set[str], barrier: set[str], outermost: bool = False):
        """Ends the innermost (or outermost) open element of ``names`` above the barrier, with all that is open in it."""
        if not any(self.count[n] for n in names):
            return
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in names:
                found = k
                if not outermost:
                    break
            elif tag in barrier:
                break
        if found is not None:
            if sum(x[1] for x in self.open[found:]) == self.skips:  # not inside a skipped element
                self.flush()
            while len(self.open) > found:
                self._remove(-1)

    def _end_before(self, tag: str):
        """Ends the open elements that a start tag ends without an end tag of their own."""
        if self.open and self.open[-1][0] == "head" and tag not in HEAD:
            self._close({"head"}, SCOPE)
        if tag in ENDS_P:
            self._close({"p"}, SCOPE | {"button"})
        if tag in ENDED_BY:
            names, barrier, outermost = ENDED_BY[tag]
            self._close(names, barrier, outermost)
        elif tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag == "a" and self.count["a"]:
            self._end_one("a")

    def _end_one(self, tag: str):
        """Ends an element and leaves open what is open in it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self._remove(k)
            if self.open[k][0] in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        self.number += 1
        self._end_before(tag)
        if tag in ("html", "body", "form") and self.count[tag]:
            return
        _, _, region, holder = self.open[-1] if self.open else ("", False, 0, "")
        able = tag not in UNNAMED or tag == "article" and holder != ""
        named = bool(attrs) and able and tag not in SKIPPED and self.number not in self.kept and _says_skipped(attrs, self.compounds)
        skipped = tag not in VOID and (named or tag in SKIPPED or bool(attrs and tag not in ("html", "body") and _hidden(attrs)))
        if tag in MAIN and not skipped and self.skips == len(self.named):
            self.found.update(number for at, number in self.named if self.open[at][0] != "article")
        if not self.skips:
            if tag in BLOCKS or tag in SKIPPED:
                self.flush()
            if tag == "br":
                self.parts.append(" ")
            if not skipped:
                self.tags += 1
                if tag in CONTAINERS and not holder:
                    self.regions += 1
                    region, holder = self.regions, tag if tag in HOLDERS else ""
                elif tag == "main":
                    holder = "main"
        if tag not in VOID:
            if named and not _hidden(attrs):
                self.named.append((len(self.open), self.number))
            self.open.append((tag, skipped, region, holder))
            self.count[tag] += 1
            self.skips += skipped

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self.skips:
            self.flush()
        if not self.count[tag] and tag not in HEADINGS:
            return
        if tag in TABLE_PARTS:
            self._close({tag}, {"table", "template"})
        elif tag in ("html", "body", "head", "template", "table"):
            self._close({tag}, {"template"})
        elif tag in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag in BLOCKS or (tag in SKIPPED and tag != "form"):
            self._close({tag}, SCOPE | LISTS if tag == "li" else SCOPE)
        else:
            self._end_one(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._close({"head"}, SCOPE)
        if not self.skips:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def lines_of(html: str) -> list[tuple[str, int, int, int, str]]:
    """Lines of one page: text, tags, characters in links, region, holder."""
    try:
        lines: list = []
        for compounds in (True, False):
            reader = LineReader(compounds=compounds).read(html)
            if reader.found:
                reader = LineReader(reader.found, compounds).read(html)
            lines = reader.lines
            if lines:
                break
        return lines
    except (AssertionError, IndexError, RecursionError, ValueError):  # the parser refuses the page
        parts = (" ".join(unescape(t).split()) for t in re.split(r"<[^>]*>?", html))
        return [(t, 1, 0, 0, "") for t in parts if t]


def main_text(html: str) -> str:
    """Main text of one page; see the module's description."""
    lines = lines_of(html)
    for holder in ("main", "article"):
        if any(x[4] == holder for x in lines):
            lines = [x for x in lines if x[4] == holder]
            break
    if not lines:
        return ""
    chars = np.array([len(x[0]) for x in lines], dtype=float)
    ratios = np.clip((chars - [x[2] for x in lines]) / np.maximum(1, [x[1] for x in lines]), 0.0, LONG)
    weight = np.convolve(np.ones(len(lines)), _KERNEL, "same") if len(lines) > RADIUS * 2 else np.full(len(lines), 1.0)
    smooth = np.convolve(ratios, _KERNEL, "same") / weight if len(lines) > RADIUS * 2 else ratios
    content = smooth >= min(smooth.std() / 2, smooth.max())
    regions = np.array([x[3] for x in lines])
    most = np.bincount(regions, weights=chars * content) * 2 >= np.bincount(regions, weights=chars)
    kept = most[regions] if most[regions].any() else np.ones(len(lines), dtype=bool)
    return "\n".join(x[0] for x, keep in zip(lines, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    source = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
