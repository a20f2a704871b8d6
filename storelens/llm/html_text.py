"""Main text of web pages by line-block distribution.

The page's markup is stripped to lines, one a block element, and blank lines where containers begin or end.
A line weighs its text without that of links (within paragraphs, headings and the like all of it counts). The
weights are summed over sliding windows of ``WINDOW`` lines. Where a window's sum rises from zero is a surge,
where it falls to zero a dive; the text between a surge and its dive is kept if a window in between reaches
the threshold: ``SURGE`` characters, or half of the page's highest sum if that is less. Elements that are no
text by their name, role or class (menus, headers, footers, sidebars, notices, adverts, forms, comments) count
as one blank line. Where the page marks its article (``article``, else ``main``), lines elsewhere weigh nothing and
every surge within it counts; headings in an article's header stay.

Character references are decoded, white space in a line (line breaks included) becomes one space, and lines
are trimmed and joined by one newline. Defined results: null, empty and text-free pages give the empty text; a
tag or comment cut off by the page's end is dropped; unclosed elements end with the page or where HTML lets
them end; repeated rows give repeated rows; an empty table gives an empty result; other columns pass through
(one that bears the new column's name is replaced). The time is linear in the page's length.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import prepare, whole

WINDOW = 3
SURGE = 80
DEEP = 8  # elements without text that count within one another

#: Elements without text for the reader, as they stand; their content is no markup.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
#: Elements that are no part of a text.
NO_TEXT = {"head", "nav", "menu", "header", "footer", "aside", "form", "dialog", "noscript", "template", "svg", "object", "canvas", "audio", "video",
           "button", "select", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark such elements.
MARKS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager",
         "header", "masthead", "topbar", "banner", "footer", "colophon", "copyright",
         "sidebar", "aside", "widget", "widgets", "related", "recommended",
         "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall",
         "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
         "login", "signup", "search", "share", "sharing", "social",
         "comment", "comments", "commentlist", "disqus", "replies", "respond"}
HEADERS = {"header", "masthead", "banner"}
#: After these a mark says what the element has beside it ("has-sidebar"), not what it is.
OWNS = {"has", "with", "no", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks of running text; a border of any other block stands for a blank line as well.
PROSE = {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "address", "tr", *HEADINGS}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "figure", "fieldset", "details",
              "summary", "hr", "center", "hgroup", *NO_TEXT}
VOID = {"hr"}
#: What a start tag ends, up to what.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"})}

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|</>|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in RAW}


class Region:
    """An element that is no text; ``loose`` if an article within it shows that it is one after all."""

    __slots__ = ("drop", "loose", "header")

    def __init__(self, loose: bool, header: bool):
        self.drop, self.loose, self.header = True, loose, header


def _region(name: str, rest: str) -> Region | None:
    if name in ("html", "body"):
        return None
    words: set[str] = set()
    if "=" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            key = key.lower()
            if key in ("class", "id"):
                parts = re.split(r"[^a-z0-9]+", _CASE.sub(" ", html.unescape("".join(values))).lower())
                words.update(x for before, x in zip(["", *parts], parts) if before not in OWNS)
            elif key == "role" and "".join(values).strip().lower() in ROLES:
                return Region(True, False)
    if name in NO_TEXT:
        return Region(name in ("form", "nav", "header"), name == "header")
    if not words.isdisjoint(MARKS):
        return Region(name not in ("article", "main"), not words.isdisjoint(HEADERS))
    return None


class Line:
    __slots__ = ("text", "weight", "regions", "article", "main", "heading")

    def __init__(self, text="", weight=0, regions=(), article=False, main=False, heading=False):
        self.text, self.weight, self.regions, self.article, self.main, self.heading = text, weight, regions, article, main, heading


def lines_of(page: str) -> list[Line]:
    """The page's lines in order, blank ones at the borders of containers."""
    out: list[Line] = []
    stack: list[tuple[str, Region | None]] = []
    count: dict[str, int] = {}  # of open elements, by name
    regions: tuple[Region, ...] = ()
    parts: list[str] = []
    articles = mains = at = linked = 0
    in_link, prose = False, ""

    def flush(blank: bool) -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                weight = len(text) if prose else max(0, len(text) - linked)
                out.append(Line(text, weight, regions, articles > 0, mains > 0, prose in HEADINGS))
        linked = 0
        if blank:
            out.append(Line(regions=regions))

    def close(k: int) -> None:
        """End the open elements from the k-th on."""
        nonlocal regions, articles, mains
        gone = stack[k:]
        del stack[k:]
        for x, _ in gone:
            count[x] -= 1
        n = sum(r is not None for _, r in gone)
        if n:
            regions = regions[: len(regions) - n]
        articles -= sum(x == "article" and r is None for x, r in gone)
        mains -= sum(x == "main" and r is None for x, r in gone)

    while True:
        m = _MARKUP.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m["end"]:
                e = _RAW_END[name].search(page, at)
                at = e.end() if e else len(page)
            parts.append(" ")
        elif name == "a":
            in_link = not m["end"] and "href" in m["rest"].lower()
        elif name in ("br", "td", "th", "wbr", "img"):
            if name != "wbr":
                parts.append(" ")
        elif name in PROSE or name in CONTAINERS:
            blank = name in CONTAINERS
            flush(blank)
            if m["end"]:
                if count.get(name):
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            else:
                if stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in ENDS:
                    ends, up_to = ENDS[name]
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in up_to:
                            break
                        if stack[i][0] in ends:
                            close(i)
                            break
                region = _region(name, m["rest"]) if len(regions) < DEEP else None
                if region is None and name in ("article", "main"):
                    for r in regions:
                        r.drop = r.drop and not r.loose
                    articles, mains = articles + (name == "article"), mains + (name == "main")
                if name not in VOID:
                    stack.append((name, region))
                    count[name] = count.get(name, 0) + 1
                    if region:
                        regions = (*regions, region)
            prose = stack[-1][0] if stack else ""
            prose = prose if prose in PROSE and prose not in ("li", "tr") else ""
    flush(False)
    return out


def main_text(page: str | None) -> str:
    """The text between surges and dives of the line-block distribution."""
    lines = lines_of(page or "")
    marked = "article" if any(x.article for x in lines) else "main" if any(x.main for x in lines) else None
    weights, texts = [], []
    for x in lines:
        if any(r.drop and not (r.header and x.heading and (x.article or x.main)) for r in x.regions):
            continue
        keep = marked is None or getattr(x, marked)
        texts.append(x.text if keep else "")
        weights.append(x.weight if keep else 0)
    total = [0, *itertools.accumulate(weights)]
    sums = [total[min(i + WINDOW, len(weights))] - total[i] for i in range(len(weights))]
    least = 1 if marked else min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    i = 0
    while i < len(sums):
        if not weights[i]:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= least:
            kept += [x for x in texts[i:dive] if x]
        i = dive
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", to: str = "text", keep_html: bool = True) -> DataFrame:
    """Add the main text of every page; without ``keep_html`` the page itself is not returned."""
    prepare(pages.sparkSession)
    pages = pages.select(*[c for c in pages.columns if c != to or c == html_col])
    at = pages.columns.index(html_col)
    kept = [i for i in range(len(pages.columns)) if keep_html or i != at]
    names = [*(pages.columns[i] for i in kept), to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), text], names)

    return pages.mapInArrow(run, T.StructType([*(pages.schema.fields[i] for i in kept), T.StructField(to, T.StringType())]))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its number of code points, per page."""
    out = extract(pages.select("page_id", "url", whole(F.col("html")).alias("html")), keep_html=False)
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
