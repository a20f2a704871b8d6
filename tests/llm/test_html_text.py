import html.parser
import time

import pytest
from pyspark.sql import functions as F

from storelens.llm import html_text
from storelens.llm.html_text import main_text

LONG = "This sentence is part of the article and long enough to stand out from everything that surrounds it on the page."
MORE = "A second paragraph goes on for a while, names a <a href='/x'>linked source</a>, and ends with a full stop."
MORE_TEXT = "A second paragraph goes on for a while, names a linked source, and ends with a full stop."


class Article(html.parser.HTMLParser):
    """The text of the article element, by the standard library's parser: one line a heading or paragraph."""

    def __init__(self):
        super().__init__()
        self.lines, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def by_parser(page):
    p = Article()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(x.split()) for x in p.lines) if x)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_pages_equal_the_parsed_articles(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.report(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and any(r["n_chars"] for r in got.values())
    for r in rows:
        want = by_parser((r["html"] or "").replace("<br>", " "))
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


MENU = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(7))
PAGES = {
    "unmarked": (f"<html><body><div><div><ul>{MENU}</ul></div></div><div><div><h2>Title here</h2><p>{LONG}</p><p>{MORE}</p><p>Short.</p></div></div>"
                 "<div><div><div><span>(c) 2024 somebody</span></div></div></div></body></html>", f"Title here\n{LONG}\n{MORE_TEXT}\nShort."),
    "classes": (f'<body><div class="cookie-consent"><p>{LONG}</p></div><div id="mainMenu"><p>{LONG}</p></div><div class="content has-sidebar"><h1>T</h1><p>{LONG}</p>'
                f'<div class="ad-slot"><p>{MORE}</p></div><p>End.</p></div><div class="comments"><p>{LONG}</p></div><div id="page-footer"><p>{LONG}</p></div></body>',
                f"T\n{LONG}\nEnd."),
    "article": (f"<body><header><h1>Site</h1></header><nav>{MENU}</nav><article><header><h1>Head</h1><p>By somebody</p></header><p>x</p><form><p>{LONG}</p></form><p>y</p>"
                f"<aside><p>{LONG}</p></aside><blockquote>z</blockquote><footer>tags</footer></article><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p>"
                "</article></section></body>", "Head\nx\ny\nz"),
    "main": (f"<body><div class=banner>{LONG}</div><main role='main'><p>Only &amp; this&nbsp;&#x41;&lt;b&gt;</p></main><p>{LONG}</p></body>", "Only & this A<b>"),
    "wrapped": (f"<form class='search header'><article><p>{LONG}</p></article></form>", LONG),
    "raw": (f"<body><script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p > a</style><!-- <p>{LONG}</p> --><p title='a > b'>{LONG}</p><textarea><p>no</textarea>", LONG),
    "unclosed": (f"<article><p>one<p>two<br>three <b>bold<p>four &am<ul><li>five<li>six</ul><p>se</i>ven</article><p cla", "one\ntwo three bold\nfour &am\nfive\nsix\nseven"),
    "cut off": (f"<article><p>{LONG}</p><p>and th<a href='x", f"{LONG}\nand th"),
    "table": ("<article><table><tr><th>a<th>b<tr><td>1</td><td>2</td></tr></table></article>", "a b\n1 2"),
    "plain": ("no markup at all", "no markup at all"),
    "short": ("<div><p>Hi.</p></div>", "Hi."),
    "empty": ("", ""), "null": (None, ""), "only menu": (f"<nav>{MENU}</nav>", ""), "bogus": ("</><!><?php x?><![CDATA[y]]><p>text</p>", "text"),
    "stray": ("<article></div></p><p>a < b and c > d</p></section></article>", "a < b and c > d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    assert main_text(PAGES[name][0]) == PAGES[name][1]


def test_surge_and_dive():
    """A short block between two gaps falls below the threshold; the same block beside a long one stays."""
    gap = "<div></div><div></div>"
    assert main_text(f"<p>{LONG}</p>{gap}<p>Some leftover.</p>") == LONG
    assert main_text(f"<p>{LONG}</p><p>Some leftover.</p>") == f"{LONG}\nSome leftover."


def test_odd_tables(spark):
    rows = [(1, "u", PAGES["main"][0], "x"), (1, "u", PAGES["main"][0], "x"), (None, None, None, None), (2, None, "", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted((tuple(r) for r in html_text.report(pages).collect()), key=str) == sorted(
        [(1, "u", "Only & this A<b>", 16)] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert html_text.report(pages.where("false")).count() == 0
    out = html_text.extract(pages.withColumn("lines", F.lit(1)))
    assert out.columns == ["page_id", "url", "html", "lines", "text"]


def test_long_pages_take_linear_time():
    began = time.time()
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n") == 19_999
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<nav>" * 50_000 + LONG, "<a b=\"" * 50_000, "<" * 100_000, "&" * 100_000, "<!--" * 50_000, "<p>" * 100_000):
        main_text(page)
    assert time.time() - began < 20
