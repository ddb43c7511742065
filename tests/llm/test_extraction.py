"""Main text of given and made-up pages, broken markup, and edge cases."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from parcelsight.llm import extraction
from parcelsight.llm.extraction import main_text
from parcelsight.llm.queries import op12_html_extraction

PLAIN = ("The thhant eder of the inlyth and thtiat is a thing that was in the heart of the matter, and "
         "it is with us as the day on which they came to be one of the many in that land, which is not "
         "an end but a start for all of them.")
TWO = f"{PLAIN} {PLAIN}"


def test_pages(spark, folder):
    """The given pages hold one article element each: its blocks, and nothing else."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op12_html_extraction(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("page, blocks", [
    # nothing but lengths, links and stop words to go by
    (f"<html><body><div id=top><a href=/>Home</a> <a href=/b>News</a></div><div class=main-col><h1>Title "
     f"here</h1><p>{PLAIN}</p><p>Short one.</p><p>{TWO}</p><p>Reouer ouan.</p></div><div "
     f"class='comments'><h3>Comments</h3><p>{TWO}</p></div><div>Copyright © 2020 X</div></body></html>",
     ["Title here", PLAIN, "Short one.", TWO, "Reouer ouan."]),
    # every kind of boilerplate element, and reader comments that are articles themselves
    (f"<body class='has-sidebar'><header><h1>Site</h1><p>{PLAIN}</p></header><main><article><header><h1>"
     f"Real</h1></header><p>{PLAIN}</p><p>xx</p><div class='share'>Share this</div><aside><p>{PLAIN}</p>"
     f"</aside><p>end.</p><footer>By me</footer></article><section id='comments'><article class='comment'>"
     f"<p>{PLAIN}</p></article></section></main><aside>{PLAIN}</aside><form><p>{PLAIN}</p></form></body>",
     ["Real", PLAIN, "xx", "end."]),
    (f"<nav><ul><li><a href=x>A</a><article><h1>T</h1><p>{PLAIN}</article><footer>f", ["T", PLAIN]),
    ("<nav><a href=x>A</a></nav><div class=ad>Buy</div><article><h1>T</h1><p>Eath. Thble.</p></article>"
     "<footer>x</footer>", ["T", "Eath. Thble."]),
    ("<article><p>a&lt;b &amp;amp; c&nbsp;d &#233; &eacute &copy</p></article>", ["a<b &amp; c d é é ©"]),
    ("<article><p>hi <script>if(a<b){x='</p>'}</script>there</p><!-- <p>no</p> --><STYLE>p{}</STYLE>"
     "<noscript>enable it</noscript></article>", ["hi there"]),
    ("<article><table><tr><td>one</td><td>two</td></tr></table><ul><li>a<li>b</ul><blockquote>q"
     "</blockquote></article>", ["one", "two", "a", "b", "q"]),
    (f"<article><p>{PLAIN}</p><ul class=related><li><a href=x>Another story</a></ul><p>tail</p></article>",
     [PLAIN, "tail"]),
    (f"<div class='cookie-notice'>{PLAIN}</div><div class='sidebar'><p>{PLAIN}</p></div><div "
     f"class='content'><p>{TWO}</p></div>", [TWO]),
    # a wrapper that is named like a box but holds the page
    (f"<div class='widget page'><h1>Head</h1><p>{TWO}</p><p>{PLAIN}</p></div><div class='footer'>foot</div>",
     ["Head", TWO, PLAIN]),
    (f"<article><p>{PLAIN}</p><div style='display: none'>no</div><div hidden>no</div></article>", [PLAIN]),
    ("<article><p>3 < 4 and\n\t 5 > 2</p></article>", ["3 < 4 and 5 > 2"]),
    ("<article>one<br>line<br><br>next</article>", ["one line", "next"]),
    (f"<article><p title='a > b'>{PLAIN}</p></article>", [PLAIN]),
    ("", []), (None, []), ("   ", []), (PLAIN, [PLAIN]), ("<nav>only <a href=x>links</a></nav>", []),
])
def test_made_up_pages(page, blocks):
    assert main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("page", [
    "<p a='" * 20_000, "<" * 100_000, "<!--" * 50_000, "<script>" * 50_000, "<textarea>" * 50_000,
    "<div>x" * 20_000, "<div class=ad><h1>x</h1>" * 10_000, "</section>" * 50_000 + "<div>" * 50_000,
    "<p>" + "&amp;" * 100_000])
def test_hostile_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5


def test_long_pages_are_read_whole():
    assert main_text("<article>" + f"<p>{PLAIN}</p>" * 5000 + "</article>") == "\n\n".join([PLAIN] * 5000)


def test_edge_rows(spark):
    page = f"<article><p>{PLAIN}</p></article>"
    frame = spark.createDataFrame(
        [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", page)],
        "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn(
            "n_chars", F.lit(1))
    got = extraction.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == [
        (0, "v", "", 0), (1, "u", PLAIN, len(PLAIN)), (1, "u", PLAIN, len(PLAIN)), (2, "", "", 0),
        (3, "w", PLAIN, len(PLAIN))]
    assert extraction.extract(frame.limit(0)).count() == 0
