import time

import numpy as np
import pytest

from tailseries.llm.html_text import extract_main_text, main_text, smooth

LONG = "A sentence of the article that is long enough to be taken for content, with some more words in it."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words &amp; more", "just words & more"),
        (f"<nav><ul><li><a href=a>Home</a></ul></nav><article><h1>T&eacute;</h1><p>{LONG}<p>No.</article><footer>&copy; x</footer>", f"Té {LONG} No."),
        (f"<article><p><b>{LONG}<br><p>Be.</p><p>{LONG}</p></article>", f"{LONG} Be. {LONG}"),
        (f"<body><div class='ad'>{LONG}</div><main><p>{LONG}\n two</p><form>{LONG}<input></form></main></body>", f"{LONG} two"),
        (f"<div id=comments><p>{LONG}</p></div><div class=post><p>{LONG}</p><p>a<i>b</i>c</p></div>", f"{LONG} abc"),
        (f"<article><p>{LONG}</p><script>var x = '</p>';</script><style>p{{}}</style></article>", LONG),
        (f"<article><p>{LONG}</p><aside>{LONG}</aside><!-- no --><p>end</p>", f"{LONG} end"),
        (f"<nav><a href=x>menu<article><p>{LONG}</p></article>", LONG),
        ("<p>" + "w " * 200_000, ("w " * 200_000).strip()),
        (f"<article><h1 class='article-header'>Head</h1><p class='social-history'>{LONG}</p>"
         f"<div class='search-results-study'>{LONG}</div><p class=notice>Mind.</p></article>", f"Head {LONG} {LONG} Mind."),
        (f"<article><p>{LONG}</p><div class='social-share'>Post it</div><ul class=related-links><li>more</ul></article>", LONG),
        (f"<div class='cookie-notice'><p>{LONG}</p></div><div id=site-header>{LONG}</div><div><p>{LONG}</p></div>", LONG),
        (f"<div><p>{LONG}</p></article></span></main></div><p>{LONG}", f"{LONG} {LONG}"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_table(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS _id")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract_main_text(pages.where("page_id < 0")).collect() == []


def test_smoothing_keeps_a_constant_and_spreads_a_peak():
    assert np.allclose(smooth(np.ones(9))[2:-2], 1)
    assert (np.diff(smooth(np.eye(1, 9, 4)[0])[2:5]) > 0).all()


def test_time_grows_with_the_page_and_not_with_its_depth():
    def seconds(n):
        started = time.process_time()
        assert main_text("<article>" + "<div>" * n + LONG + "</p>" * n) == LONG
        return time.process_time() - started

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4000), 0.01)
