import html
import re

import duckdb
import pytest

from zonarium.llm.html_text import extract_pages, main_text


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy a long thing of many words that goes on and on.</div><div id="cookieNotice">We use cookies</div>
    <article><h1>Head &lt;b&gt;</h1><p><b>One.<br><p>Two  &nbsp;three<br>four <i>fi</i>ve &amp;amp;
    </p><ul><li>a<li>b</ul><p>x.<form><p>Sign up</p></form><aside>Side</aside>
    <div class="reader comments"><p>First!</p></div><p>End</p></article><footer>&copy; all</footer></body></html>"""
    assert main_text(page) == "Head <b>\nOne.\nTwo three four five &amp;\na\nb\nx.\nEnd"


def test_page_without_article():
    words = "word " * 30
    page = f"<div class=menu><a href=x>Home</a></div><p><a href=1>one</a> <a href=2>two</a></p><div><p>{words}</p><p>Short.</p><p>{words}end</p></div><div id='footer'>Contact</div>"
    assert main_text(page) == f"{words.strip()}\nShort.\n{words}end"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "<div></div>", "<nav>a</nav>", "&amp;" * 3, "</p></div>" * 50, "<div>" * 3000])
def test_edges(page):
    assert "\n" not in main_text(page)


def test_whole_table(spark):
    """Against an independent reading of these pages: the paragraphs of the article, without inline markup."""
    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r for r in extract_pages(spark.read.parquet(path)).collect()}
    rows = duckdb.sql(f"select page_id, html from '{path}'").fetchall()
    assert len(got) == len(rows)
    for page_id, page in rows:
        body = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body[1].replace("<br>", " "))) if body else []
        want = "\n".join(x for b in blocks if (x := " ".join(html.unescape(b).split())))
        assert got[page_id].text == want and got[page_id].n_chars == len(want)


def test_empty_and_repeated(spark):
    schema = "page_id long, url string, html string, text string"
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, None, None, "a"), (1, "u", "<article>x", "b"), (1, "u", "<article>x", "b")], schema)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><h1 class="page-header">Title here</h1><p>Body text.</p></article>', "Title here\nBody text."),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Body.</p></article>', "Title\nBody."),
        ('<article><p>Body.</p><section id="related-work"><h2>Related</h2><p>Older.</p></section></article>', "Body.\nRelated\nOlder."),
        ('<article><p>Body.</p><div class="related">Teaser</div><div class="ad-slot">Buy</div><div class="share-buttons">Share</div></article>', "Body."),
        ("<h1>Head</h1><p>One short line.</p>", "Head\nOne short line."),
        ("<nav>Menu</nav><p>Short.</p><footer>Foot</footer>", "Short."),
        ('<article><p>Body.</p></article><div class="comments"><article class="comment"><p>First!</p></article></div>', "Body."),
        ('<article><p>Body.</p><article class="comment"><p>First!</p></article></article>', "Body."),
        ('<p title="a > b">x</p>', "x"),
        ('<article><p>One.</p><a href="x>Two</article>', "One.\nTwo"),
        ("<article><p>a < b and <3</p></article>", "a < b and <3"),
    ],
)
def test_kept_and_dropped(page, want):
    assert main_text(page) == want


def test_unmarked_pages():
    """Pages without an article: the list and the short lines between two paragraphs stay, what is around them goes."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join("word%d" % rng.randrange(1000) for _ in range(n))
    for _ in range(50):
        body = [words(20)] + [words(rng.choice((1, 2, 30))) for _ in range(rng.randrange(12))] + [words(20)]
        blocks = "".join(f"<li>{b}</li>" if len(b) < 20 else f"<p>{b}</p>" for b in body)
        page = f"<html><body><div><a href=/>Home</a></div><div><a href=/x>News</a></div><div><a href=/y>More</a></div><div>{blocks}</div><div id=footer>Imprint {words(40)}</div></body></html>"
        assert main_text(page) == "\n".join(body)


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a ", "<!--", "<!", "<", "</script ", "<script>", '<a x="1" ', "<p>", "<div>", "<b>", "</b>", "<p></div>", "&", "&#", '"><p '])
def test_linear_time(piece):
    import time

    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20
    if piece == '<a "':
        assert time.process_time() - began < 3
