"""Main text of pages: planted articles in different layouts, odd markup, edge cases."""

import html
import random
import re

import pytest

from wavekin.llm import page_templates as templates
from wavekin.llm.markup import Page

WORDS = "river stone candle market winter paper garden letter window bridge copper harvest lantern meadow orchard saddle timber valley whistle anchor".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def with_article(rng, title, paragraphs, i):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>{title} | Site</title><style>p {{ color: red }}</style><script>if (a < b) document.write("</p><article>no</article>");</script></head><body class="has-sidebar">'
        f'<header class="site"><div class="logo">The Site</div></header><nav><ul><li><a href="/a?x=1&y=2">Home</a></li><li><a href="/b">{rng.choice(WORDS)}</a></li></ul></nav>'
        f'<div id="cookie-notice">We use cookies &amp; more. <button>Accept</button></div><main><article id="post-{i}"><header><h1>{title}</h1></header>{body}<div class="share-buttons">Share this</div></article>'
        f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{prose(rng, 80)}</p></article></section></main><aside class="sidebar">{prose(rng, 40)}</aside>'
        f'<form action="/s"><label>Name</label><input name=q></form><div class="ad">{prose(rng, 12)}</div><footer>&copy; 2020 {prose(rng, 9)}</footer></body></html>'
    )


def with_divs(rng, title, paragraphs, i):
    """No element says what it is: the template alone tells the article."""
    body = "".join(f'<p class="x{i}">{html.escape(p)}' for p in paragraphs)
    menu = "".join(f'<div class="m0"><a href="/{w}">{w}</a></div>' for w in WORDS[:8])
    return (
        f'<html><body><div class="c1"><div class="c2">{menu}</div><div class="c3"><h1>{title}</h1>{body}<div class="c9">Thank you for reading this page on our site</div></div>'
        f'<div class="c4"><p>{prose(rng, 15)}</p></div></div><div class="c5">All rights reserved by nobody at all</div></body></html>'
    )


def with_table(rng, title, paragraphs, i):
    body = "<br><br>".join(html.escape(p) for p in paragraphs)
    return f'<table width=100%><tr><td class=l><a href=/>start</a><td class=r><h2>{title}</h2>{body}<tr><td colspan=2 class=foot><a href=/x>imprint</a> <a href=/y>contact us here</a></table>'


@pytest.mark.parametrize("layout", [with_article, with_divs, with_table])
def test_articles_of_a_layout_are_found_whole(spark, layout):
    rng, rows, want = random.Random(4), [], {}
    for i in range(24):
        title = prose(rng, 6)[:-1]
        paragraphs = [prose(rng, rng.randint(20, 70)) + " Fish & chips < 5" for _ in range(rng.randint(2, 9))]
        rows.append((i, f"https://Site.example.org/p/{i}", layout(rng, title, paragraphs, i), "clash", 1.0))
        want[i] = " ".join([title, *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text double").repartition(3)
    got = templates.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["by_template"] and r["n_chars"] == len(want[r["page_id"]]) for r in got)


def test_texts_of_a_template_stay_where_the_article_has_them(spark):
    """A line that most articles share is theirs; a constant text in a place of its own is the template's."""
    rng = random.Random(5)
    line = "Published under a free licence by its authors."
    rows, want = [], {}
    for i in range(20):
        paragraphs = [prose(rng, 30) for _ in range(rng.randint(1, 5))] + ([line] if i % 4 else [])
        rows.append((i, "http://a.example/x", with_divs(rng, "Same title", paragraphs, i)))
        want[i] = " ".join(["Same title", *paragraphs])
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_copies_of_one_page_are_no_template(spark):
    rng = random.Random(6)
    page = with_article(rng, "A title", [prose(rng, 30), prose(rng, 25)], 1)
    rows = [(i, "http://copy.example/", page) for i in range(30)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r["text"] for r in got}) == 1 and got[0]["text"].startswith("A title ") and not any(r["by_template"] for r in got)


def test_edge_cases(spark):
    long = "<article>" + "".join(f"<p>word{i} <b>bold{i}</b></p>" for i in range(30_000)) + "</article>"
    rows = [
        (1, None, None), (1, None, None), (2, "http://b.example/", ""), (3, "no host", "   \n\t "), (None, "http://b.example/", "plain text, no tags &amp; all"),
        (4, "http://b.example/", long), (5, "http://b.example/", "<"), (6, "http://b.example/", "<p"), (7, "http://b.example/", "a < b <c d='"),
        (8, "http://b.example/", "<!-- never closed <p>x</p>"), (9, "http://b.example/", "<script>var x = '<p>';"), (10, "http://b.example/", "<div>" * 5000 + "deep" + "</div>" * 10),
        (11, "http://b.example/", "</p></div>" * 2000 + "text" + "<a href='>" * 300), (12, "http://b.example/", "<p title='it''s'>one<p title=\"a>b\">two</p>"),
    ]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, n_chars string, article int")
    got = templates.extract(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[5] == "<" and text[1] == text[2] == text[3] == text[6] == text[8] == text[9] == ""
    assert text[None] == "plain text, no tags & all" and text[7] == "a < b" and text[10] == "deep" and text[11] == "text" and text[12] == "one two"
    assert text[4] == " ".join(f"word{i} bold{i}" for i in range(30_000))
    assert templates.extract(df.limit(0)).count() == 0


def test_all_pages_equal_their_article_elements(spark, small):
    pages = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in templates.op11_html_templates(spark, small.replace("sf0.001", "sf0.01")).collect()}
    for page, source in pages:
        inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
        assert got[page] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))).split())


def test_markup_of_blocks_links_and_references():
    page = Page("<body><ul><li>a<li>b <a href=x>link <b>bold</a></ul><p>c<i>d</i>e&nbsp;&#233;&am f<h2>t</h3>u</body>")
    assert page.text_of({0}) == "a b link bold cde é&am f t u"
    assert [page.tag[b] for b in page.own_texts()] == ["li", "li", "p", "h2", "body"]


def test_salted_join_gives_the_same_rows(spark, small, monkeypatch):
    pages = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/pages.parquet")
    want = sorted(map(tuple, templates.extract(pages).collect()))
    monkeypatch.setattr(templates, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, templates.extract(pages).collect())) == want
