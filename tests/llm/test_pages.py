import html as entities
import re

import pytest
from pyspark.sql import functions as F

from carequeue.llm import pages
from tests.conftest import SMALL

SCHEMA = "page_id bigint, url string, html string"


def plain(html):
    """The article of the given pages, whose markup is of one kind."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_given_pages(spark):
    given = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = pages.op6_pages(spark, SMALL).collect()
    assert len(found) == len(given)
    for r in found:
        assert r.text == plain(given[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == given[r.page_id].url


def page(i, body):
    return (
        f"<html><body><div class='top-bar header'>Site name</div><div id=box><div class=x>Welcome back, reader</div>"
        f"<div class=story>{body}</div></div><div class='sidebar'>Links {i}</div><p>Terms and conditions apply</p></body></html>"
    )


def test_template_and_slots_of_a_host_without_articles(spark):
    bodies = [f"<p>First words of story {i} &amp;c.</p><p>More\n about   number {i} <i>x</i>y</p>" for i in range(12)]
    rows = [(i, f"http://a.example/{i}", page(i, body)) for i, body in enumerate(bodies)]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"First words of story {i} &c.\n\nMore about number {i} xy" for i in range(12)}


def test_heading_beside_the_text_stays(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<div class=x><h1>Title {i}</h1><div class=y><p>First of {i}, long enough.</p><p>Second {i}</p></div></div>")
        for i in range(8)
    ]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"Title {i}\n\nFirst of {i}, long enough.\n\nSecond {i}" for i in range(8)}


def test_copies_of_one_page_are_no_template(spark):
    rows = [(i, "http://copy.example/", f"<body><nav>n {i}</nav><article><h1>Same</h1><p>The same text.</p></article></body>") for i in range(40)]
    found = pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in found} == {"Same\n\nThe same text."}


def test_boilerplate_longer_than_any_paragraph_is_template(spark):
    legal = "All posts are the property of their authors and may not be copied without leave. " * 3
    rows = [(i, f"http://l.example/{i}", f"<body><div class=x><p>Post {i} is short.</p><p>Ends {i}.</p></div><div class=y>{legal}</div></body>") for i in range(8)]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"Post {i} is short.\n\nEnds {i}." for i in range(8)}


def test_all_varying_text_stays(spark):
    words = "with more words than there are in what stands beside it"
    split = "<body><div class=x><div class=lead>Lead {0}</div><div class=y><p>Body {0} {1}</p><p>Body {0} again {1}</p></div><div class=z>End {0}</div></div><p>All rights reserved</p></body>"
    lists = "<body><div class=x><ul><li><a href=a>One {0}</a></li></ul></div><div class=y><p><a href=b>Two {0}</a></p></div></body>"
    deep = "<body><div class=x><p>Short {0}</p></div>" + "<div>" * 80 + "<p>Deep {0}</p>" + "</div>" * 80 + "</body>"
    rows = [(100 * k + i, f"http://{k}.example/{i}", html.format(i, words)) for k, html in enumerate((split, lists, deep)) for i in range(8)]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(8):
        assert found[i] == f"Lead {i}\n\nBody {i} {words}\n\nBody {i} again {words}\n\nEnd {i}"
        assert found[100 + i] == f"One {i}\n\nTwo {i}"
        assert found[200 + i] == f"Short {i}\n\nDeep {i}"


def test_story_beside_teasers_that_are_articles_stays(spark):
    story = "<h1>Title {0}</h1><p>The story of {0} is told in a div, at some length.</p><p>It ends after {0} more words.</p>"
    body = f"<body><div class=story>{story}</div><div class=x><article><p>Teaser {{0}}</p></article><article><p>Another {{0}}</p></article></div></body>"
    rows = [(i, f"http://t.example/{i}", body.format(i)) for i in range(8)] + [(100, "http://few.example/", body.format(100))]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in (*range(8), 100):
        assert found[i].startswith(f"Title {i}\n\nThe story of {i} is told in a div, at some length.\n\nIt ends after {i} more words.")


def test_article_of_most_varying_text_is_the_content(spark):
    body = "<body><div class=x>Posted on day {0}</div><article><p>{1} {0}.</p><p>Second {0}.</p></article></body>"
    rows = [(i, f"http://m.example/{i}", body.format(i, "Words of the article " * 9)) for i in range(8)]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"{'Words of the article ' * 9} {i}.\n\nSecond {i}.".replace("  ", " ") for i in range(8)}


def test_near_copies_keep_their_text(spark):
    rows = [(i, "http://n.example/", f"<body><div><p>{'One long story. ' * 60}</p><p>Its end.</p></div><div>Copy {i}</div></body>") for i in range(8)]
    found = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"{('One long story. ' * 60).strip()}\n\nIts end.\n\nCopy {i}" for i in range(8)}


def test_what_is_no_article():
    html = """<!DOCTYPE html><title>t</title><header><h1>Site</h1></header><nav><ul><li><a href=x>m</a></ul></nav>
    <div role="banner">b</div><div class="cookie-notice">c</div><article><header><h1>Head</h1></header><p>One<br>two<p>Three
    <div class="ad">ad</div><ul><li>a<li>b</ul><form><p>f</form><script>var t="</article>"</script><!-- <p>x</p> -->
    <aside>s</aside><blockquote>q &eacute;&#233;&nbsp;z</blockquote></article><section id="comments"><article><p>c</article></section>
    <footer>f</footer>"""
    assert pages.main_text(html) == "Head\n\nOne two\n\nThree\n\na\n\nb\n\nq éé z"


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='layout with-sidebar'>", "</div>"),
        ("<div class='no-ads'>", "</div>"),
        ("<div id='search-article'>", "</div>"),
        ("<article class='post share-enabled'>", "</article>"),
        ("<article class='share'>", "</article>"),
        ("<div class='discussion'><main>", "</main></div>"),
        ("<div class='widget'>", "</div>"),
        ("<form action=x>", "</form>"),
    ],
)
def test_wrappers_with_names_of_asides_stay(start, end):
    html = f"<body><nav>Menu</nav><div class='ad-block'>Buy</div>{start}<p>The story's first words.</p><div class='ad'>Ad</div><p>More of it.</p>{end}<div id=comments-2>A remark longer than the story itself, by one who has read it.</div></body>"
    assert pages.main_text(html) == "The story's first words.\n\nMore of it."


def test_odd_rows(spark):
    rows = [
        (1, None, None),
        (2, "not a url", ""),
        (3, "http://b.example", "<p>only"),
        (None, "http://b.example", "plain text"),
        (None, "http://b.example", "plain text"),
        (4, "http://b.example", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (5, "http://b.example", "<p>" + "word " * 200_000),
        (6, "http://b.example", "<nav>menu</nav>"),
        (7, "http://b.example", "<<>><p <b>&#0;&bogus;</p>"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("h")).withColumn("wrapper", F.lit("w")).withColumn("salt", F.lit(0))
    found = pages.extract_text(frame).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    assert (by[1], by[2], by[3], by[None], by[4], by[6]) == ("", "", "only", "plain text", "deep", "")
    assert by[5] == ("word " * 200_000).strip()
    assert pages.extract_text(frame.limit(0)).collect() == []
