"""HTML extraction: simple pages, broken markup, and the articles of the given pages."""

import re
import time

import pytest

from lexmill.llm import htmltext


@pytest.fixture(scope="module")
def field():
    return htmltext.trained_field()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>One sentence of the story that is here.</p></article>", "One sentence of the story that is here."),
        ("<main><p>One sentence of the story that is here.</p></main>", "One sentence of the story that is here."),
        ("<div class=content><p>First words of it.</p><p>And the second ones.</p></div>", "First words of it.\nAnd the second ones."),
        ("<article><h1>T</h1><p>Tom &<b>copy</b> it</p></article>", "T\nTom &copy it"),
        ("", ""),
        ("<!-- only", ""),
        ("<script>x = '<p>no</p>'", ""),
    ],
)
def test_simple_pages(field, page, want):
    assert htmltext.extract(page, field) == want


@pytest.mark.parametrize("part", ['<a "', "<a b", "<div>", "</div>", "<!--", "<a href='x", "<!x", "<h1><p>x", "&amp", "<", "<li>x"])
def test_time_of_broken_markup(part):
    began = time.time()
    htmltext.leaf_blocks(part * (500_000 // len(part)))
    assert time.time() - began < 10


def test_articles_of_the_pages(spark):
    """The one article of a page, with its elements taken away by plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract_pages(pages).collect()}
    alike = 0
    for row in pages.collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", row["html"], re.S)[1]
        inner = re.sub(r"<(script|style|form|aside|nav|figure)\b.*?</\1>", "", inner, flags=re.S)
        want = " ".join(re.sub(r"<[^>]+>", " ", htmltext.html.unescape(inner)).split())
        alike += want.replace(" ", "") == "".join(got[row["page_id"]].split())
    assert len(got) == pages.count() and alike >= 0.95 * len(got)


def test_rows_given_twice_and_empty_tables(spark):
    rows = [(1, "u", "<p>One of two.</p>", "x"), (1, "u", "<p>One of two.</p>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in htmltext.extract_pages(pages).collect()) == [(0, ""), (1, "One of two."), (1, "One of two.")]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0
