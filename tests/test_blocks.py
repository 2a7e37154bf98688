"""Selected elements of pages, their nesting, and the time a long page takes."""

import time

import pytest

from mentionflow.sources import blocks as B


def texts(html, *selectors):
    return [(t, " ".join(x.split())) for _, t, x in B.page_elements(html, [B.parse_selector(s) for s in selectors])]


@pytest.mark.parametrize("html,selector,expected", [
    ("<div class='a status-item b'>one <b>two</b></div> three", ".status-item", [("div", "one two")]),
    ("<p class=status-items>no</p><p class='x status-item'>yes</p>", ".status-item", [("p", "yes")]),
    ("<div class=\"TimelineItem_item_9x\">t</div><span class='TimelineItem_item_'>no</span>", "div[class*='TimelineItem_item_']", [("div", "t")]),
    ("<article>a<article>b</article>c</article>d", "article", [("article", "a b c"), ("article", "b")]),
    # unclosed p: ended by the next block, and by the block around it
    ("<div><p>one<p>two<div>three</div></div>four", "p", [("p", "one"), ("p", "two")]),
    ("<article><p>in</article>out<p>last", "p", [("p", "in"), ("p", "last")]),
    # a div left open inside an article ends with it, and the outer one keeps its own closing tag
    ("<div class=o>1<article>2<div class=i>3</article>4</div>5", "div.i", [("div", "3")]),
    ("<div class=o>1<article>2<div class=i>3</article>4</div>5", "div.o", [("div", "1 2 3 4")]),
    # crossed tags: an inline tag is ended alone, a block ends what is in it
    ("<div>1<b>2</div>3</b>4", "b", [("b", "2")]),
    ("<b>1<p>2</b>3</p>4", "p", [("p", "23")]),
    ("<b>1<p>2</b>3</p>4", "b", [("b", "1 2")]),
    ("<span>1<div>2</span>3</div>4</span>5", "span", [("span", "1 23 4")]),
    # void tags open nothing, unknown closing tags end nothing
    ("<div>1<br>2<img src=x>3</foo></p></div>4", "div", [("div", "1 23")]),
    ("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", "li", [("li", "1 2 3"), ("li", "2"), ("li", "3"), ("li", "4")]),
    ("<table><tr><td>1<td>2<tr><td>3</table>4", "td", [("td", "1"), ("td", "2"), ("td", "3")]),
    ("<dl><dt>1<dd>2<dt>3</dl>", "dd", [("dd", "2")]),
    ("<article>1<script>var t = '</article>';</script>2<!-- </article> -->3<style>x</style></article>4", "article", [("article", "123")]),
    ("<article>1<!-- never closed </article>", "article", [("article", "1")]),
    ("<ARTICLE CLASS='X'>1</Article>2", "article", [("article", "1")]),
    ("1 < 2 <article>3 > 2 <", "article", [("article", "3 > 2 <")]),
    ("", "article", []),
])
def test_elements(html, selector, expected):
    assert texts(html, selector) == expected


def test_selectors():
    assert [B.parse_selector(s) for s in B.POST_SELECTORS][:4] == [
        ("div", None, "AnonymousHome"), ("div", None, "timeline-live"), ("div", None, "TimelineItem_item_"), (None, "timeline__item", None)]
    for bad in ("", "div > p", "#id", "p:first-child"):
        with pytest.raises(ValueError):
            B.parse_selector(bad)


@pytest.mark.parametrize("unit", ["<p>x", "<div>x", "<li>x", "<b>x", "<span>x</div>", "<div><b>x", "x</b></p>", "<b><div></b>", "<ul><li>x", "<!-- x"])
def test_long_pages_take_linear_time(unit):
    """10^5 tags, open and nested in every way: ten times the tags take some ten times the time."""
    def seconds(n):
        t = time.process_time()
        B.page_elements("<article>" + unit * n, [("article", None, None), ("h1", None, None)])
        return time.process_time() - t
    seconds(1000)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 5 and large < 40 * max(small, 0.01)


def test_selected_posts(spark):
    pages = spark.createDataFrame([
        (1, "http://h/en/1", "<div class='feed-item'>first post <b>here</b></div><div class=other>no post</div>"),
        (2, "http://h/en/2", "<article>first post here</article><article>tiny</article><div class='x item__y'>another one</div>"),
        (3, None, None), (4, "http://h/de/4", "")], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.pos, r.tab, r.text) for r in B.selected_posts(pages).collect())
    assert got == [(1, 0, "en", "first post here"), (2, 4, "en", "another one")]
    assert B.selected_blocks(pages.limit(0)).collect() == []
