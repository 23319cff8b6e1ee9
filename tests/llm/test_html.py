"""Main text of pages whose class names mislead, and of deep pages."""

import time

import pytest

from oratorio.llm import html_extract

ARTICLE = "".join(f"<p>{'A sentence of the article, with words enough to count. ' * 3}{i}</p>" for i in range(3))
WRAPPERS = "content-sidebar-wrap has-sidebar layout-with-nav ad-free tag-search share-enabled social-science no-ads page-with-menu".split() + ["post no-comments", "site-main header-fixed", "comment-open entry"]


def page(wrapper: str, own: str = "") -> str:
    around = '<div id="site-footer">foot</div><div class="sidebar-left">side</div><div class="ad">buy</div><div class="comment-list"><p>' + "I disagree. " * 200 + "</p></div>"
    return f'<html><body><nav>menu</nav><div class="{wrapper}"><h1>Title</h1>{ARTICLE}{own}</div><div class="x">tiny</div>{around}</body></html>'


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_their_article(wrapper):
    text = html_extract.extract(page(wrapper))
    assert text.count("A sentence") == 9 and text.startswith("Title")
    assert not any(w in text for w in ("tiny", "side", "foot", "buy", "disagree", "menu"))


def test_suspect_parts_of_an_article_go():
    text = html_extract.extract(page("entry", '<div class="related-links">Read on</div><div class="share-buttons">Send</div><div class="newsletter-signup-box">Join</div>'))
    assert text.count("A sentence") == 9 and not any(w in text for w in ("Read on", "Send", "Join"))


def test_a_page_in_a_form():
    text = html_extract.extract(f'<form id="all"><div class="nav"><a href="/">home</a></div>{ARTICLE}<form class="search">find</form></form>')
    assert text.count("A sentence") == 9 and "home" not in text


def test_four_classes_make_a_path():
    one, two = (html_extract.best_container(html_extract.parse(f'<div class="a b c {x}">{ARTICLE}</div>')).path for x in "de")
    assert one != two


def test_the_host_decides(spark):
    """Nine pages agree on a path; the tenth has a longer block elsewhere and follows them."""
    html = lambda more: f'<body><div class="story">{ARTICLE}</div><div class="blurb"><p>{more}</p></div></body>'
    rows = [(k, f"http://h/{k}", html("short")) for k in range(9)] + [(9, "http://h/9", html("a long text about something else. " * 60))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.count("A sentence") == 9 and "something else" not in t for t in got.values())


@pytest.mark.parametrize("source", ["<div>" * 20000, "<div>" * 20000 + "</x>" * 20000, "<b>" * 20000 + "<p>x<h1>y" * 2000, "<div class=ad>" * 20000 + "text"])
def test_deep_pages_take_linear_time(source):
    began = time.process_time()
    html_extract.extract(source)
    assert time.process_time() - began < 10
