"""Main text of ordinary kinds of pages: nothing of the article is lost, nothing around it stays."""

from __future__ import annotations

import pytest

from lumenpress.llm import html

A = "The first paragraph of the article, which is long enough to be one of it."
B = "The second paragraph, with other words and of much the same length as the first."
ARTICLE = f"<p>{A}</p><p>{B}</p>"
AROUND = '<div class="menu"><a href="/">Home</a></div>{}<div class="footer"><p>All rights reserved</p></div>'


def text(page: str) -> str:
    return html.extract(page, html.best_path(page)[0])


@pytest.mark.parametrize(
    "open_",
    [
        '<div class="elementor-widget-wrap"><div class="elementor-widget-container">',
        '<div class="l-header-2col content"><div>',
        '<div class="post has-comments comments-open"><div>',
        '<div class="alert-level-story"><div>',
        '<div class="widget"><div class="widget-content">',
        '<div class="header"><div>',
        '<form id="aspnetForm" action="./"><div>',
        '<form><div class="search">',
        '<div class="comment"><div>',
        '<div id="sidebar-page"><div>',
    ],
)
def test_boxes_that_hold_the_article(open_):
    close = "</div></form>" if open_.startswith("<form") else "</div></div>"
    assert text(f"<html><body>{AROUND.format(open_ + ARTICLE + close)}</body></html>") in (f"{A}\n{B}", f"{A}\n{B}\nAll rights reserved")


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<section class="discussion"><p>Our results show it.</p></section>', "Our results show it."),
        ('<section id="related-work"><p>Others did this.</p></section>', "Others did this."),
        ('<section class="social-policy"><p>Rules of society.</p></section>', "Rules of society."),
        ('<p class="copyright-law">A law on copies.</p>', "A law on copies."),
        ('<h2 id="discussion">Discussion</h2>', "Discussion"),
        ('<h2 id="search">Search</h2>', "Search"),
        ('<h2 class="comments">What it means</h2>', "What it means"),
        ('<p>A <span class="search-term">quick</span> word.</p>', "A quick word."),
        ('<p>A <span class="tags">named</span> word.</p>', "A named word."),
        ('<div class="related"><a href="/x">Other page</a></div>', None),
        ('<div class="related-posts"><ul><li><a href="/x">Other page</a></li></ul></div>', None),
        ('<div class="share-buttons"><p>Share this</p></div>', None),
        ('<div class="ad"><p>Buy now</p></div>', None),
        ('<div class="notice"><p>We use cookies</p></div>', None),
        ('<div style="color:red; display:none"><p>Not seen</p></div>', None),
        ('<section id="comments"><p>Nice post, said a reader at some length.</p></section>', None),
        ('<div class="comment-list"><p>Nice post, said a reader at some length.</p></div>', None),
    ],
)
@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="story-text">{}</div>'])
def test_parts_of_an_article(part, kept, box):
    page = "<html><body>" + AROUND.format(box.format(f"<p>{A}</p>{part}<p>{B}</p>")) + "</body></html>"
    assert text(page) == "\n".join(x for x in (A, kept, B) if x)


def test_a_thread_of_comments_after_the_article():
    for box in ("<article>{}</article>", '<div class="story-text">{}</div>'):
        page = "<html><body>" + AROUND.format(box.format(ARTICLE) + '<div class="thread"><p>First!</p><p>A reader said so.</p></div>') + "</body></html>"
        assert text(page) == f"{A}\n{B}"


def test_names_count_no_more_where_they_leave_nothing():
    assert text(f'<body><div class="comments">{ARTICLE}</div></body>') == f"{A}\n{B}"
    assert text(f'<body><div class="sidebar"><form>{ARTICLE}</form></div></body>') == f"{A}\n{B}"
    assert text('<body><nav><a href="/">Home</a></nav><footer><p>us</p></footer></body>') == ""


def test_every_page_with_paragraphs_has_text(spark):
    """All pages of one host in odd boxes: none is empty, repeated pages vote, and a long one is read whole."""
    long = "".join(f"<p>Sentence number {k} of a very long page.</p>" for k in range(20_000))
    bodies = [f'<div class="{c}">{ARTICLE}</div>' for c in ("widget", "comments", "ad", "menu", "header", "alert", "x")] + [f"<form>{ARTICLE}</form>", long]
    rows = [(k, "http://h.org/a", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)] + [(100 + k, "http://h.org/a", f'<body><div class="x">{ARTICLE}</div></body>') for k in range(3)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{A}\n{B}" for k in got if k != len(bodies) - 1)
    assert got[len(bodies) - 1].count("\n") == 19_999
