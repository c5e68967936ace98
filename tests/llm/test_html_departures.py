"""Pages on which markup misleads: what a reader calls the article comes out, the rest goes."""

import pytest

from tidemark.llm import html

TEXT = "The river was high that spring, and the people of the town had to carry all of their goods up to the old mill on the hill before it was dark."
MORE = "When the water went down again they were all in the street, and it was a long time before the shops on the market place had opened their doors."
OTHER = "I have been a reader of this paper for many years and I do not think that any of this is as new as you say it is, but it was good to read it."
COMPOUND = [
    "comment-list", "user-comments", "site-footer", "related-posts", "ad-slot", "cookie-bar", "newsletter-box", "main-menu", "sidebar-left",
]


@pytest.mark.parametrize("name", COMPOUND)
def test_compound_names_go_with_and_without_an_article(name):
    box = f'<div class="{name}"><p>{OTHER}</p><p>{OTHER}</p></div>'
    assert html.main_text(f"<body><article><h1>Flood</h1><p>{TEXT}</p>{box}<p>{MORE}</p></article></body>") == f"Flood {TEXT} {MORE}"
    assert html.main_text(f"<body><article><p>{TEXT}</p></article>{box}</body>") == TEXT
    assert html.main_text(f"<body><div><p>{TEXT}</p><p>{MORE}</p></div>{box}</body>") == f"{TEXT} {MORE}"


def test_comments_marked_up_as_articles_go():
    box = f'<ol class="comment-list"><li><article class="comment-body"><p>{OTHER}</p></article></li><li><article><p>{OTHER}</p></article></li></ol>'
    assert html.main_text(f'<div class="no-sidebar"><div><p>{TEXT}</p></div>{box}</div>') == TEXT
    assert html.main_text(f"<article><p>{TEXT}</p></article>{box}") == TEXT


def test_a_teaser_article_does_not_hide_the_text():
    page = f"<body><article><p>Read this too</p></article><div><p>{TEXT}</p><p>{MORE}</p></div></body>"
    assert html.main_text(page).endswith(f"{TEXT} {MORE}")


def test_a_form_around_the_page_and_one_inside_it():
    search = '<form action="/s"><label>Search the site</label><input name="q"><button>Go</button></form>'
    assert html.main_text(f'<body><form id="aspnet"><div><p>{TEXT}</p><p>{MORE}</p></div></form></body>') == f"{TEXT} {MORE}"
    assert html.main_text(f"<body><form id=f><article><p>{TEXT}</p></article></form></body>") == TEXT
    assert html.main_text(f"<body>{search}<p>{TEXT}</p></body>") == TEXT
    assert html.main_text(f"<article><p>{TEXT}</p>{search}</article>") == TEXT


def test_head_and_body_tags_may_be_missing():
    assert html.main_text(f"<head><title>T</title><meta charset=utf-8><p>{TEXT}</p><p>{MORE}</p>") == f"{TEXT} {MORE}"
    assert html.main_text(f"<title>T</title><p>{TEXT}</p>") == TEXT


def test_a_slash_does_not_close_a_script():
    assert html.main_text(f"<p>{TEXT}</p><script src=/a/b/>var code = 1;</script><p>{MORE}</p>") == f"{TEXT} {MORE}"
    assert html.main_text(f"<p>{TEXT}</p><svg/><p>{MORE}</p>") == f"{TEXT} {MORE}"


def test_rows_of_links_in_an_article_go():
    row = '<p><a href="/a">First story of the day</a> <a href="/b">Second story of the day</a> <a href="/c">Third</a></p>'
    assert html.main_text(f'<article><p>{TEXT}</p>{row}<p><a href="/x">A paragraph that is one link</a></p></article>') == f"{TEXT} A paragraph that is one link"


def test_short_paragraphs_before_a_list_of_links():
    links = "<ul>" + '<li><a href="/x">Elsewhere</a></li>' * 4 + "</ul>"
    assert html.main_text(f"<h1>Opening hours</h1><p>Open from nine to five.</p><p>Closed on Sunday.</p>{links}") == (
        "Opening hours Open from nine to five. Closed on Sunday.")


@pytest.mark.parametrize("wrap", ["<main>{}</main>", "<div>{}</div>", '<div class="content-sidebar">{}</div>', '<section id="widget-area">{}</section>'])
def test_pages_without_article(wrap):
    nav = '<nav><a href="/">Home</a></nav><div class="top"><a href="/a">News</a> | <a href="/b">Sport</a></div>'
    page = f"<html><body>{nav}{wrap.format(f'<h2>Flood</h2><p>{TEXT}</p><p>{MORE}</p>')}<footer>{OTHER}</footer></body></html>"
    assert html.main_text(page) == f"Flood {TEXT} {MORE}"
