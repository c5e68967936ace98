"""Words of a class don't take a page's main text away."""

import pytest

from tidemark.llm import html

TEXT = "The river was high that spring, and the people of the town had to carry all of their goods up to the old mill on the hill before it was dark."
NAMES = [
    "elementor-widget-container", "content-sidebar-wrap", "no-sidebar", "entry-content has-share-buttons", "legal", "related", "social", "discussion",
]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["div", "article"])
def test_wrappers_keep_their_text(name, tag):
    page = f'<body><div class="{name}"><{tag}><p>{TEXT}</p><p>{TEXT}</p></{tag}></div><div class="ad">Buy now</div></body>'
    assert html.main_text(page) == f"{TEXT} {TEXT}"


def test_boilerplate_beside_an_article_still_goes():
    page = f'<article><p>{TEXT}</p><div class="ad"><p>{TEXT}</p></div></article><div class="related"><article><p>{TEXT}</p></article></div>'
    assert html.main_text(page) == TEXT
