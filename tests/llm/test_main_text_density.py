"""Main text where article and main elements are missing, several, or not the article."""

import html
import os
import re

import pyarrow.parquet as pq
import pytest

from veilframe.llm import extract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SENTENCE = "The quick brown fox jumps over the lazy dog and runs away from the hunters of the wood."
PARAGRAPHS = f"<p>{SENTENCE}</p>" * 6
BODY = " ".join([SENTENCE] * 6)
TEASERS = "".join(f"<article><h3><a href=/{i}>Teaser number {i}</a></h3><a href=/{i}>Read on</a></article>" for i in range(4))


def test_a_body_beside_teaser_articles():
    page = f"<body><div><div class=text>{PARAGRAPHS}</div><div class=cards>{TEASERS}</div></div></body>"
    assert extract.main_text(page) == BODY


def test_sibling_articles_all_stay():
    page = f"<body><div><article>{PARAGRAPHS}</article><article>{PARAGRAPHS}</article><article>{PARAGRAPHS}</article></div></body>"
    assert extract.main_text(page) == " ".join([BODY] * 3)


@pytest.mark.parametrize("name", ["related", "advert", "post sponsored"])
def test_an_aside_article_does_not_win(name):
    page = f"<body><div><div class=text>{PARAGRAPHS}</div><article class='{name}'>{PARAGRAPHS * 3}</article></div></body>"
    assert extract.main_text(page) == BODY


def test_density_alone_finds_the_given_articles():
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["html"]).to_pydict()["html"]
    equal, shares = 0, []
    for page in pages:
        article = re.sub("<[^>]*>", " ", re.sub("</?b>", "", re.search("<article>(.*?)</article>", page, re.S)[1]))
        text = " ".join(html.unescape(article).split())
        found = extract.main_text(re.sub("<(/?)article>", r"<\1div>", page))
        equal += found == text
        shares.append(len(set(found.split()) & set(text.split())) / len(set(found.split()) | set(text.split())))
    assert equal >= 0.9 * len(pages)
    assert sum(shares) >= 0.97 * len(shares)
