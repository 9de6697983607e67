"""Layouts in which names or sizes mislead."""

import pytest

from sluice.llm import html


def texts(spark, pages):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract(frame).orderBy("page_id").collect()]


LONG = "A long story about one thing that goes on for quite some time and has many words in it."


def test_names_that_speak_for_both(spark):
    """Without an article tag the element with most of the text stays, whatever its class; others of such names go."""
    page = f'<body><ul class="nav-links"><li>Home</li></ul><div class="newsletter-post"><div class="social-media-text"><p>{LONG}</p></div></div><div class="share-box">Share this</div><div class="sidebar">Old news</div></body>'
    assert texts(spark, [("http://a.example/1", page)]) == [LONG]
    # a plain name is never the article's
    assert texts(spark, [("http://a.example/1", f'<body><p>Short.</p><div class="sidebar">{LONG}</div><div class="comments">{LONG}{LONG}</div></body>')]) == ["Short."]


@pytest.mark.parametrize("own", ["Short {}.", LONG + " {} " + LONG])
def test_shared_paragraph_goes_whatever_the_length(spark, own):
    shared = "This paragraph stands on every page of the host and is longer than some of its articles are."
    names = ["one", "two", "three", "four", "five", "six"]
    pages = [(f"http://b.example/{n}", f"<body><article><p>{own.format(n)}</p><p>{shared}</p></article></body>") for n in names]
    assert texts(spark, pages) == [own.format(n) for n in names]


def test_copies_of_one_article_stay(spark):
    pages = [(f"http://c.example/{n}", f"<body><div class='x'>Page {n}</div><article><p>{LONG}</p></article></body>") for n in range(5)]
    assert texts(spark, pages) == [LONG] * 5


def test_two_layouts_on_one_host(spark):
    """A template text of one layout is measured by the pages of that layout."""
    names = "ant bee cat dog elk fox gnu hen".split()
    one = [(f"http://d.example/{n}", f"<body><div class='blog'><h2>Our blog, since 1999</h2><h3>The {n}</h3><p>A {n} came by and we saw it.</p></div></body>") for n in names[:4]]
    two = [(f"http://d.example/{n}", f"<body><section class='shop'><h2>Free delivery to everywhere</h2><h3>{n}</h3><p>Buy a {n} while there is one.</p></section></body>") for n in names[4:]]
    assert texts(spark, one + two) == [f"The {n}\n\nA {n} came by and we saw it." for n in names[:4]] + [f"{n}\n\nBuy a {n} while there is one." for n in names[4:]]
