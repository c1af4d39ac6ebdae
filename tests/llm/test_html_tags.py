"""The tag scanner: quotes, comments, and a time that grows with the page."""

import random
import re
import time

import pytest

from lumenframe.llm import html_text


def texts(page):
    return "".join(raw for kind, raw, _ in html_text.stream(page) if kind == "text")


@pytest.mark.parametrize(("page", "want"), [
    ("<p title=\"5' tall>Hello</p>", "Hello"),
    ("<a href='it's'>x</a>", "x"),
    ("<a title=\"a > b\">x</a>", "x"),
    ("<a title = 'a > b' x=1>y</a>", "y"),
    ("1 < 2 and 3 > 2 <b>c</b>", "1 < 2 and 3 > 2 c"),
    ("a <!-- <b> --> b <!doctype html> c <?x?> d <!-- e", "a  b  c  d "),
    ("a <b", "a <b"),
    ("<<p>x</p>", "<x"),
    ("<p>x</p", "x</p"),
    ("<br/><img src=x/>y", "y"),
    ("a<>b</>c", "a<>b</>c"),
    ("<a b==c>x</a>", "x"),
])
def test_what_is_text(page, want):
    assert texts(page) == want


def test_plain_pages_are_read_as_by_a_pattern():
    rng = random.Random(1)
    token = re.compile(r"<!--.*?-->|</?[a-z][a-z0-9]*(?:\s+[a-z]+=(?:\"[^\"]*\"|'[^']*'))*\s*>", re.S)
    for _ in range(500):
        parts = rng.choices(["<p>", "</p>", "<div class=\"a b\">", "</div>", "text ", "a 'quote' ", "<b id='x>y'>", "</b>", "<!-- <i> -->", "é & \" "], k=30)
        page = "".join(parts)
        assert texts(page) == token.sub("", page)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<" * 1_000_000, "<a x='" * 200_000, "<a =" * 250_000 + ">", "<b>" * 330_000, "<b><i></b>" * 100_000, "<!--" * 250_000, "<p" + " a=b" * 250_000])
def test_long_odd_pages_take_linear_time(page):
    start = time.perf_counter()
    sum(1 for _ in html_text.stream(page))
    assert time.perf_counter() - start < 15


def test_deep_nesting_shares_one_path():
    deep = [e for kind, _, e in html_text.stream("<b>" * 2000 + "x") if kind == "text"][0]
    assert deep.path.count("/") == html_text.DEPTH and deep.depth == 2000
