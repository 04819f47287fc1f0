import re
import time
from html import unescape
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from plankit.llm import html_main


@pytest.fixture(scope="module")
def model():
    return html_main.train(html_main.labelled_pages())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>A  title &amp; more</h1><p><b>First&nbsp;&lt;line.<br><p>Second\n line</p><p>Third &eacute; &am</p></article>
<div class="comments"><p>nice post</p></div><form><input name=q></form><footer>&copy; x &middot; y</footer>"""


def test_article_without_the_rest(model):
    assert html_main.main_text(PAGE, model) == "A title & more\nFirst <line.\nSecond line\nThird é &am"


def test_plain_markup(model):
    page = '<div id=page><div class="menu"><ul><li><a href=x>m</a></ul></div><div class="content"><p>Hello</p> loose <b>bold</b>text<ul><li>one<li>two</ul></div><div class="sidebar"><p>side</p></div></div>'
    assert html_main.main_text(page, model) == "Hello\nloose boldtext\none\ntwo"


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "</b></p>", "<script>x", "<a title=\"x>", "&amp;", "<b><p></b></p>" * 50, "<div>" * 3000 + "x", "<b>" * 20_000 + "</i>" * 20_000, "\x00﻿"])
def test_broken_pages_do_not_fail(model, page):
    assert isinstance(html_main.main_text(page, model), str)


def test_marginals_are_those_of_all_labellings(model):
    """Sum-product against summing over every labelling of a small page."""
    from itertools import product

    blocks, _ = html_main.parse("<article><h1>a</h1><div class=ad>b</div><ul><li>c<li>d</ul></article><footer><p>e</p></footer>")
    html_main._features(blocks)
    edge = [model.potentials(b) for b in blocks]
    total, ones = 0.0, [0.0] * len(blocks)
    for labels in product((0, 1), repeat=len(blocks)):
        p = 1.0
        for i, b in enumerate(blocks):
            p *= edge[i][2 * (labels[b.parent] if i else 1) + labels[i]]
        total += p
        for i, x in enumerate(labels):
            ones[i] += p * x
    assert model.marginals(blocks) == pytest.approx([x / total for x in ones], rel=1e-6)


def test_held_out_pages(model):
    wrong = runs = 0
    for page in html_main.labelled_pages(150, seed=99):
        blocks, texts = html_main.parse(page)
        html_main._features(blocks)
        belief = model.marginals(blocks)
        for b in blocks:
            b.label = b.label if b.label is not None else 1 if b.parent < 0 else blocks[b.parent].label
        for block, pieces in texts:
            runs += 1
            wrong += (belief[block] > 0.5) != blocks[block].label
    assert wrong / runs < 0.05


def test_every_row_of_pages(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<article><p>" + "word " * 50_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, n_chars int")
    found = html_main.extract(pages, model).collect()
    assert [(r.page_id, r.url) for r in found] == [r[:2] for r in rows]
    assert [r.n_chars for r in found] == [len(r.text) for r in found] and found[1].text == found[2].text == "" and found[4].n_chars == 249_999
    assert html_main.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize(
    "inside, kept",
    [
        ("<svg width='1'/>", ""), ("<math/>", ""), ("<canvas>", ""), ("<template><p>no<template>no</template>no</p></template>", ""),
        ("<svg><title>no</title><svg><text>no</text></svg><text>no</text></svg>", ""), ("<object data=x>no<object>no</object>no</object>", ""),
        ("<select><option>no</select>", ""), ("<svg><path d='M0'/><!-- </svg> --><text>no</text></svg>", ""), ("<script>'<svg>'</script><svg>", ""),
        ("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> holds</p>", "so x=2 holds\n"), ("<xmp>a <b> &amp; c</xmp>", "a <b> &amp; c\n"), ("<p data-label='Price'>costs</p>", "costs\n"), ("<p data-label=0>zero</p>", "zero\n"),
    ],
)
@pytest.mark.parametrize("later", ["", "<footer><svg></svg><math></math></footer>"])
def test_articles_go_on_after_elements_that_are_apart(model, inside, kept, later):
    page = f"<body><article><h1>Head</h1>{inside}<p>The text that follows goes on.</p></article>{later}</body>"
    assert html_main.main_text(page, model) == f"Head\n{kept}The text that follows goes on."


TEXT = "some words of a text that goes on and on, with commas. " * 8
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li><li><a href=z>More</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><nav>{MENU}</nav><div class='css-1a2b'><p>{TEXT}</p></div><footer>&copy; x</footer></body>", TEXT.strip()),
        (f"<body><div class='css-1a2b'>{TEXT}</div></body>", TEXT.strip()),
        (f"<body><div class='css-9z'>{MENU}</div><div class='css-1a2b'><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div><div class='q1'><p>Subscribe</p><form><input></form></div></body>", f"Head\n{TEXT.strip()}\n{TEXT.strip()}"),
        ("<article><h1>T</h1><p>Para text that is long enough to be read.</p><ul><li><a href=1>First source of the text</a></li><li><a href=2>Second one</a></li></ul></article>", "T\nPara text that is long enough to be read.\nFirst source of the text\nSecond one"),
    ],
)
def test_structure_decides_where_names_say_nothing(model, page, text):
    assert html_main.main_text(page, model) == text


@pytest.mark.parametrize("n", [20_000])
@pytest.mark.parametrize("parts", [("<b>", "<div></div>"), ("<div>", "</b>"), ("<p><i>", "<li>"), ("<table><tr><td><b>", ""), ("<svg>", ""), ("<ul><li>", "<li>")])
def test_nested_elements_cost_in_proportion(model, n, parts):
    began = time.perf_counter()
    html_main.main_text(parts[0] * n + parts[1] * n, model)
    assert time.perf_counter() - began < 2


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_pages_equal_their_articles(spark, model):
    """The whole table against its articles, cut out by a pattern."""
    path = "/root/testdata/sf0.01/pages.parquet"
    wanted = {}
    for page, html in zip(*pq.read_table(path, columns=["page_id", "html"]).to_pydict().values()):
        inside = re.search("<article>(.*?)</article>", html, re.S)[1]
        blocks = [re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split("</?(?:h1|p)>", inside)]
        wanted[page] = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
    assert {r.page_id: r.text for r in html_main.extract(spark.read.parquet(path), model).collect()} == wanted
