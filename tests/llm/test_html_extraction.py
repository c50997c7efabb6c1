import html
import itertools
import math
import re

import numpy as np
import pytest
from plantflow.llm.html_blocks import blocks
from plantflow.llm.html_extraction import Field, _chain, _layout_page, extract, extract_page, fit, train_extractor
from plantflow.llm.page_layouts import labelled_pages

SCHEMA = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return train_extractor()


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_markup():
    assert texts("<p>a<b>b</b> c<br>d<p>e &amp;amp; &eacute;&nbsp;f") == ["ab c d", "e &amp; é f"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("a<!-- x > y -->b<script>'</p>' c</script><style>p{}</style>d<textarea>e</textarea>") == ["abd"]
    assert texts('<p title="a>b">c</p><p title=\'>\'>d') == ["c", "d"]
    assert texts("<title>a & b</title><h1>  a\n b </h1>1 < 2 <- 3") == ["a & b", "a b", "1 < 2 <- 3"]
    assert texts("") == texts("<div><p></p></div>") == texts("<!-- never closed <p>a") == []
    assert texts("<p>a<script>never closed </p>b") == ["a"]


def test_open_elements():
    got = {b.text: set(b.open_features) for b in blocks("<article><p>a<nav><li>b</nav></p>c</article>d<p>e", lambda t, _: (t,))}
    assert got == {"a": {"article", "p"}, "b": {"article", "nav", "li"}, "c": {"article"}, "d": set(), "e": {"p"}}


def test_long_and_deep_pages_take_linear_time(model):
    many = "<article>" + "<p>word one, word two.</p>" * 60_000 + "</article>"
    assert extract_page(many, model).count("\n") == 59_999
    for odd in ("<div>" * 100_000 + "x", "<a " * 100_000, '<p a="' * 100_000, "<!--" * 100_000, "</p>" * 100_000 + "x", "<b>x" * 50_000):
        extract_page(odd, model)


def test_chain_against_all_labellings():
    rng = np.random.default_rng(0)
    model = Field(pairs=rng.standard_normal((2, 2)), starts=rng.standard_normal(2))
    scores = rng.standard_normal((1, 6, 2))

    def value(y):
        return model.starts[y[0]] + sum(scores[0, k, c] for k, c in enumerate(y)) + sum(model.pairs[a, b] for a, b in itertools.pairwise(y))

    all_ = {y: value(y) for y in itertools.product((0, 1), repeat=6)}
    total, chance, pair = _chain(scores, np.ones((1, 6), bool), model)
    norm = math.log(sum(math.exp(v) for v in all_.values()))
    assert total[0] == pytest.approx(norm)
    assert chance[0, 2, 1] == pytest.approx(sum(math.exp(v - norm) for y, v in all_.items() if y[2]))
    assert pair[0, 1] == pytest.approx(sum(math.exp(v - norm) * sum(p == (0, 1) for p in itertools.pairwise(y)) for y, v in all_.items()))
    assert tuple(model.labels(scores[0])) == max(all_, key=all_.get)


def test_fit_learns_from_neighbours():
    """The middle block looks alike in both pages; only its neighbours tell."""
    pages = [([("x",), ("m",), ("x",)], [1, 1, 1]), ([("y",), ("m",), ("y",)], [0, 0, 0])] * 5
    got = fit(pages)
    for (name, _), want in (((("x",), 0), 1), ((("y",), 0), 0)):
        scores = np.array([got.weights[got.rows[f]] for f in (*name, "m", *name)])
        assert got.labels(scores) == [want] * 3


def test_held_out_layouts(model):
    right = total = 0
    for parts in labelled_pages(300, seed=99):
        features, gold = _layout_page(parts)
        scores = np.array([model.weights[[model.rows[f] for f in fs if f in model.rows]].sum(axis=0) for fs in features])
        said = model.labels(scores) if gold else []
        right += sum(a == b for a, b in zip(said, gold, strict=True))
        total += len(gold)
    assert right / total > 0.97


def test_whole_table_against_a_rule_for_its_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_pages_of_other_sites(model):
    page = """<html><head><title>Site</title></head><body><div class="cookie-notice"><p>We use cookies. Accept them?</p></div>
    <header><a href="/">Home</a></header><div class="breadcrumb"><a href="/a">News</a></div>
    <div class="post"><h1>A title of a story</h1><p>First paragraph, with some words in it. And another sentence.</p>
    <div class="advertisement"><p>Buy things now</p></div><p>Second paragraph, longer than the first, with commas, and a stop.</p></div>
    <form class="search"><label>Search</label></form><aside><p>Other stories that we wrote.</p></aside>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I like this, it is a fine story. Thanks.</p></div></section>
    <footer><p>&copy; 2020 Site</p></footer></body></html>"""
    assert extract_page(page, model).split("\n") == ["A title of a story", "First paragraph, with some words in it. And another sentence.", "Second paragraph, longer than the first, with commas, and a stop."]


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "a"), (2, None, "", "a"), (None, "u", "<article><p>One two.</p></article>", "a"), (3, "u", "<article><p>x😀 y.</p></article>", "b"), (3, "u", "<article><p>x😀 y.</p></article>", "b"), (4, "u", "<nav>menu</nav>", None)]
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, SCHEMA), model).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "One two.", 8), (3, "u", "x😀 y.", 5), (3, "u", "x😀 y.", 5), (4, "u", "", 0)], key=str)
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
