"""Extraction from pages whose main text is known, and trees and decoding by themselves."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from groundsieve.llm import html_extraction as extraction
from groundsieve.llm.boosting import fit_trees
from groundsieve.llm.dom import FEATURES, Page, features, read_page, text_of
from llm_tools import sentence

PAGES = "page_id long, url string, html string, text string, n_chars string, model string"


def page(rng, named=True):
    blocks = [sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 9))]
    title, menu = sentence(rng, 5), "".join(f"<li><a href=x>{sentence(rng, 1)}</a>" for _ in range(6))
    tag, around = ("article", "nav") if named else ('div class="post-body"', 'div id="topNav"')
    body = "".join(f"<p>{b}" + rng.choice(["", "</p>"]) for b in blocks)
    return (f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>'</script></head><body><{around}><ul>{menu}</ul>"
            f"</{around.split()[0]}><!-- c --><{tag}><h1>{title}</h1>{body}</{tag.split()[0]}>"
            f"<footer>&copy; {sentence(rng, 4)}</footer></body>"), "\n".join([title, *blocks])


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(2)
    rows, labels = extraction.training_rows(page(rng)[0] for _ in range(400))
    return fit_trees(rows, labels)


@pytest.mark.parametrize("named", [True, False])
def test_main_text(trees, named):
    rng = random.Random(77)
    pages = [page(rng, named) for _ in range(60)]
    got = extraction.extract_texts([p for p, _ in pages], trees)
    right = sum(a == b for a, (_, b) in zip(got, pages))
    assert right == 60 if named else right >= 50


def test_surroundings_within_the_article(trees):
    rng = random.Random(5)
    a, b, c, d = (sentence(rng, 25) for _ in range(4))
    source = (f"<body><article><h1>T</h1><p>{a}</p><aside><p>{b}</p></aside><div class='advert'>{sentence(rng, 9)}</div><p>{c}</p>"
              f"<form><label>x</label><textarea>y</textarea></form><section id=comments><p>{d}</p></section></article></body>")
    assert extraction.extract_texts([source], trees) == [f"T\n{a}\n{c}"]


ROWS = ["A whole sentence that says what is to be done with it.", "Salt", "Two eggs and a cup of flour", "And so on: the end."]
PARTS = {
    "ul": "<ul>" + "".join(f"<li>{r}</li>" for r in ROWS) + "</ul>", "ol": "<ol>" + "".join(f"<li>{r}" for r in ROWS) + "</ol>",
    "table": "<table><tr><th>Name</th><th>Value</th></tr>" + "".join(f"<tr><td>{r}</td><td>{n}</td></tr>" for n, r in enumerate(ROWS)) + "</table>",
    "pre": "<pre>for row in rows:\n    print(row)</pre>", "dl": f"<dl><dt>{ROWS[1]}</dt><dd>{ROWS[0]}</dd><dt>Term</dt><dd>{ROWS[3]}</dd></dl>",
    "figure": "<figure><img src=x><figcaption>The hill behind the house.</figcaption></figure>",
    "blockquote": f"<blockquote><p>{ROWS[0]}</p></blockquote>", "h2": "<h2>Second part</h2>", "div": f"<div>{ROWS[0]}</div>"}


@pytest.mark.parametrize("part", sorted(PARTS))
@pytest.mark.parametrize("named", [True, False])
def test_markup_of_the_main_text_that_was_not_learnt_from(trees, part, named):
    """The pages that the trees learn from hold headings and paragraphs only."""
    rng = random.Random(11)
    right = 0
    for _ in range(12):
        source, text = page(rng, named)
        end = "</article>" if named else "</div><footer>"
        source = source.replace(end, PARTS[part] + end)
        got = extraction.extract_texts([source], trees)[0].split("\n")
        own = text_of(p := read_page(PARTS[part]), np.ones(len(p.tags), bool)).split("\n")
        right += got == text.split("\n") + own
    assert right == 12 if named else right >= 9


def test_pages_of_plain_blocks(trees):
    rng = random.Random(12)
    prose = [sentence(rng, 80), sentence(rng, 60), sentence(rng, 90)]
    links = "".join(f"<a href=x>{sentence(rng, 1)}</a> " for _ in range(5))
    one, many = (f"<body><div>{links}</div><div>{inner}</div><div><a href=z>Imprint</a></div></body>" for inner in (
        " ".join(prose), "".join(f"<div>{p}</div>" for p in prose)))
    # Nothing there names the main text: the prose is kept whole, whatever becomes of the links.
    for got, want in zip(extraction.extract_texts([one, many], trees), ([" ".join(prose)], prose)):
        assert [line for line in got.split("\n") if line in want] == want and "Imprint" not in got


def test_reading():
    everything = lambda s: text_of(p := read_page(s), np.ones(len(p.tags), bool))
    assert everything("<p>a &amp; b&nbsp;c<br>d\n e<p>f<b>g<p>h</b>i") == "a & b c d e\nfg\nhi"
    assert everything("<div>x<script>if (a<b) '</div>'</script>y<style>p</style><!-- <p>z --> w</div>") == "xy w"
    assert everything("1 < 2 <3 <p class='a>b'>t</p") == "1 < 2 <3\nt"
    assert everything("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == "a\nb\nc\nd\ne\nf\ng"
    assert everything("&amp;lt; &#233;&#x20AC;") == "&lt; é€"
    assert everything("") == everything("<html>") == everything("<head><title>t</title>") == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div class='ad'> </div> <b> </b> <li> </ul> <ul> text &amp; <!-- --> <script> </script> <td> <table> "
                                "</table> < > <a> </a> <br> </x> <p".split()), max_size=40).map(" ".join))
def test_any_markup_is_read(source):
    p = read_page(source)
    assert features(p).shape == (len(p.tags), len(FEATURES)) and np.isfinite(features(p)).all()
    assert all(-1 <= q < k for k, q in enumerate(p.parents))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.floats(-3, 3)), min_size=1, max_size=7))
def test_decoding_is_the_best_choice_without_contradictions(nodes):
    p = Page()
    for k, (up, _) in enumerate(nodes):
        p.tags.append("div")
        p.parents.append(up % (k + 1))
    margins = np.array([0.0] + [m for _, m in nodes])
    kept = extraction.decode(p, margins)

    def value(choice):
        return sum(m for m, c in zip(margins[1:], choice) if c)

    allowed = [c for c in itertools.product([False, True], repeat=len(nodes))
               if all(not k or p.parents[n + 1] == 0 or c[p.parents[n + 1] - 1] for n, k in enumerate(c))]
    assert tuple(kept[1:].tolist()) in allowed
    assert value(kept[1:]) == pytest.approx(max(map(value, allowed)))


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 4)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 2] > 0.5)).astype(int)
    fitted = fit_trees(rows[:1500], labels[:1500])
    assert ((fitted.margins(rows[1500:]) > 0) == labels[1500:]).mean() > 0.95


def test_tables(spark):
    rng = random.Random(3)
    pages = [(k, f"u{k}", *page(rng)) for k in range(200)]
    odd = [(900, None, None, ""), (901, "", "", ""), (None, "x", "no markup", None), (902, "y", pages[0][2], pages[0][3])]
    rows = [(i, u, h, "x", "x", "x") for i, u, h, _ in [*pages, *odd]]
    got = {(r.page_id, r.url): r for r in extraction.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 204 and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i, u].text == t for i, u, _, t in [*pages, *odd] if t is not None)
    assert extraction.main_texts(spark.createDataFrame([], PAGES)).count() == 0
    without = extraction.main_texts(spark.createDataFrame([(1, "u", "<p>a</p><nav>b</nav>", "x", "x", "x")], PAGES))
    assert [r.text for r in without.collect()] == ["a"]


def test_a_head_without_end():
    """</head> and <body> may be left out."""
    said = lambda source: "".join(t for _, _, t, _ in read_page(source).texts).strip()
    assert said("<html><head><title>T</title><p>Text of the page") == "Text of the page"
    assert said("<head><meta charset=utf-8><link href=x><div><p>One</div></html>") == "One"
    assert said("<head><template><p>hidden</p></template><style>a</style></head><body><p>Two") == "Two"
