"""Pages that are broken, deep, long or unmarked, and decoding against brute force."""
import itertools
import time

import numpy as np
import pytest

from privtrace.llm import html_text as op


def text(page):
    return op.render(op.parse(page), set())


@pytest.mark.parametrize("page,want", [
    ("<p title=don't>one</p><p>it's two</p>", "one\nit's two"),
    ('<p class="x"">three</p>', "three"),
    ("super<wbr>cali<img src=x>frag", "supercalifrag"),
    ("one<br>two", "one two"),
    ("&<b>amp;</b> &amp; &lt;b&gt;", "&amp; & <b>"),
    ("a < b <c", "a < b <c"), ("1 <2> 3", "1 <2> 3"), ("", ""), ("<", "<"), ("</", "</"),
    ('<p title="abc>text</p>', "text"),
    ("<p data-x='a>b'>in</p>", "in"),
    ("before<!-- <p>hidden</p> -->after", "beforeafter"), ("before<!-- rest", "before"),
    ("<script>if (a < b) {}</SCRIPT >x", "x"), ("<style>p {}", ""),
    ("q<!doctype html><p>z", "q\nz"), ("x</ y>z", "xz"),
    ("<p>one<p>two<div>three", "one\ntwo\nthree"),
])
def test_markup(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", [
    "<a" * 500_000, '<p title="abc ' * 70_000, "<p title='abc' x=\"" * 50_000, "<!" * 500_000, "</" * 500_000, "<p " * 300_000,
    '<a ="' * 200_000 + ">", '<x a="b>' * 100_001, "<script>" * 100_000, "<div>" * 100_000, "&" * 500_000,
])
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    text(page)
    assert time.process_time() - start < 5


def deep(n):
    return "<article>" + "<div>" * n + "<p>hello there, a longer text to keep</p>" + "</div>" * n + "</article><nav>menu</nav>"


def test_deep_nesting_in_the_fit():
    model = op.train([deep(1200)] * 2)
    assert "hello there" in op.extract([deep(1200)], model)[0]


SENTENCE = "This is a paragraph of the article with a number of words in it."


def test_pages_without_an_article_still_give_text():
    page = "<html><body><div class='menu'><a href=a>one</a><a href=b>two</a></div><div class='content'>" + f"<p>{SENTENCE}</p>" * 6 + "</div></body></html>"
    model = op.train([page] * 20)
    assert len(model.feature) > 0 and op.extract([page], model)[0].count(SENTENCE) == 6


def test_nothing_to_learn_from_keeps_everything():
    model = op.train([])
    assert op.extract(["<p>some text</p>", ""], model) == ["some text", ""]


def test_long_pages_are_read_whole():
    page = "<article>" + "".join(f"<p>{SENTENCE} {i}</p>" for i in range(8000)) + "</article>"
    model = op.train(["<nav><a>m</a></nav><article>" + f"<p>{SENTENCE}</p>" * 5 + "</article>"] * 10)
    assert op.extract([page], model)[0].count(SENTENCE) == 8000


@pytest.mark.parametrize("seed", range(12))
def test_decoding_is_the_best_choice(seed):
    """All keep/drop sets of a small tree, only those without a kept element below a dropped one."""
    rng = np.random.default_rng(seed)
    nodes = [op.Node("div", None)]
    for _ in range(int(rng.integers(1, 8))):
        parent = nodes[int(rng.integers(len(nodes)))]
        nodes.append(op.Node("div", parent))
        parent.kids.append(nodes[-1])
    order, todo = [], [nodes[0]]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    margins = rng.normal(0, 2, len(order))
    yes, no = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    at = {id(n): i for i, n in enumerate(order)}
    best = max((sum(yes[i] if keep[i] else no[i] for i in range(len(order))), keep) for keep in itertools.product((True, False), repeat=len(order))
               if all(not keep[i] or n.parent is None or keep[at[id(n.parent)]] for i, n in enumerate(order)))[1]
    kept, dropped = op.decode([(n, 0, ()) for n in order], margins)
    assert kept == {id(n) for n, k in zip(order, best) if k} and len(kept) + len(dropped) == len(order)
