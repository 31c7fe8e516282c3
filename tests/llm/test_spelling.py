import random
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import spelling as op


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


WORDS = st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=7), min_size=1, max_size=25, unique=True)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_search_equals_brute_force(vocabulary, queries):
    index = op.BiIndex(vocabulary)
    for first in (True, False):
        a, b = index.near(queries, first)
        got = sorted((queries[i], vocabulary[j]) for i, j in zip(a, b))
        half = lambda q, w: w[:len(q) // 2] == q[:len(q) // 2] if first else w[len(w) - (len(q) - len(q) // 2):] == q[len(q) // 2:] and len(w) >= len(q) - len(q) // 2
        # what is one edit away and agrees in that half, with the edit in the other one
        want = sorted((q, w) for q in queries for w in vocabulary if one_edit(q, w) and half(q, w))
        assert got == want


def brute(rows, min_count=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 5:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= min_count}
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abceé") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words = list(base)
    for w in base:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:]]))
    return [(i, " ".join(rng.choice(base if rng.random() < 0.6 else words).title() if rng.random() < 0.2 else rng.choice(base if rng.random() < 0.6 else words)
                         for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs, seed):
    rows = corpus(seed) + [(None, "odd words, words! odd_words"), (900, None), (901, ""), (902, "a b c"), (3, corpus(seed)[3][1])]
    got = [tuple(r) for r in op.spelling_variants(docs(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_frequent_half_is_spread_over_cells(spark, docs):
    """All words share their first half, and a cell holds a few of them only."""
    rng = random.Random(5)
    words = sorted({"prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)})
    vocabulary = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long")
    want = {w: sum(one_edit(w, x) for x in words) for w in words}
    for cell in (60, 10_000):
        got = {r.word: r.n_near for r in op.near_words(vocabulary, cell).collect()}
        assert got == {w: n for w, n in want.items() if n}


def test_long_words_and_chains(spark, docs):
    long = "q" * 3000
    rows = [(i, f"{long} {long}z {long}") for i in range(3)] + [(i + 10, "aaaaaa " * 40 + "aaaaab " * 16 + "aaaabb " * 6) for i in range(1)]
    got = {tuple(r) for r in op.spelling_variants(docs(rows)).collect()}
    assert got == brute(rows)


def test_empty_table(spark, docs):
    assert op.spelling_variants(docs([])).collect() == []
