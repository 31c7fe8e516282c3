import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import near_dedup as op


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, threshold=80):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def families(seed, n=260):
    """Families of edited copies, so that many pairs lie about the threshold."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.85:
            words = rng.choice(out[:8]).split()
            for _ in range(rng.randint(0, max(1, len(words) // 9))):
                p = rng.randrange(len(words))
                kind = rng.random()
                if kind < 0.5:
                    words[p] = rng.choice(vocab)
                elif kind < 0.75:
                    words.insert(p, rng.choice(vocab))
                elif len(words) > 2:
                    del words[p]
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 40, 120]))]
        out.append(" ".join(words))
    return list(enumerate(out))


def check(df, rows, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute(rows, width)


def test_components_match_brute_force(docs):
    for seed, width in ((1, 2), (2, 5)):
        rows = families(seed)
        check(op.near_dedup(docs(rows), width=width), rows, width)


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Word"), (5, "word"), (6, "word word"), (7, "A b C"), (8, "a B c"), (9, "a b"), (10, "x " * 40_000), (11, "x y"),
            (12, "a\xa0b c"), (13, "É b"), (14, "é b")]
    check(op.near_dedup(docs(rows), width=2), rows, 2)
    got = op.near_dedup(docs([(3, "a b"), (3, "a b"), (None, "a b"), (2, "a b")]), width=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (3, 2), (3, 2)]
    assert op.near_dedup(docs([])).collect() == []


def test_all_in_one_bucket_without_center_links(docs):
    rows = [(i, " ".join(f"c{k}" if (k * 7 + i) % 9 else f"e{i}{k}" for k in range(100))) for i in range(40)]
    check(op.near_dedup(docs(rows), width=2), rows, 2)


def test_drop_near_copies(docs):
    df = docs(families(5, 80))
    out = op.drop_near_copies(df, width=2)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute(families(5, 80), 2).items() if i == c}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 2**63), min_size=1, max_size=400))
def test_sketch_is_full_and_depends_on_the_set_only(s):
    a = np.array(sorted(s), np.uint64)
    x = op.sketch(a)
    assert (x != op._EMPTY).all() and (x == op.sketch(a.copy())).all()
    # every coordinate's value belongs to some element: removing all others keeps or raises it
    assert (op.sketch(a[:1]) >= x).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**63, 1200).astype(np.uint64)
    for common, own in ((800, 100), (300, 300), (9, 1)):
        share = []
        for k in range(30):
            x = rng.permutation(pool)
            a, b = np.unique(x[:common + own]), np.unique(np.concatenate([x[:common], x[common + own:common + 2 * own]]))
            share.append((op.sketch(a) == op.sketch(b)).mean())
        want = common / (common + 2 * own)
        assert abs(np.mean(share) - want) < 0.05
