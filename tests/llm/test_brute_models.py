"""The fitted models' scores against plain forms of the same formulas."""
from math import exp
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import quality_classifier as clf
from privtrace.llm import quality_rules as rules

MASK = (1 << 64) - 1
TEXT = st.one_of(st.text(max_size=50), st.lists(st.sampled_from(["a", "the", "été", "x\x0b", "\xa0", "語", "word\n"]), max_size=30).map(" ".join))


def plain_features(word):
    if word == clf.AGAIN:
        return [crc32(word) % clf.BUCKETS]
    out, w = [crc32(word) % clf.BUCKETS], f"<{word.decode()}>"
    for n in clf.GRAMS:
        for i in range(len(w) - n + 1):
            h = n
            for c in w[i:i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & MASK
                h ^= h >> 29
            out.append(h % clf.BUCKETS)
    return out


def plain_counts(text):
    out, before = {}, None
    for w in text.encode().split():
        key = clf.AGAIN if w == before else w
        out[key] = out.get(key, 0) + 1
        before = w
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_scores_are_the_mean_of_the_vectors_and_softmax(batch):
    rng = np.random.default_rng(3)
    vectors, layer, bias = rng.normal(size=(clf.BUCKETS, clf.DIM)), rng.normal(size=(clf.DIM, 2)), rng.normal(size=2)
    side = layer[:, 1] - layer[:, 0]
    model = clf.Model(vectors @ side, float(bias[1] - bias[0]))
    want = []
    for text in batch:
        ids = [b for w, k in plain_counts(text).items() for b in plain_features(w) * k]
        logits = (vectors[ids].mean(0) if ids else np.zeros(clf.DIM)) @ layer + bias
        p = np.exp(logits - logits.max())
        want.append(p[1] / p.sum())
    assert np.allclose(model.scores(batch), want, atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_bags_count_every_feature(text):
    want = {}
    for w, k in plain_counts(text).items():
        for b in plain_features(w):
            want[b] = want.get(b, 0) + k
    ids, counts = clf.bag(text)
    assert dict(zip(ids.tolist(), counts.tolist())) == want


def test_very_frequent_features_keep_their_shares():
    ids, counts = clf.bag("a b " * 200_000 + "c")
    shares = dict(zip(ids.tolist(), (counts / counts.sum()).tolist()))
    a, b = shares[crc32(b"a") % clf.BUCKETS], shares[crc32(b"b") % clf.BUCKETS]
    assert counts.max() == 65535 and abs(a - b) < 1e-9 and counts.min() >= 1


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark, docs):
    rows = [(i, ("good words in a row " if i % 2 else "bad ### %%% ") * 12) for i in range(120)]
    labels = [(i, i % 2) for i in range(120)] + [(i, 0) for i in range(1000, 9000)]
    model = clf.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=100)
    got = model.scores([t for _, t in rows])
    assert all((s >= 0.5) == bool(i % 2) for (i, _), s in zip(rows, got))


def test_repeated_rows_and_very_long_texts(spark, docs):
    rows = [(i, ("good words in a row " if i % 2 else "bad ### %%% ") * 12) for i in range(60)]
    rows += [rows[0], rows[1], (500, "good words in a row " * 60_000)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = clf.classify(docs(rows), lab).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and max(by[500]) > 0.5
    judged = rules.judge(docs(rows), lab).collect()
    assert len(judged) == len(rows) and {r.n_words for r in judged if r.doc_id == 500} == {300_000}


def test_sigmoid_at_the_ends():
    model = clf.Model(np.full(clf.BUCKETS, 1e6), 0.0)
    assert model.scores(["a"])[0] == 1 / (1 + exp(-700))
    assert model.scores([]).tolist() == []
