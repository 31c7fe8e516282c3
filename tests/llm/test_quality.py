import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import quality_classifier as clf
from privtrace.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "b", " ", "\n", "#", " a b", "\x0b", "\xa0", "é "]), max_size=120).map("".join)))
def test_statistics_match_brute_force(text):
    assert rules.statistics(text)[:5] == brute(text)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", *("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300))]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        bad = i % 6 == 0
        if bad:
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words] if i % 12 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_forest_parts_labelled_rows(spark, docs):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    extra = [(9001, None), (9002, ""), (9003, "w " * 50), (9004, "short text")]
    got = {r.doc_id: r for r in rules.judge(docs(rows + extra), lab).collect()}
    for i, t in rows + extra:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    right = sum(got[i].kept == (q == 1) for i, q in labels)
    assert right >= 0.97 * len(labels)


def test_forest_without_labels_keeps(spark, docs):
    rows, _ = corpus(n=12)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in rules.judge(docs(rows), none).collect())
    assert rules.judge(docs([]), none).collect() == []
    odd = spark.createDataFrame([(None, 1), (5, None), (777, 0)], "doc_id long, quality int")
    assert all(r.kept for r in rules.judge(docs(rows), odd).collect())


def test_isolated_rows_score_higher():
    rng = np.random.default_rng(0)
    x = rng.normal(0.3, 0.05, (600, 8))
    forest = rules.grow(x)
    assert forest.scores(np.full((1, 8), 0.9))[0] > np.quantile(forest.scores(x), 0.99)


def test_classifier_learns_and_holds_out(spark, docs):
    from zlib import crc32
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in clf.classify(docs(rows + [(9001, None), (9002, "")]), lab).collect()}
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(i, q) for i, q in labels if got[i].held_out]
    assert len(held) > 40 and sum(got[i].predicted == q for i, q in held) >= 0.9 * len(held)
    assert got[9001].score == got[9002].score
    again = {r.doc_id: r.score for r in clf.classify(docs(rows[::-1]).repartition(5), lab).collect()}
    assert all(again[i] == got[i].score for i, _ in rows)


def test_held_out_labels_do_not_matter(spark, docs):
    from zlib import crc32
    rows, labels = corpus(n=120)
    flipped = [(i, 1 - q if crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    score = lambda lab: {r.doc_id: r.score for r in clf.classify(docs(rows), spark.createDataFrame(lab, "doc_id long, quality int")).collect()}
    assert score(labels) == score(flipped)


def test_classifier_without_labels_and_accepted(spark, docs):
    rows, labels = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in clf.classify(docs(rows[:5] + [(None, "x")]), none).collect()} == {0.5}
    lab = spark.createDataFrame([*labels, *labels, (None, 0), (3, None)], "doc_id long, quality int")
    df = docs(rows)
    out = clf.accepted(df, lab)
    assert out.columns == df.columns
    want = {r.doc_id for r in clf.classify(df, lab).where("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == want
    assert clf.accepted(docs([]), lab).collect() == []


def test_a_text_goes_to_python_once(spark, docs):
    rows, labels = corpus(n=60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    df = docs([*rows, (None, "x"), (-1, None), (-2, "")])
    out = clf.accepted(df, lab)
    assert "__text" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r.doc_id for r in clf.classify(df, lab).where("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == want and {r.doc_id: r.text for r in out.collect()}.get(-1) is None
    numbers = spark.createDataFrame([(1, 12), (2, None)], "doc_id long, text int")
    scored = {r.doc_id for r in clf.classify(numbers, lab).where("predicted = 1").collect()}
    assert {r.doc_id for r in clf.accepted(numbers, lab).collect()} == scored and clf.accepted(numbers, lab).dtypes == numbers.dtypes


def test_texts_are_handed_over_in_slices(docs):
    from privtrace.llm.rows import SLICE, map_texts, texts

    def start():
        return lambda batch: [[sum(map(len, batch))] * len(batch), list(map(len, batch))]

    rows = [(i, "x" * (1 << 20)) for i in range(10)] + [(10, None), (11, ""), (12, "y" * (SLICE + 5)), (13, "z")]
    got = map_texts(texts(docs(rows)).coalesce(1), "together long, size long", start).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(t or "") for i, t in rows} and len(got) == len(rows)
    assert all(r.together <= SLICE or r.together == r.size for r in got)


def test_repeated_words_are_counted_apart():
    assert clf.counted("a a a b a") == {b"a": 2, b"b": 1, clf.AGAIN: 2}


def test_every_labelled_row_shapes_forest_and_limit(spark, docs):
    rows, labels = corpus(n=300)
    measured = rules.measure(docs(rows))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    whole = rules.fit(measured, lab)
    known = {i: q for i, q in labels}
    got = [(r, known[r.doc_id]) for r in measured.where(~rules.base_failed()).collect()]
    x = rules.shares(np.array([tuple(r)[1:] for r, _ in got], np.float64))
    good = np.array([q == 1 for _, q in got])
    local = rules.grow(x[good])
    assert np.array_equal(whole.feature, local.feature) and np.allclose(whole.rest, local.rest)
    # the limit is the best of all gaps between the scores of all labelled rows
    g, b = local.scores(x[good]), local.scores(x[~good])
    points = np.unique(np.concatenate([g, b]))
    points = [*((points[1:] + points[:-1]) / 2), points[-1] + 1e-9]
    value = [(b > p).mean() - (g > p).mean() if (g > p).mean() <= 0.01 else -1 for p in points]
    assert abs(whole.limit - points[int(np.argmax(value))]) < 1e-12


def test_leaf_masses_weigh_all_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (5_000, 8))
    x[-1] = 30.0
    forest = rules.grow(x)
    assert forest.feature.shape[1] == 511  # as deep as for 256 rows
    s = forest.scores(x)
    assert s[-1] == s.max() and (s[-1] > s[:-1]).all()
