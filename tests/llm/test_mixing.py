import re
from collections import defaultdict

import pytest

from privtrace.llm.mixing import mix, mixed_documents


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped) or 1
        now = {s: 3.0 * sizes[s] if s in capped else left * w[s] / open_w for s in names}
        over = {s for s in names if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def rows(n=200):
    out = [(i, " ".join(["w"] * (i * 7 % 23)), ("b", "a", "é", "z", None)[0 if i % 3 == 0 else i % 5]) for i in range(n)]
    return [*out, (n, None, "a"), (n + 1, "", None), (n + 2, "only words here", "Z"), (n + 3, "wörd x y\x0bz", "a")]


def test_targets_and_words_taken(docs):
    data = rows()
    got = mix(docs(data)).collect()
    sizes = defaultdict(int)
    for i, t, s in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(data)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_reruns_agree(docs):
    a = sorted((r.doc_id, r.taken) for r in mix(docs(rows())).collect())
    b = sorted((r.doc_id, r.taken) for r in mix(docs(rows()[::-1]).repartition(7)).collect())
    assert a == b


def test_heavy_documents_come_early(docs):
    from pyspark.sql import functions as F
    data = [(i, "w w w w", "a") for i in range(400)] + [(1000 + i, "v", c) for i, c in enumerate("bc")]
    got = mix(docs(data), weights=(1, 300, 300), max_epochs=400, quality=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).collect()
    took = [r.doc_id % 2 for r in got if r.source == "a" and r.taken > 0]
    assert 50 < len(took) < 390 and sum(took) < 0.4 * len(took)


def test_mixed_documents_hold_the_words(docs):
    df = docs(rows())
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in mix(df).collect())


def test_no_words_and_empty(docs):
    assert [(r.target, r.taken) for r in mix(docs([(1, None, None), (2, " ", "a")])).collect()] == [(0.0, 0)] * 2
    assert mix(docs([])).collect() == []
    assert mixed_documents(docs([])).collect() == []
    assert len(mix(docs([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()) == 3


def test_whole_documents_are_never_cut(docs):
    df = docs(rows())
    texts = {(r.doc_id, r.text) for r in df.collect()}
    assert any((r.doc_id, r.text) not in texts for r in mixed_documents(df).collect())
    out = mixed_documents(df, whole=True).collect()
    assert out and all((r.doc_id, r.text) in texts for r in out)
    told = mix(df).collect()
    want = sum(r.epochs + (r.taken > r.epochs * r.size) for r in told if r.taken > 0)
    assert len(out) == want


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline
    df = spark.createDataFrame([(i, f"a{i} " * (50 + i), "xyz"[i % 3]) for i in range(40)], "doc_id long, text string, source string")
    texts = {r.text for r in df.collect()}
    assert {r.text for r in corpus_pipeline.mix(spark, df, "").collect()} <= texts
