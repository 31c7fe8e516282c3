from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from privtrace.llm.exact_dedup import build_directory, drop_copies, exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "b"), (8, "x" * 70_000), (9, "x" * 70_000), (10, "Ä"), (11, "\n")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(g), len(g), i == max(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_groups(docs):
    assert found(exact_dedup(docs(ROWS))) == expected(ROWS)


def test_chains_of_colliding_keys(docs):
    for weak in (lambda t: F.length(t).cast("long"), lambda t: F.lit(7).cast("long")):
        assert found(exact_dedup(docs(ROWS), key=weak)) == expected(ROWS)


def test_buckets_split_when_overfull(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    directory, depth = build_directory(keys, capacity=20)
    buckets = [(r.bucket, r.depth) for r in directory.collect()]
    assert depth >= 6 and len({d for _, d in buckets}) > 1
    counts = defaultdict(int)
    for (k,) in keys.collect():
        bits = format(k & (2**64 - 1), "064b")
        own = [b for b in buckets if b[1] == 0 or int(bits[:b[1]], 2) == b[0]]
        assert len(own) == 1
        counts[own[0]] += 1
    assert max(counts.values()) <= 20


def test_small_capacity_gives_the_same(docs):
    rows = [(i, f"t{i % 60}") for i in range(300)]
    assert found(exact_dedup(docs(rows), capacity=4)) == expected(rows)


def test_repeated_rows_null_ids_and_empty(docs):
    got = exact_dedup(docs([(1, "a"), (1, "a"), (None, "a"), (None, "z"), (None, "z")])).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 5
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 3), (None, 2)}
    assert exact_dedup(docs([])).collect() == []


def test_drop_copies_keeps_columns(docs):
    df = docs([(1, "a"), (1, "a"), (2, "a"), (3, None), (3, ""), (4, "q"), (4, "r")])
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, "a"), (3, ""), (4, "q"), (4, "r")]
