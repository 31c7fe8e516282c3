import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from privtrace.llm import line_dedup as op


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=op.MIN_CHARS):
    seen, out = [], {}
    for i, t in sorted(rows):
        out[i] = []
        for k, x in enumerate((t or "").split("\n")):
            if not re.search(r"[^\x20\x09-\x0D]", x):
                continue
            if any(x == y or len(x) >= least and len(y) >= least and within_one(x, y) for y in seen):
                out[i].append(k)
            seen.append(x)
    return out


def data(seed, n=120):
    rng = random.Random(seed)
    base = [f"the quick brown fox jumps over dogs {i}" for i in range(12)] + ["short", "a" * 24, "", "  ", "ü" * 21 + "漢字🙂"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(x) + 1)
                x = rng.choice([x[:p] + rng.choice("aX ") + x[p:], x[:p] + x[p + 1:], x[:p] + "Z" + x[p + 1:]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    return rows


def test_dropped_lines_match_brute_force(docs):
    rows = data(3)
    got = op.line_dedup(docs(rows))
    assert {r.doc_id: r.dropped for r in got.collect()} == brute(rows)
    assert all(r.n_dropped == len(r.dropped) and r.n_lines == rows[r.doc_id][1].count("\n") + 1 for r in got.collect())
    left = {r.doc_id: r.text for r in op.without_dropped(docs(rows), got).collect()}
    for i, drop in brute(rows).items():
        assert left[i] == "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k not in drop)


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 30_000 + "\nA line that stands here twice\nA line that stands here twice"), (5, "A line that stand here twice"), (6, "y" + "x" * 29_999)]
    assert {r.doc_id: r.dropped for r in op.line_dedup(docs(rows)).collect()} == brute(rows)
    got = op.line_dedup(docs([(7, "one line of text here, long"), (7, "one line of text here, long"), (None, "one line of text here, long")])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (7, 0), (7, 0)]
    assert op.line_dedup(docs([])).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text("abé🙂", min_size=1, max_size=30), st.data())
def test_variant_keys_are_keys_of_the_variants(line, d):
    powers = op._Powers(op._B1), op._Powers(op._B2)
    one, two = op.variant_keys(line, 0, len(line), powers)
    i = d.draw(st.integers(0, len(line) - 1))
    short = line[:i] + line[i + 1:]
    a, b = op.variant_keys(short, 0, 0, powers)
    assert (one[1 + i], two[1 + i]) == (a[0], b[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wider_bounds_match_brute_force(docs):
    def limit(x, edits):
        return edits if len(x) >= op.MIN_CHARS else 1

    rng = random.Random(5)
    base = [f"the quick brown fox jumps over {i * 37}" for i in range(8)] + ["short", "abc", "a" * 24, "ü" * 19 + "漢字🙂", "  "]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 5])):
                p = rng.randrange(len(x) + 1)
                x = rng.choice([x[:p] + rng.choice("aX ") + x[p:], x[:p] + x[p + 1:], x[:p] + "Z" + x[p + 1:]])
            lines.append(x)
        texts.append("\n".join(lines))
    long = " ".join(f"word{i}" for i in range(80))
    texts += [long, "X" + long[1:-1] + "Y"]
    for edits in (2, 3):
        seen, want = [], {}
        for i, t in enumerate(texts):
            want[i] = []
            for k, x in enumerate(t.split("\n")):
                if re.search(r"[^\x20\x09-\x0D]", x):
                    if any(x == y or abs(len(x) - len(y)) <= edits and distance(x, y) <= min(limit(x, edits), limit(y, edits)) for y in seen):
                        want[i].append(k)
                    seen.append(x)
        assert want[len(texts) - 1] == [0]
        got = op.line_dedup(docs(list(enumerate(texts))), edits=edits, short_edits=1)
        assert {r.doc_id: r.dropped for r in got.collect()} == want


def test_query_takes_the_production_bounds(spark, tmp_path):
    from privtrace.llm.queries import QUERIES
    texts = ["a line of some length that stands here", "A line of some length that stands hero", "short one", "short ones"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_dropped for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
