from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from privtrace.llm import merkle as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(s):
    return sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    i, source, lang, n, text = row
    return H("".join(map(field, (i, source, lang, n if n is None else n + more, text))))


def tree(hashes):
    """All levels, the lowest first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return levels


def path(levels, i):
    """(left, right) per level."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        other = level[j] if j < len(level) else ""
        out.append((other, "") if i % 2 else ("", other))
        i //= 2
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))),) for g in order}
    trees = {g: (rs, tree([leaf(r) for r in rs])) for g, (rs,) in trees.items()}
    top = tree([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        rs, levels = trees[g]
        for i, r in enumerate(rs):
            steps = path(levels, i) + path(top, k)
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf(r, 1) if tampered else leaf(r)
            for left, right in steps:
                h = H(left + h + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[-1][0], root, H("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    return [(i * 3, f"s{i % 4}", langs[i % len(langs)], i if i % 5 else None, None if i % 11 == 0 else f"text {i} é") for i in range(n)]


@pytest.mark.parametrize("n,langs,digits", [(1, ["a"], 8), (2, ["a", None], 8), (7, ["b", "é", None], 1), (45, ["x", "x", None, "y", "x"], 2), (40, ["q"], 8)])
def test_equals_brute_force(spark, monkeypatch, n, langs, digits):
    monkeypatch.setattr(op, "DIGITS", digits)
    monkeypatch.setattr(op, "_paths", _with_digits(op, digits))
    rows = rows_of(n, langs)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "rank", "node", "block", "path", "tree", "h", "root")})
    got = sorted((tuple(r) for r in op.merkle_manifest(df.repartition(3)).collect()), key=str)
    assert got == brute(rows)


def _with_digits(module, digits):
    whole = module._paths
    return lambda node, above, n, level=None: whole(node, above, n, digits if level is None else level)


def test_ties_repeats_and_tampering(spark):
    rows = [(1, "s", "a", 3, "x"), (1, "s", "a", 3, "x"), (1, "s", "a", 3, "y"), (None, None, None, None, None), (7, "", "", 0, ""),
            (8, "-", "a", 9, "t" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in op.merkle_manifest(df).collect()), key=str)
    assert got == brute(rows)
    # a claim that differs fails, and only that one
    proofs = op.verify(op.manifest(df, F.when(F.col("doc_id") == 8, F.sha2(F.lit("other"), 256))))
    assert {(r.doc_id, r.verified) for r in proofs.collect()} == {(1, True), (None, True), (7, True), (8, False)}


def test_empty_table(spark):
    assert op.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
