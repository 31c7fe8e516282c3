import random

import pytest
from pyspark.sql import functions as F

from privtrace.operators import contain, detect
from privtrace.operators.detect import fuzzy_match, leak_check, semantic_match, semantic_search


def make(n=300, seed=1):
    """Half of all events and values sit under one key; texts reuse each other's words."""
    r = random.Random(seed)
    words = ["Smith", "123-45-6789", "é", "Ünïcode", "ab", "x", "188000", "noise", "aaaa", "AAaaB", "q\nz", "😀ok", "john.doe@mail.org"]
    ev = [("hot" if i % 2 else f"k{i % 7}", i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(n)]
    va = [("hot" if i % 2 else f"k{i % 7}", f"f{i}", "".join(r.choice(words)[: r.randint(1, 20)] for _ in range(r.randint(1, 3)))) for i in range(n)]
    return ev, va


@pytest.mark.parametrize("case", [False, True])
def test_equals_brute_force(spark, case):
    ev, va = make()
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, text string")
    v = spark.createDataFrame(va, "scenario_id string, field string, value string")
    got = {(r.event_id, r.field) for r in contain.contains_join(e, v, ["scenario_id"], case_sensitive=case).collect()}
    low = (lambda s: s) if case else str.lower
    want = {(i, f) for k, i, t in ev for k2, f, x in va if k == k2 and x and low(x) in low(t)}
    assert got == want


def test_without_keys(spark):
    ev, va = make(120, 5)
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, text string")
    v = spark.createDataFrame([(f, x) for _, f, x in va], "field string, value string")
    got = {(r.event_id, r.field) for r in contain.contains_join(e, v, []).collect()}
    assert got == {(i, f) for _, i, t in ev for _, f, x in va if x and x.lower() in t.lower()}


def test_redact_vault_longest_first(spark):
    from privtrace.operators.redact import redact_vault
    ev, va = make(150, 8)
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, text string")
    v = spark.createDataFrame(va, "scenario_id string, field string, value string")
    got = {r.event_id: r.redacted for r in redact_vault(e, v).collect()}
    want = {}
    for k, i, t in ev:
        for x in sorted({x for k2, _, x in va if k2 == k and len(x) >= 4 and x in t}, key=lambda x: (-len(x), x)):
            t = t.replace(x, "[REDACTED]")
        want[i] = t
    assert got == want and any("[REDACTED]" in x for x in got.values())


def test_index_is_used_again_and_empty_vault(spark):
    ev, va = make(60, 9)
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, text string")
    v = spark.createDataFrame(va, "scenario_id string, field string, value string")
    index = contain.ValueIndex(v.where(F.length("value") >= 4), ["scenario_id"])
    rows = lambda df: sorted((r.event_id, r.field) for r in df.collect())
    assert rows(leak_check(e, v, index=index)) == rows(leak_check(e, v)) != []
    assert leak_check(e, v.limit(0)).collect() == []


def test_leak_check_rules(spark):
    e = spark.createDataFrame([("s", 1, "ssn 123-45-6789 of John Smith, id AB1, mail a@b.org"), ("s", 2, "nothing"), ("t", 3, "123-45-6789")],
                              "scenario_id string, event_id long, text string")
    v = spark.createDataFrame([("s", "ssn", "123-45-6789"), ("s", "name", "JOHN SMITH"), ("s", "short", "AB1"), ("s", "email", "a@b.org"), ("s", "none", None)],
                              "scenario_id string, field string, value string")
    p = spark.createDataFrame([("s", "email")], "scenario_id string, field string")
    r = spark.createDataFrame([("s", "write to john smith")], "scenario_id string, request string")
    got = {(x.event_id, x.field) for x in leak_check(e, v, p, r).collect()}
    assert got == {(1, "ssn")}
    assert {(x.event_id, x.field) for x in leak_check(e, v).collect()} == {(1, "ssn"), (1, "name"), (1, "email")}


def test_semantic_equals_brute_force(spark):
    r = random.Random(3)
    vec = lambda: [r.gauss(0, 1) for _ in range(4)]
    e = spark.createDataFrame([("a" if i % 3 else "b", i, vec()) for i in range(60)], "scenario_id string, event_id long, embedding array<double>")
    v = spark.createDataFrame([("a" if i % 2 else "b", i, vec()) for i in range(40)], "scenario_id string, vault_id long, embedding array<double>")
    for tau in (0.1, 0.72, 0.99):
        got = {(x.event_id, x.vault_id) for x in semantic_match(e, v, tau=tau).collect()}
        cos = lambda p, q: sum(x * y for x, y in zip(p, q)) / (sum(x * x for x in p) * sum(y * y for y in q)) ** 0.5
        assert got == {(x.event_id, y.vault_id) for x in e.collect() for y in v.collect() if x.scenario_id == y.scenario_id and cos(x.embedding, y.embedding) >= tau}


def test_fuzzy_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
    ts, vs = [word() for _ in range(150)], [word() for _ in range(150)]
    t = spark.createDataFrame([("s", x) for x in ts], "scenario_id string, text string")
    v = spark.createDataFrame([("s", x) for x in vs], "scenario_id string, value string")
    got = {(x.text, x.value) for x in fuzzy_match(t, v).collect()}
    both = t.distinct().join(v.distinct(), "scenario_id")
    score = 1 - F.levenshtein("text", "value") / F.greatest(F.length("text"), F.length("value"))
    want = {(x.text, x.value) for x in both.where(score >= 0.8).collect()}
    assert want and got == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("tau", [0.5, 0.65, 0.8, 0.93, 1.0])
def test_fuzzy_of_many_lengths_equals_brute_force(spark, tau):
    """Texts of 0 to 70 characters with inserted, deleted, replaced and moved parts; one scenario holds most rows."""
    rng = random.Random(int(tau * 100))
    word = lambda n: "".join(rng.choice("abcä") for _ in range(n))

    def change(s, k):
        for _ in range(k):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice(["", word(1)]) + s[at + rng.choice([0, 1]):]
        return s

    values = [(rng.choice("aaab"), word(n)) for n in [*range(1, 40), 50, 60, 70]] + [("a", ""), ("a", None), ("c", "alone")]
    texts = [(s, change(w, rng.randrange(len(w) // 3 + 2))) for s, w in values if w for _ in range(4)]
    texts += [(s, w[2:] + w[:2]) for s, w in values if w] + [("a", ""), ("a", None), ("d", "alone")] + texts[:5]
    got = fuzzy_match(spark.createDataFrame(texts, "scenario_id string, text string"),
                      spark.createDataFrame(values, "scenario_id string, value string"), tau=tau).collect()
    want = {(s, t, w) for s, t in texts for z, w in values if s == z and t and w
            and 1 - edit_distance(t, w) / max(len(t), len(w)) >= tau}
    assert {(r.scenario_id, r.text, r.value) for r in got} == want
    assert len(got) == len(want) > 0


def test_fuzzy_of_a_busy_scenario(spark):
    """Every text is found by itself, and few others by it."""
    n = 400
    texts = [("hot", f"{i * 7919:07d}-{i:05d}-{i * 104729 % 1000003:07d}") for i in range(n)]
    df = spark.createDataFrame(texts, "scenario_id string, text string")
    got = fuzzy_match(df, df.withColumnRenamed("text", "value")).collect()
    assert len(got) < n * n / 20
    assert {r.text for r in got if r.text == r.value} == {t for _, t in texts}


def planted(n, dim=24, seed=8):
    """n event vectors, one key for most of them, and n / 4 vault vectors at cosines around the threshold."""
    import numpy as np
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((n, dim))
    v = e[::4] / np.linalg.norm(e[::4], axis=1, keepdims=True) + rng.uniform(0.5, 1.0, (len(e[::4]), 1)) * rng.standard_normal((len(e[::4]), dim)) / dim**0.5
    key = lambda i: "hot" if i % 8 else "cold"
    return [(key(i), i, x.tolist()) for i, x in enumerate(e)], [(key(4 * i), i, x.tolist()) for i, x in enumerate(v)]


def test_semantic_search_recall_and_growth(spark):
    import numpy as np
    formed = []
    for n in (500, 2000):
        ev, va = planted(n)
        e = spark.createDataFrame(ev, "scenario_id string, event_id long, embedding array<double>")
        v = spark.createDataFrame(va, "scenario_id string, vault_id long, embedding array<double>")
        got = {(r.event_id, r.vault_id): r.similarity for r in semantic_search(e, v).collect()}
        x, y = (np.array([r[2] for r in rows]) for rows in (ev, va))
        cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        want = {(i, j) for i, j in zip(*np.where(cos >= 0.72)) if ev[i][0] == va[j][0]}
        assert set(got) <= want and len(got) >= 0.95 * len(want) > 50
        assert all(abs(c - cos[k]) < 1e-9 for k, c in got.items())
        bits = round(0.6 * np.log2(sum(r[0] == "hot" for r in ev)))
        units = detect._unit(e, ["scenario_id"], "event_id"), detect._unit(v, ["scenario_id"], "vault_id")
        formed.append(detect.sign_pairs(*units, ["scenario_id"], 24, bits, detect.sign_tables(0.72, 0.99, bits), 1).count())
    assert formed[1] < 0.8 * 16 * formed[0]


def test_semantic_search_odd_rows(spark):
    e = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 0.0]), ("s", 3, None), ("s", 4, []), ("s", 5, [1.0, None]),
                               ("s", 6, [float("nan"), 1.0]), ("s", 7, [1.0, 0.0, 0.0]), (None, 8, [1.0, 0.0])],
                              "scenario_id string, event_id long, embedding array<double>")
    v = spark.createDataFrame([("s", 1, [2.0, 0.1]), ("s", 2, None)], "scenario_id string, vault_id long, embedding array<double>")
    assert sorted((r.event_id, r.vault_id) for r in semantic_search(e, v).collect()) == [(1, 1), (1, 1)]
    assert semantic_search(e.limit(0), v).count() == 0 and semantic_search(e, v.limit(0)).count() == 0


def test_semantic_match_in_a_grid_of_cells(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    monkeypatch.setattr(detect, "CELL", 16)
    vec = lambda: rng.standard_normal(6).tolist()
    ev = [("hot" if i % 9 else "cold", i, vec()) for i in range(120)]
    va = [("hot" if i % 7 else "cold", i, vec()) for i in range(90)]
    ev += [ev[1], (None, 500, vec()), ("hot", 501, [0.0] * 6), ("hot", 502, None), ("hot", 503, [1.0, None]), ("hot", 504, [1.0]), ("alone", 505, vec())]
    va += [va[1], (None, 500, vec()), ("hot", 501, [float("nan")] * 6), ("hot", 502, []), ("hot", 504, [2.0])]
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, embedding array<double>")
    v = spark.createDataFrame(va, "scenario_id string, vault_id long, embedding array<double>")
    found = semantic_match(e, v, tau=0.3)
    assert "CoGroup" in found._jdf.queryExecution().toString()
    real = lambda x: bool(x) and None not in x and sum(t * t for t in x) > 0
    cos = lambda p, q: sum(s * t for s, t in zip(p, q)) / (sum(s * s for s in p) * sum(t * t for t in q)) ** 0.5
    want = sorted((a[0], a[1], b[1]) for a in ev for b in va if a[0] and a[0] == b[0] and real(a[2]) and real(b[2])
                  and len(a[2]) == len(b[2]) and cos(a[2], b[2]) >= 0.3)
    assert sorted((r.scenario_id, r.event_id, r.vault_id) for r in found.collect()) == want


def test_semantic_search_forms_few_false_pairs(spark):
    ev, va = planted(1500)
    e = spark.createDataFrame(ev, "scenario_id string, event_id long, embedding array<double>")
    v = spark.createDataFrame(va, "scenario_id string, vault_id long, embedding array<double>")
    units = detect._unit(e, ["scenario_id"], "event_id"), detect._unit(v, ["scenario_id"], "vault_id")
    tables = detect.sign_tables(0.72, 0.99, 6)
    formed = detect.sign_pairs(*units, ["scenario_id"], 24, 6, tables, 1, 0.72).count()
    every = detect.sign_pairs(*units, ["scenario_id"], 24, 6, tables, 1).count()
    found = semantic_search(e, v).count()
    assert found <= formed < 0.05 * every
