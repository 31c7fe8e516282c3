"""Order-dependent rules against their plain sequential form."""
import random

import pytest
from pyspark.sql import functions as F

from privtrace.dims import recognizers as rz
from privtrace.operators import contain, detectors, flows, layers, pii, redact


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[1], s[3] - s[4], s[3], s[0], s[2])):
        if not any(s[3] < k[4] and k[3] < s[4] for k in kept):
            kept.append(s)
    return kept


TEXTS = [
    (1, "Patient SSN 123-45-6789, card 4111-1111-1111-1111, mail john.doe@mail.org, phone +1 (555) 123-4567."),
    (2, "Acct 123456789012 routing 021000021 ip 10.1.2.3 salary $120,000 on 2024-05-06 IBAN DE89370400440532013000"),
    (3, ""), (4, None), (5, "nothing to see"),
    (6, "123-45-6789 " * 40 + "4111-1111-1111-1111 " * 20),
]


def test_overlaps_of_the_whole_catalogue(spark):
    df = spark.createDataFrame(TEXTS, "event_id long, text string")
    spans = pii.find_spans(df, threshold=0.0, offsets=True)
    row = lambda r: (r.entity, r.score, r.match, r.start, r.end)
    by = {}
    for r in spans.select("event_id", "entity", "score", "match", "start", "end").distinct().collect():
        by.setdefault(r.event_id, []).append(row(r))
    assert sum(map(len, by.values())) > 60
    cols = ["event_id", "entity", "score", "match", "start", "end"]
    got = sorted((r.event_id, *row(r)) for r in redact.resolve_overlaps(spans.select(cols).distinct()).collect())
    assert got == sorted((k, *s) for k, some in by.items() for s in greedy(some))
    # the one-pass redaction and the one from settled spans agree
    a = {r.event_id: r.redacted for r in redact.redact_scan(df, rz.flat()).collect()}
    b = {r.event_id: r.redacted for r in redact.redact_spans(df, spans).collect()}
    assert a == b and "123-45-6789" not in a[6]


def sequential(expected, actual):
    out, used = {}, {}
    for k, no, args, dynamic in sorted(expected, key=lambda e: (e[0], e[1])):
        taken = used.setdefault(k, set())
        free = [n for kk, n, have in sorted(actual, key=lambda a: (a[0], a[1])) if kk == k and n not in taken
                and all(x in have and (x in dynamic or have[x] == y) for x, y in args.items())]
        taken.update(free[:1])
        out[k, no] = bool(free)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contested_calls_and_a_hot_key(spark, seed):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.6 else f"s{rng.randrange(4)}"
    expected = [(key(), i, {k: str(rng.randrange(2)) for k in rng.sample("ab", rng.randint(0, 2))}, rng.choice([[], ["a"], ["b"]])) for i in range(150)]
    actual = [(key(), i, {k: str(rng.randrange(2)) for k in rng.sample("abc", rng.randint(1, 3))}) for i in range(140)]
    e = spark.createDataFrame([(k, 0, "t", i, a, d) for k, i, a, d in expected], "scenario_id string, agent_id int, tool string, call_no long, args map<string,string>, dynamic array<string>")
    a = spark.createDataFrame([(k, 0, "t", i, x) for k, i, x in actual], "scenario_id string, agent_id int, tool string, call_no long, args map<string,string>")
    got = {(r.scenario_id, r.call_no): r.found for r in flows.match_tool_calls_greedy(e, a).collect()}
    assert got == sequential(expected, actual)


def chain_layers(points):
    out = {}
    for c, u in sorted(set(points), key=lambda p: (p[0], -p[1])):
        out[c, u] = 1 + max((n for (a, b), n in out.items() if a <= c and b >= u), default=0)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "ties", "front"])
def test_layers_over_a_grid(spark, shape):
    rng = random.Random(3)
    n = 150
    pts = {"random": lambda i: (rng.randrange(40) / 40, rng.randrange(40) / 40), "chain": lambda i: (i / n, 1 - i / n),
           "ties": lambda i: (rng.randrange(3) / 3, rng.randrange(30) / 30), "front": lambda i: (i / n, i / n)}[shape]
    rows = [("g", f"p{i}", *pts(i)) for i in range(n)] + [(None, "one", 0.5, 0.5), (None, "two", 0.6, 0.4)]
    df = spark.createDataFrame(rows, "grp string, name string, cost double, utility double")
    got = {r.name: r.layer for r in layers.pareto_layers(df, ["grp"], block=30).collect()}
    want = chain_layers([(c, u) for g, _, c, u in rows if g])
    assert got == {**{p: want[c, u] for g, p, c, u in rows if g}, "one": 1, "two": 2}


def test_layers_without_groups(spark):
    df = spark.createDataFrame([("a", 0.1, 0.9), ("b", 0.2, 0.8), ("c", 0.05, 0.1), ("d", None, 1.0)], "name string, cost double, utility double")
    assert {r.name: r.layer for r in layers.pareto_layers(df).collect()} == {"a": 1, "b": 2, "c": 1}


def test_repeated_events_do_not_multiply(spark):
    ev = spark.createDataFrame([("s", 1, "has value1 and value2")] * 3 + [("s", 1, "other value2"), ("s", 2, "none")], "scenario_id string, event_id long, text string")
    va = spark.createDataFrame([("s", "a", "value1"), ("s", "b", "value2"), ("t", "c", "value1")], "scenario_id string, field string, value string")
    got = sorted((r.event_id, r.field) for r in contain.contains_join(ev, va, ["scenario_id"]).collect())
    assert got == [(1, "a")] * 3 + [(1, "b")] * 4


def test_keys_of_other_integer_types_and_long_texts(spark):
    long = "x" * 3_000_000 + " needle-value " + "y" * 100
    ev = spark.createDataFrame([(1, 1, long), (2, 2, long), (None, 3, long)], "k int, event_id long, text string")
    va = spark.createDataFrame([(1, "needle-value"), (None, "needle-value"), (2, "é")], "k long, value string")
    assert [(r.k, r.event_id) for r in contain.contains_join(ev, va, ["k"]).collect()] == [(1, 1)]


def test_detectors_by_name(spark):
    df = spark.createDataFrame(TEXTS, "event_id long, text string")
    assert detectors.detectors() == ["catalogue", "general", "quick"]
    detectors.register_detector("badge", lambda e: e.select("event_id", F.lit("BADGE").alias("entity"), F.lit(1).alias("score"),
                                                            F.explode(F.regexp_extract_all("text", F.lit("Acct"), F.lit(0))).alias("match")))
    try:
        with pytest.raises(ValueError):
            detectors.register_detector("badge", None)
        got = detectors.detect(df, ["badge", "quick", "badge"])
        assert got.columns == ["event_id", "detector", "entity", "score", "match"]
        assert [(r.event_id, r.match) for r in got.where("detector = 'badge'").collect()] == [(2, "Acct")]
        quick = sorted((r.event_id, r.entity, r.match) for r in pii.quick_scan(df).collect())
        assert sorted((r.event_id, r.entity, r.match) for r in got.where("detector = 'quick'").collect()) == quick
    finally:
        detectors.unregister_detector("badge")
    with pytest.raises(KeyError):
        detectors.detect(df, ["badge"])
    assert detectors.detect(df, []).collect() == []


def test_table_function_equals_the_scan(spark):
    df = spark.createDataFrame(TEXTS, "event_id long, text string")
    detectors.register_functions(spark)
    df.createOrReplaceTempView("udtf_events")
    cols = ["event_id", "entity", "pattern_no", "score", "match", "start", "end"]
    for threshold in (0.85, 0.0):
        got = spark.sql(f"SELECT e.event_id, s.* FROM udtf_events e, LATERAL pii_spans(e.text, {threshold}D) s").select(cols)
        want = pii.find_spans(df, threshold=threshold, offsets=True).select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gates_of_machines_lose_no_match():
    import re

    from privtrace.dims import recognizers as rz
    from privtrace.functions import patterns as pt
    assert pt.required_runs(r"\b\d{8,12}\b") == (8, 8) and pt.required_runs(r"\b[A-HJ-NPR-Z0-9]{17}\b") == (17, 0)
    assert pt.required_runs(r"\b(?:ab|cde)\d?x*\b") == (2, 0) and pt.required_runs(r"(?:\d{4}[- ]?){3}") == (4, 4)
    assert pt.required_words(r"\b(?:USD|EUR|E)\b") == ("e", "eur", "usd") and pt.required_words(r"\b(?:USD|EUR)") == ()
    texts = ["pay 12345678 EUR to 1HGCM82633A004352", "usd 5, east of N, Dr. Who", "a_b eurusd 1234567", "a1b2c3d4e5f6g7h8i9j0 99-123456-123456-1", "", "éUSD x"]
    for flags in ("", "(?ims)"):
        for _, _, p, _ in rz.flat():
            plain = re.compile(flags + pt.python_pattern(p))
            m = pt.Machine(p, flags)
            for t in texts:
                assert [h.span() for h in m.finditer(t, pt.Lowered(t.lower()))] == [h.span() for h in plain.finditer(t)], (p, t)
    # a pattern is not even tried where a number is too short
    m = pt.Machine(r"\b\d{8,12}\b")
    m.compiled = None
    assert m.finditer("1234567 and 89", "1234567 and 89") == ()
