"""Recognition, gates, redaction, verdicts."""
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from privtrace.dims import recognizers as rz
from privtrace.functions import text as tx
from privtrace.functions.patterns import required_literals
from privtrace.operators import compose, detect, pii, redact

SAMPLES = {
    "PATIENT_ID": "PT-123456", "IMEI": "49-015420-323751-8", "VIN": "1HGCM82633A004352", "CRYPTO_ADDRESS": "0x" + "ab12" * 10, "VRM": "AB12CDE",
    "GPS_COORDINATE": "[48.8566, 2.3522]", "BIC_SWIFT": "SWIFT: DEUTDEFF", "PIN_CODE": "PIN: 1234", "CVV": "CVV 123", "MAC_ADDRESS": "00:1A:2B:3C:4D:5E",
    "MEDICAL_RECORD": "MRN: 1234567", "NAME_PREFIX": "Dr. Who", "PASSWORD": "password: hunter2", "AGE": "age: 42", "HEIGHT": "5 feet 11 inches",
    "EYE_COLOR": "eye color: blue", "GENDER": "gender: female", "JOB_INFO": "occupation: welder", "COMPANY_NAME": "employer: Acme Works",
    "SECONDARY_ADDRESS": "Apt 12B", "USER_AGENT": "Mozilla/5.0 (X11; Linux)", "CURRENCY": "USD", "MASKED_NUMBER": "1234****5678", "DIAGNOSIS": "COPD",
    "LOCATION": "Ohio", "STREET": "12 North Main Street", "PHONE_NUMBER": "+44 20 7946 0958", "SALARY": "salary: $120,000", "EMPLOYEE_ID": "EMP-12345",
    "CANDIDATE_ID": "CAND-12345", "BACKGROUND_CHECK": "pending investigation", "INTERNAL_NOTES": "do not hire", "PERFORMANCE_NOTES": "on probation",
    "DISCIPLINARY_ACTION": "written warning (2021)", "REFERENCE_NAME": "reference: Jane Roe", "INSURANCE_ID": "INS-12345678", "CANARY_TOKEN": "CANARY_CONF_NOTE_AB12CD34",
}


def test_catalogue_size():
    assert len(rz.RECOGNIZERS) == 45 and len(rz.flat()) == 110


def test_one_sample_per_entity(spark):
    df = spark.createDataFrame([(e, f"Note: {t} end") for e, t in SAMPLES.items()], "event_id string, text string")
    for offsets in (False, True):
        spans = pii.find_spans(df, threshold=0.8, offsets=offsets)
        found = {(r.event_id, r.entity) for r in spans.select("event_id", "entity").collect()}
        assert not [e for e in SAMPLES if (e, e) not in found]


def test_gates_hold_for_every_match():
    texts = [f"Note: {t} end" for t in SAMPLES.values()] + ["eye COLOR: Blue", "pwd: x1", "Two-spirit", "401k Account", "SE of town"]
    for e, i, p, _ in rz.flat():
        words = required_literals(p)
        for t in texts:
            for m in re.finditer("(?ims)" + p, t):
                assert not words or any(w in m.group().lower() for w in words), (e, i, m.group())


@given(st.from_regex(r"(foo|fob|bar)x{1,3}[0-9]*(z|y)?", fullmatch=True))
@settings(max_examples=50, deadline=None)
def test_gate_property(s):
    assert any(w in s for w in required_literals(r"(foo|fob|bar)x{1,3}[0-9]*(z|y)?"))


def test_analyze_filters_in_the_row(spark):
    df = spark.createDataFrame([(1, "gender: female and Ohio"), (2, "the USD amount, city: Town")], "event_id long, text string")
    got = {(r.event_id, r.entity, r.match) for r in pii.analyze(df).collect()}
    assert (1, "LOCATION", "Ohio") in got and (1, "GENDER", "gender: female") in got
    port = spark.createDataFrame([(3, "gender: male connector port")], "event_id long, text string")
    assert pii.is_false_positive  # exact words only: the whole match decides
    assert {r.match for r in pii.analyze(port).collect()} == {"gender: male"}


def random_texts(n=60):
    r = random.Random(9)
    parts = ["123-45-6789", "10.20.30.40", "4111-1111-1111-1111", "12345678", " ", "é", "x", "\n", "999"]
    return [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(n)]


TABLE = [("US_SSN", 0, r"\d{3}-\d{2}-\d{4}", 0.85), ("IP_ADDRESS", 0, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0.95),
         ("CREDIT_CARD", 0, r"\d{4}-\d{4}-\d{4}-\d{4}", 1.0), ("NUMBER", 0, r"\d{5,12}", 0.4)]


@pytest.mark.parametrize("style", ["placeholder", "asterisk", "masked", "hash", "category", "remove"])
def test_redaction_two_ways(spark, style):
    df = spark.createDataFrame(random_texts(), "event_id long, text string")
    one = {r.event_id: (r.redacted, r.redactions) for r in redact.redact_scan(df, TABLE, style).collect()}
    spans = pii.find_spans(df, TABLE, 0.0, offsets=True, flags="")
    two = {r.event_id: (r.redacted, r.redactions) for r in redact.redact_spans(df, spans, style).collect()}
    assert one == two
    if style == "placeholder":
        assert any("[REDACTED_" in x for x, _ in one.values())
        again = spark.createDataFrame([(k, x[0]) for k, x in one.items()], "event_id long, text string")
        strict = [t for t in TABLE if t[0] != "NUMBER"]
        best = {k: x[0] for k, x in one.items()}
        left = pii.find_spans(again, [strict[2]], 0.0, flags="").count()
        assert left == 0 and best


def test_sanitize_by_hand(spark):
    df = spark.createDataFrame([("SSN: 123-45-6789, call 555-123-4567, mail a.b@c.org",)], "text string")
    row = df.select(redact.sanitize("text").alias("s"), redact.sanitize_hits("text").alias("n")).first()
    assert row.s == "SSN: [REDACTED], call [REDACTED], mail [REDACTED]" and row.n == 3


def test_verdicts(spark):
    rows = [(1, '{"score": 1, "leaks": []}'), (2, 'text ```json\n{"has_leakage": true, "confidence": 0.8}\n``` more'), (3, "no json"), (4, "{broken"),
            (5, '{"score": 0, "leaks": [{"field_name": "ssn", "confidence": 0.9}, {"field_name": "x", "confidence": 0.5}]}'),
            (6, '{"score": 0, "leaks": [{"field_name": "x", "confidence": 0.71}]}')]
    out = {r.k: r for r in detect.parse_verdict(spark.createDataFrame(rows, "k int, verdict string")).collect()}
    assert [out[i].is_leak for i in range(1, 7)] == [True, True, False, False, True, False]
    assert out[2].verdict_confidence == 0.8 and out[5].verdict_confidence == 0.9 and len(out[5].leaks) == 1 and out[3].verdict_confidence == 0.0


def test_numeric_forms(spark):
    v = spark.createDataFrame([("s", 0, "salary", "188000"), ("s", 1, "phone", "188000")], "scenario_id string, record_idx long, field string, value string")
    assert {r.form for r in detect.vault_numeric_forms(v).collect()} == {"188,000", "188k", "188K", "$188,000", "€188,000", "£188,000"}


def test_channel_and_checksums(spark):
    df = spark.createDataFrame([("final_output",), ("C5_memory_write",), ("c6",), ("?",)], "c string")
    assert [r[0] for r in df.select(tx.normalize_channel("c")).collect()] == ["C1", "C5", "C6", "C1"]
    ib = spark.createDataFrame([("GB82WEST12345698765432",), ("GB82WEST12345698765431",)], "c string")
    assert [r[0] for r in ib.select(tx.iban_ok("c")).collect()] == [True, False]


def test_cascade_last_tier_stands(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, text string")
    weak = lambda e: e.select("event_id", F.lit(True).alias("leaked"), F.when(F.col("event_id") == 1, 0.95).otherwise(0.6).alias("confidence"))
    clean = lambda e: e.select("event_id", F.lit(False).alias("leaked"), F.lit(1.0).alias("confidence"))
    out = {r.event_id: (r.tier, r.leaked) for r in detect.cascade(df, [("fast", weak), ("slow", clean)]).collect()}
    assert out == {1: (1, True), 2: (2, False)}


def test_quotas_sum():
    q = compose.quotas(1000)
    assert sum(n for *_, n in q) == 248 * 4 + 8 * 1 or sum(n for *_, n in q) <= 1000
    assert all(n >= 1 for *_, n in compose.quotas(3))


def test_both_span_engines_agree_and_redaction_follows(spark):
    from privtrace.operators import pii, redact
    rows = [(1, "pt-123456 and mrn: 1234567 pin 1234"), (2, "PT-١٢٣٤٥٦ ١٢٣-45-6789"), (3, "é123-45-6789 Ünï 123-45-6789é Straße 12"),
            (4, "Salary: $120,000\nDOB 01/02/1990 Mr Smith, john.doe@mail.org"), (5, ""), (6, None), (7, "IP 10.0.0.1 card 4111-1111-1111-1111")]
    df = spark.createDataFrame(rows, "event_id long, text string")
    a = sorted((r.event_id, r.entity, r.pattern_no, r.match) for r in pii.find_spans(df, threshold=0.0).collect())
    b = sorted((r.event_id, r.entity, r.pattern_no, r.match) for r in pii.find_spans(df, threshold=0.0, offsets=True).collect())
    assert a == b and a
    found = {i for i, *_ in a}
    from privtrace.dims import recognizers as rz
    changed = {r.event_id for r in redact.redact_scan(df, rz.flat()).collect() if r.redactions}
    assert changed == found and 1 in changed


def test_verdicts_with_text_numbers(spark):
    from privtrace.operators.detect import parse_verdict
    rows = [(1, '{"score": 1.0}'), (2, 'so: {"score": "1", "confidence": "0.9"}'), (3, '{"score": 0, "leaks": [{"field_name": "ssn", "confidence": "0.9"}]}'),
            (4, '{"score": 1, "overall_severity": "huge"}'), (5, '{"score": 1, "confidence": "much"}'), (6, "no json"), (7, None), (8, '{"has_leakage": true, "overall_severity": "high"}')]
    got = {r.i: (r.is_leak, r.parsed, r.severity) for r in parse_verdict(spark.createDataFrame(rows, "i int, verdict string")).collect()}
    assert got == {1: (True, True, "none"), 2: (True, True, "none"), 3: (True, True, "none"), 4: (False, False, "none"), 5: (False, False, "none"),
                   6: (False, False, "none"), 7: (False, False, "none"), 8: (True, True, "high")}


def test_numbers_of_any_length(spark):
    from privtrace.functions import text as tx
    rows = [("188000", "188,000"), ("7", "7"), ("1234567", "1,234,567"), ("007000", "7,000"), ("9" * 45, ",".join(["999"] * 15)), ("0", "0")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "v string").select("v", tx.thousands("v").alias("t"))
    assert {r.v: r.t for r in df.collect()} == dict(rows)


def test_cached_verdicts(spark):
    from privtrace.operators.detect import cached_verdicts, judge_dedupe
    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "event_id long, cache_key string")
    cache = spark.createDataFrame([("a", "{}")], "cache_key string, verdict string")
    assert {r.event_id: r.verdict for r in cached_verdicts(req, cache).collect()} == {1: "{}", 2: "{}", 3: None}
    assert [r.cache_key for r in judge_dedupe(req, cache).collect()] == ["b"]


def test_useful_answers(spark):
    from privtrace.operators.utility import useful
    red = "redacted " * 4
    rows = {"short": False, "a plain answer that is long enough": True, "I Cannot do this, whatever you may say": False,
            "x" * 50 + " cannot, but said too late to count": True, "well, [ERROR] " + "x" * 40: False,
            red + "x" * 30: False, red + "x" * 65: True, "redacted " * 3 + "x" * 30: True}
    df = spark.createDataFrame([(a,) for a in rows], "t string").select("t", useful("t").alias("u"))
    assert {r.t: r.u for r in df.collect()} == rows
