"""Texts scanned once, hits that do not multiply with records, gates that change no result."""
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from privtrace.dims import defenses as de
from privtrace.dims import fields as fl
from privtrace.functions.patterns import exact_literals
from privtrace.operators import detect, redact
from privtrace.plans import load, views

TEXTS = [None, "", "a@b.co", "call 555-123-4567 or 123-45-6789", "CANARY_SSN_ABCDEF12 canary_ssn_abcdef12", "x@y", "no sign at all",
         "DE12ABCDEFGHIJ345 sk-" + "a" * 32, "card 4111 1111 1111 1111 e11.9 and mz_" + "Z" * 24, "e11 only", "123456789", "é" * 3 + " 123-45-6789é"]


def test_tier_share_reads_the_waterfall_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    tiers = spark.createDataFrame([(1,), (1,), (2,), (None,)], "tier int").mapInArrow(count, "tier int")
    got = {r["tier"]: (r["leaks"], round(float(r["share_pct"]), 3)) for r in detect.tier_share(tiers).collect()}
    assert got == {1: (2, 66.667), 2: (1, 33.333)}
    assert seen.value == 4


def test_tier2_any_agrees_with_the_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for r in df.select("i", F.coalesce(detect.tier2_any("text"), F.lit(False)).alias("a"), (F.size(detect.tier2_pattern("text")) > 0).alias("b")).collect():
        assert r["a"] == r["b"], TEXTS[r["i"]]


def test_sanitize_agrees_with_plain_replacement(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    plain = F.col("text")
    for _, p in de.SANITIZE_PATTERNS:
        plain = F.regexp_replace(plain, p, de.REDACTED)
    for r in df.select(redact.sanitize("text").alias("a"), plain.alias("b")).collect():
        assert r["a"] == r["b"]


def test_exact_literals_keep_case_and_mind_flags():
    assert exact_literals("CANARY_[A-Z]+") == ("CANARY_",)
    assert exact_literals("(?i)CANARY_[A-Z]+") == ()
    assert exact_literals(r"(?:ab|cd)\d") == ("ab", "cd")
    assert all(exact_literals(p) == ("@",) for n, p in fl.TIER2_PATTERNS if n == "email")


@pytest.fixture
def repeated(tmp_path):
    text = ["mail a@b.example now", "mail a@b.example now", "mail a@b.example now", "Él mail a@b.example", None, "10.0.0.1 é"]
    docs = pd.DataFrame({"doc_id": range(4, 4 + 5 * len(text), 5), "text": text, "lang": "en", "source": "src1"})
    pq.write_table(pa.Table.from_pandas(docs), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_mitigate_hits_do_not_multiply_with_records(spark, repeated, monkeypatch):
    made, plain = [], detect.leak_check
    monkeypatch.setattr(detect, "leak_check", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    out = load()["mitigate"].run(spark, repeated).collect()
    assert len(out) == 6 and sum(bool(r["value_filtered"]) for r in out) == 5
    hits = [(r["event_id"], r["value"]) for r in made[0].collect()]
    assert len(hits) == len(set(hits))  # four records hold the address


def test_views_keep_nulls_and_accents(spark, repeated):
    assert [r["text"] for r in views.events_ascii(spark, repeated).orderBy("event_id").collect()][3:5] == ["el mail a@b.example patient has nothing to add", None]
    found = views.vault(spark, repeated).groupBy("field").count().collect()
    assert {r["field"]: r["count"] for r in found} == {"ssn": 5, "email": 4, "ip_number": 1}


def test_tier_waterfall_reads_the_vault_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    vault = spark.createDataFrame([("s", "secret value"), ("s", "other one")], "scenario_id string, value string")
    vault = vault.mapInArrow(count, "scenario_id string, value string")
    events = spark.createDataFrame([("s", 1, "a secret value"), ("s", 2, "nothing")], "scenario_id string, event_id long, text string")
    assert {r["event_id"]: r["tier"] for r in detect.tier_waterfall(events, vault).collect()} == {1: 1, 2: None}
    assert seen.value == 2
