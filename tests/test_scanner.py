"""Catalogue scans: patterns are tried only where they can begin, and find what searching finds."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from privtrace.dims import recognizers as rz
from privtrace.functions.patterns import Lowered, Machine, Scanner, scanner
from privtrace.operators import detectors, pii

TEXTS = [
    "", " ", "pt-123456 PT-1234567 xPT-123456 _pt-123456 PT-654321PT-111111", "Dr. Mr.  mr.Dr. sdr. Smith MS. prof.",
    "1HGCM82633A004352 1hgcm82633a004352x ab12cde AB12CDEF 0x" + "aB" * 20, "salary: $52,300 salary $52,300 offered 52300 presalary: 99,000",
    "usd eur XUSD trying TRY try_ $ 5.00 €7 EUR 9 kr 12", "00:1a:2B:3c:4D:5e 00-1a-2B-3c-4D-5e-6f aa:bb", "+32 475 12 34 56 +1-800-555-0199",
    "terminated for cause; fired " + "x" * 80 + " suspended suspended", "CANARY_PERF_ABCD1234 canary_perf_abcd1234x CANARY_SSN_AB12CD34 CANARY_CANARY_SSN_AB12CD34",
    "Green City green  town City of GREEN County", "café Café 12 years old 170 cm 5'11\" 6 feet 2 inches", "ſalary: 52,300 K Mİ İstanbul Dr. é",
    "on at street: a b c lives at 12 Main Street, 12 North Main Street 5 Oak St.", "dm DM d.m. HIV hiv+ ms_ (MS)", "internal notes: " + "y" * 30 + "\nhr comment: 0123456789 ab",
]


def searched(patterns, flags, text):
    low = Lowered(text.lower())
    return sorted((i, m.start(), m.end()) for i, p in enumerate(patterns) for m in Machine(p, flags).finditer(text, low))


def test_the_scanner_finds_what_searching_finds():
    extra = [r"\bfoo(?=\sbar)\b", r"(?<=a)b", r"\b(?-i:usd)\b", r"", r"\ba|b\b", r"\b[a-c]?x", r"\b_\w+", r"aa"]
    for flags in ("(?ims)", "(?i)", ""):
        for patterns in ([r[2] for r in rz.flat()], [r[2] for r in rz.flat(0.85)], extra):
            scan = Scanner(patterns, flags)
            for text in [*TEXTS, "foo bar foo ab USD usd aaaa a ab b_x _y cx", " | ".join(t for t in TEXTS if t.isascii())]:
                for _ in range(2):  # the second time words are remembered
                    assert sorted((i, m.start(), m.end()) for i, m in scan.finditer(text)) == searched(patterns, flags, text), (flags, text)


def test_patterns_are_tried_only_where_they_can_begin():
    scan = Scanner([r"\b(?:USD|TRY|RON|CAD)\b", r"\bCAND-\d{5,6}\b", r"\b[A-HJ-NPR-Z0-9]{17}\b"], "(?ims)")
    tries = [0]

    class Counted:
        def __init__(self, compiled):
            self.compiled = compiled

        def match(self, text, at):
            tries[0] += 1
            return self.compiled.match(text, at)

        def finditer(self, text):
            tries[0] += len(text)
            return self.compiled.finditer(text)

    for machine in scan.machines:
        machine.compiled = Counted(machine.compiled)
    text = "country arcade candy iron candid " * 500 + "CAND-12345 try"
    assert [(i, m.group()) for i, m in scan.finditer(text)] in ([(0, "try"), (1, "CAND-12345")], [(1, "CAND-12345"), (0, "try")])
    assert tries[0] == 2


def test_known_words_stay_bounded(monkeypatch):
    from privtrace.functions import patterns
    monkeypatch.setattr(patterns, "WORDS_KNOWN", 10)
    scan = Scanner([r"\btry\b"], "(?i)")
    assert [m.start() for _, m in scan.finditer(" ".join(f"w{k} try" for k in range(50)))]
    assert len(scan.known) <= 10


def test_catalogue_spans_are_those_of_the_jvm(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (2, TEXTS[2]), (None, TEXTS[5])]
    df = spark.createDataFrame(rows, "event_id long, text string")
    cols = ["event_id", "entity", "pattern_no", "score", "match"]

    def got(d):
        return sorted(map(tuple, d.select(cols).collect()), key=repr)

    assert got(pii.find_spans(df)) == got(pii.find_spans(df, rz.flat()))
    assert got(pii.analyze(df)) == got(pii.analyze(df, rz.flat()))
    assert got(detectors.detect(df, ["catalogue"]).withColumn("pattern_no", F.lit(0))) == got(pii.find_spans(df, rz.flat()).withColumn("pattern_no", F.lit(0)))


def test_catalogue_scan_takes_ascii_texts_to_the_scanner(spark):
    df = spark.createDataFrame([(1, "salary: $52,300")], "event_id long, text string")
    plan = pii.find_spans(df)._jdf.queryExecution().toString()
    assert re.search("ArrowEvalPython", plan)
    assert scanner(("a",), "") is scanner(("a",), "")
