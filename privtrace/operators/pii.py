"""PII recognition: spans of text that look like personal data."""
from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import false_positives as fp
from ..dims import fields as fl
from ..dims import recognizers as rz
from ..functions import text as tx
from ..functions.patterns import gated_sql, scanner, sql_text
from ..functions.text import col

FLAGS = "(?ims)"
#: Patterns that one compiled expression holds.
PATTERNS_PER_STEP = 28


def find_spans(
    events: DataFrame,
    recognizers=None,
    threshold: float = fl.SPAN_THRESHOLD,
    offsets: bool = False,
    flags: str = FLAGS,
    text: str = "text",
) -> DataFrame:
    """Event columns (without the text) with (entity, pattern_no, score, match[, start, end]).

    ``recognizers`` is a list of (entity, pattern_no, pattern, score); by default
    the catalogue. All patterns run in one pass over the texts: an Arrow-batched
    scan for offsets and, of ASCII texts, for the catalogue; else inside the JVM.
    """
    table = [r for r in (rz.flat() if recognizers is None else recognizers) if r[3] >= threshold]
    keep = [c for c in events.columns if c != text]
    if offsets:
        return _offset_spans(events, table, flags, text, keep)
    low, hits = _with_hits(events, table, flags, text, recognizers is None)
    return low.select(*keep, F.inline(hits))


HITS = "array<struct<entity:string,pattern_no:int,score:double,match:string>>"


def _with_hits(events: DataFrame, table, flags: str, text: str, scanned: bool) -> tuple[DataFrame, Column]:
    """Events, and an expression over them: the array of (entity, pattern_no, score, match) of each text.

    A long list is ``scanned``: where a pattern can begin is told by words, which
    expressions of the JVM cannot remember. Beyond ASCII the two engines differ in
    case and borders, so such texts stay in the JVM.
    """
    if not scanned or not table:
        return events.withColumn("__low", F.lower(text)), _hits(table, flags, text)

    # values, so that an executor needs no more than this package
    patterns, named = tuple(r[2] for r in table), [(e, int(i), float(s)) for e, i, _, s in table]

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        each = scanner(patterns, flags).finditer
        out = []
        for t in texts:
            t = t.as_py()
            out.append(None if t is None else [
                {"entity": named[k][0], "pattern_no": named[k][1], "score": named[k][2], "match": hit.group()} for k, hit in each(t)])
        kind = pa.struct([("entity", pa.string()), ("pattern_no", pa.int32()), ("score", pa.float64()), ("match", pa.string())])
        return pa.array(out, pa.list_(kind))

    ascii_ = F.octet_length(text) == F.length(text)
    low = events.withColumn("__low", F.when(~ascii_, F.lower(text))).withColumn("__found", scan(F.when(ascii_, F.col(text))))
    return low, F.coalesce("__found", F.when(~ascii_, _hits(table, flags, text)))


def _hits(table, flags: str, text: str) -> Column:
    """Array of (entity, pattern_no, score, match) of one text; needs the lower-cased text in ``__low``.

    One SQL text instead of a tree of Column calls: the plan is the same, but
    hundreds of calls into the JVM are saved.
    """
    arms = []
    for entity, no, pattern, score in table:
        found = gated_sql(pattern, "__low", f"regexp_extract_all({text}, {sql_text(flags + pattern)}, 0)", "cast(array() AS array<string>)")
        arms.append(f"transform({found}, m -> named_struct('entity', {sql_text(entity)}, 'pattern_no', {int(no)}, "
                    f"'score', {float(score)}D, 'match', m))")
    return F.expr(f"flatten(array({', '.join(arms)}))")


def analyze(events: DataFrame, recognizers=None, threshold: float = fl.SPAN_THRESHOLD, flags: str = FLAGS, text: str = "text",
            context_rules: bool = True) -> DataFrame:
    """Recognition with both false-positive filters in one pass: the context rules see the text in its own row,
    so neither a join nor a shuffle is needed, and only surviving spans leave the row."""
    table = [r for r in (rz.flat() if recognizers is None else recognizers) if r[3] >= threshold]
    keep = [c for c in events.columns if c != text]

    def real(h):
        bad = is_false_positive(h["entity"], h["match"])
        if context_rules:
            bad = bad | is_context_false_positive(h["entity"], h["match"], text)
        return ~bad
    low, hits = _with_hits(events, table, flags, text, recognizers is None)
    return low.select(*keep, F.inline(F.filter(hits, real)))


def _offset_spans(events: DataFrame, table, flags: str, text: str, keep) -> DataFrame:
    schema = T.StructType([events.schema[c] for c in keep] + [
        T.StructField("entity", T.StringType()), T.StructField("pattern_no", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("match", T.StringType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def scan(batches):
        each = scanner(tuple(r[2] for r in table), flags).finditer
        for pdf in batches:
            rows, found = [], []
            for r, t in enumerate(pdf[text]):
                if t:
                    for k, hit in each(t):
                        e, i, _, s = table[k]
                        rows.append(r)
                        found.append((e, i, float(s), hit.group(), hit.start(), hit.end()))
            if rows:
                out = pdf.iloc[rows][keep].reset_index(drop=True)
                extra = pd.DataFrame(found, columns=["entity", "pattern_no", "score", "match", "start", "end"])
                yield pd.concat([out, extra], axis=1)

    return events.select(*keep, text).mapInPandas(scan, schema)


_CHECKS = {"luhn": tx.luhn_ok, "iban": tx.iban_ok, "octets": tx.octets_ok}


def general_spans(events: DataFrame, threshold: float = 0.0, text: str = "text") -> DataFrame:
    """E-mail, card, IBAN, SSN, IP, URL and ISO date, with checksum and range tests."""
    table = [(e, 0, p, s) for e, p, s, _ in rz.GENERAL]
    spans = find_spans(events, table, threshold, flags="", text=text)
    ok = reduce(lambda a, x: a | x, [
        (F.col("entity") == e) & (_CHECKS[v](F.col("match")) if v else F.lit(True)) for e, _, _, v in rz.GENERAL])
    return spans.where(ok)


def recognizer_counts(events: DataFrame, recognizers=None, flags: str = "", text: str = "text") -> DataFrame:
    """Matches per recognizer pattern: counted per text, then summed; no span leaves its row."""
    table = rz.flat() if recognizers is None else recognizers
    groups = []
    for first in range(0, len(table), PATTERNS_PER_STEP):
        arms = []
        for e, i, p, s in table[first:first + PATTERNS_PER_STEP]:
            n = gated_sql(p, "__low", f"regexp_count({text}, {sql_text(flags + p)})", "0")
            arms.append(f"named_struct('entity', {sql_text(e)}, 'pattern_no', {int(i)}, 'score', {float(s)}D, 'n', cast({n} AS bigint))")
        groups.append(f"filter(array({', '.join(arms)}), x -> x.n > 0)")
    low = events.select(text, F.lower(text).alias("__low"))
    # one generator per group of patterns: a single expression over all of them is too long to be compiled
    counts = None
    for g in groups:
        part = low.select(F.inline(F.expr(g))).groupBy("entity", "pattern_no", "score").agg(
            F.sum("n").alias("matches"), F.count(F.lit(1)).alias("texts"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


def context_boost(spans: DataFrame, events: DataFrame, k: int = 30, boost: float = 0.35, on: str = "event_id") -> DataFrame:
    """Raise a span's score when a context word of its entity stands within ``k`` characters."""
    words = {e: w for e, w in rz.context_words().items() if w}
    near = F.lower(F.substring("__ctx", F.greatest(F.lit(1), F.col("start") + 1 - k),
                               F.col("end") - F.col("start") + k + F.least(F.lit(k), F.col("start"))))
    hit = reduce(lambda a, x: a | x, [
        (F.col("entity") == e) & tx.contains_any("__near", [w.lower() for w in ws]) for e, ws in words.items()])
    out = spans.join(events.select(on, F.col("text").alias("__ctx")), on).withColumn("__near", near)
    return out.withColumn("boosted", hit).withColumn(
        "score", F.when(F.col("boosted"), F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score"))
    ).drop("__ctx", "__near")


def is_false_positive(entity, match) -> Column:
    """Exact, prefix, contains and number-range rules per entity."""
    e, low = col(entity), F.lower(tx.strip(match))
    tests = []
    for name, rules in fp.FALSE_POSITIVES.items():
        hit = F.lit(False)
        if rules.get("exact"):
            hit = hit | low.isin(rules["exact"])
        if rules.get("prefix"):
            hit = hit | tx.starts_with_any(low, rules["prefix"])
        if rules.get("contains"):
            hit = hit | tx.contains_any(low, rules["contains"])
        if name == "DATE_TIME":
            lo, hi = fp.DATE_NUMBER_RANGE
            number = F.when(tx.is_digits(match), F.try_to_number(col(match), F.lit("9" * 18)))
            hit = hit | F.coalesce(number.between(lo, hi), F.lit(False))
        tests.append((e == name) & hit)
    return reduce(lambda a, b: a | b, tests)


def fp_filter(spans: DataFrame) -> DataFrame:
    return spans.where(~is_false_positive("entity", "match"))


def is_context_false_positive(entity, match, text) -> Column:
    """Scheduling dates and log words that look like people, judged by the text around them."""
    e, m, content = col(entity), col(match), F.lower(col(text))
    low = F.lower(tx.strip(m))
    date = F.regexp_extract(low, r"\d{4}-\d{2}-\d{2}", 0)
    at = F.position(date, content)
    before = F.substring(content, F.greatest(F.lit(1), at - fp.CONTEXT_CHARS), F.least(F.lit(fp.CONTEXT_CHARS), at - 1))
    inside = at > 1
    is_date = (e == "DATE_TIME") & (F.length(date) > 0)
    date_fp = F.when(inside & tx.contains_any(before, fp.BIRTH_WORDS), False).when(
        inside & tx.contains_any(before, fp.API_WORDS), True
    ).otherwise(tx.contains_any(content, fp.API_WORDS) & ~tx.contains_any(content, fp.BIRTH_WORDS))
    first_word = F.regexp_extract(low, r"^(\S+)", 1)
    person_fp = tx.contains_any(content, fp.LOG_WORDS) & (
        low.isin(fp.GENERIC_ACTORS) | first_word.isin(fp.GENERIC_ACTORS) | low.isin(fp.SYSTEM_PHRASES))
    return F.when(is_date, date_fp).when(e == "PERSON", person_fp).otherwise(False)


def fp_context_filter(spans: DataFrame, events: DataFrame, on: str = "event_id") -> DataFrame:
    # only spans that the rules can drop need their text
    risky = F.col("entity").isin("DATE_TIME", "PERSON")
    tested = spans.where(risky).join(events.select(on, F.col("text").alias("__ctx")), on).where(
        ~is_context_false_positive("entity", "match", "__ctx")).drop("__ctx")
    return spans.where(~risky).unionByName(tested)


def tag_vault(spans: DataFrame, vault: DataFrame, canaries: DataFrame | None = None) -> DataFrame:
    """Add ``is_canary`` and ``vault_field``: the first vault field whose value holds the match."""
    from ..session import cut
    from .contain import contains_join
    spans = cut(spans, "spans")  # read twice below; the texts are scanned once
    holders = vault.where(F.length("value") > 0).select(
        "scenario_id", "record_idx", "field", F.col("value").alias("text"),
        F.concat_ws("|", "record_idx", "field", "value").alias("event_id"))
    needle = spans.select("scenario_id", F.col("match").alias("value"), F.col("match")).distinct()
    first = contains_join(holders, needle, ["scenario_id"], case_sensitive=True).groupBy(
        "scenario_id", "match").agg(F.min_by("field", F.struct("record_idx", "field")).alias("vault_field"))
    out = spans.join(first, ["scenario_id", "match"], "left")
    if canaries is None:
        canaries = vault.where(F.startswith("value", F.lit(fl.CANARY_PREFIX))).select("scenario_id", F.col("value").alias("canary"))
    known = canaries.select("scenario_id", F.col("canary").alias("match")).distinct().withColumn("__c", F.lit(True))
    return out.join(known, ["scenario_id", "match"], "left").withColumn(
        "is_canary", F.coalesce("__c", F.lit(False))).drop("__c")


def quick_scan(events: DataFrame, text: str = "text") -> DataFrame:
    """Four quick patterns over a text, case ignored."""
    return find_spans(events, [(n, 0, p, 1.0) for n, p in fl.QUICK_PATTERNS], 0.0, flags="(?i)", text=text)


def entity_coverage(spans: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected type: texts that should show it, and texts where a detected type name agrees.

    Names agree when one is part of the other, case ignored.
    """
    detected = spans.groupBy("event_id").agg(F.collect_set(F.lower("entity")).alias("seen"))
    e = expected.select("event_id", F.lower("expected").alias("expected")).distinct()
    hit = F.coalesce(F.exists("seen", lambda s: F.contains(s, F.col("expected")) | F.contains(F.col("expected"), s)), F.lit(False))
    return (e.join(detected, "event_id", "left").withColumn("hit", hit)
            .groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"))
            .withColumn("coverage", tx.rate("found", "n")))


def pii_profile(spans: DataFrame, by=("vertical",)) -> DataFrame:
    return spans.groupBy(*by, "entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match").alias("distinct_values"))
