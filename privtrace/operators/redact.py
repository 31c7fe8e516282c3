"""Redaction, blocking and access control."""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import channels as ch
from ..dims import defenses as df_
from ..functions import text as tx
from ..functions.patterns import Lowered, Machine, exact_literals
from ..functions.text import col
from .contain import ValueIndex
from .pii import FLAGS
from .sorted_runs import sorted_runs

#: Texts that a scan turns into Python strings at a time.
SLICE = 200


def sanitize(c, patterns=df_.SANITIZE_PATTERNS, token: str = df_.REDACTED) -> Column:
    """Replace every pattern in turn, on the running text."""
    safe = token.replace("\\", "\\\\").replace("$", "\\$")

    def step(t, pattern):
        needed = exact_literals(pattern)
        if not needed:
            return F.regexp_replace(t, pattern, safe)
        # the running text is named by the lambda, so that it is worked out once
        return F.transform(F.array(t), lambda x: F.when(tx.contains_any(x, needed), F.regexp_replace(x, pattern, safe)).otherwise(x))[0]
    return reduce(lambda t, p: step(t, p[1]), patterns, col(c))


def sanitize_hits(c, patterns=df_.SANITIZE_PATTERNS) -> Column:
    """Hits of all patterns, counted on the original text."""
    return reduce(lambda a, b: a + b, [F.regexp_count(col(c), F.lit(p)) for _, p in patterns])


def sanitize_patterns(add: dict | None = None, remove=()) -> list[tuple[str, str]]:
    """The default patterns with user patterns added or removed."""
    return [(n, p) for n, p in [*df_.SANITIZE_PATTERNS, *(add or {}).items()] if n not in set(remove)]


def sanitize_named(c, patterns=df_.NAMED_PATTERNS) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1].replace("$", "\\$")), patterns, col(c))


# --- spans --------------------------------------------------------------------

def replacement(entity, match, style: str = "placeholder", custom: str = "[REDACTED]") -> Column:
    e, m = col(entity), col(match)
    if style == "placeholder":
        return F.concat(F.lit("[REDACTED_"), e, F.lit("]"))
    if style == "asterisk":
        return F.repeat(F.lit("*"), F.length(m))
    if style == "masked":
        return F.when(F.length(m) > 4, F.concat(F.repeat(F.lit("X"), F.length(m) - 4), F.right(m, F.lit(4)))).otherwise(
            F.repeat(F.lit("X"), F.length(m)))
    if style == "hash":
        return F.concat(F.lit("[HASH:"), tx.sha_prefix(m, 8), F.lit("]"))
    if style == "category":
        return F.concat(F.lit("[PII: "), e, F.lit("]"))
    if style == "remove":
        return F.lit("")
    return F.lit(custom)


def resolve_overlaps(spans: DataFrame, key: str = "event_id") -> DataFrame:
    """Spans left after overlaps are settled: higher score, then longer, then earlier wins.

    Spans come sorted by that rule, one text after the other; a span stays if it
    touches none that stayed before. Those do not overlap, so a search among
    their starts finds the only two that could touch it.
    """
    rest = [c for c in spans.columns if c != key]
    at = {c: rest.index(c) for c in ("start", "end")}

    def start():
        starts: list[int] = []
        ends: list[int] = []

        def each(row):
            lo, hi = row[at["start"]], row[at["end"]]
            i = bisect_left(starts, hi)
            # of those that begin before its end, the last one ends last
            if i and ends[i - 1] > lo:
                return []
            starts.insert(i, lo)
            ends.insert(i, hi)
            return [row]
        return each

    order = [F.col("score").desc(), (F.col("start") - F.col("end")), "start", *[c for c in rest if c not in ("score", "start", "end")]]
    schema = T.StructType([spans.schema[c] for c in rest])
    return sorted_runs(spans, [key], order, schema, start).select(*[c for c in (key, *rest)])


def redact_spans(events: DataFrame, spans: DataFrame, style: str = "placeholder", key: str = "event_id",
                 entities=None, out: str = "redacted") -> DataFrame:
    """Texts with their spans replaced; overlaps are settled first, so no offset goes stale."""
    chosen = spans.where(F.col("entity").isin(list(entities))) if entities else spans
    clean = resolve_overlaps(chosen.select(key, "entity", "score", "match", "start", "end").distinct(), key)
    cuts = clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", replacement("entity", "match", style).alias("rep")))).alias("cuts"),
        F.count(F.lit(1)).alias("redactions"))
    joined = events.join(cuts, key, "left")
    # pieces between the cuts, joined with the replacements
    init = F.struct(F.lit("").alias("s"), F.lit(0).alias("p"))
    text = F.col("text")
    step = lambda a, c: F.struct(
        F.concat(a["s"], F.substring(text, a["p"] + 1, c["start"] - a["p"]), c["rep"]).alias("s"), c["end"].alias("p"))
    done = F.aggregate("cuts", init, step, lambda a: F.concat(a["s"], F.substring(text, a["p"] + 1, F.length(text))))
    return joined.withColumn(out, F.when(F.col("cuts").isNull(), text).otherwise(done)).withColumn(
        "redactions", F.coalesce("redactions", F.lit(0))).drop("cuts")


def redact_scan(events: DataFrame, recognizers, style: str = "placeholder", flags: str = FLAGS, custom: str = "[REDACTED]",
                text: str = "text") -> DataFrame:
    """Find, settle overlaps and replace in one pass over the texts: no span leaves its row, no text is shuffled.

    Adds ``redacted``, ``redactions``, ``confidence`` (highest score found, null when clean) and ``entities``
    (distinct, last span first). The rules are those of ``resolve_overlaps`` and ``redact_spans``.
    """
    schema = T.StructType(list(events.schema.fields) + [
        T.StructField("redacted", T.StringType()), T.StructField("redactions", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("entities", T.ArrayType(T.StringType()))])
    table = list(recognizers)
    make = _REPLACE.get(style, lambda e, m: custom)

    def one(t, machines):
        low = Lowered(t.lower())
        spans = [(-s, h.start() - h.end(), h.start(), h.end(), e, h.group()) for e, s, m in machines for h in m.finditer(t, low)]
        if not spans:
            return t, 0, None, []
        starts, kept = [], []
        for sp in sorted(spans):
            i = bisect_left(starts, sp[3])
            if i == 0 or kept[i - 1][3] <= sp[2]:
                starts.insert(i, sp[2])
                kept.insert(i, sp)
        parts, pos = [], 0
        for sp in kept:
            parts += [t[pos:sp[2]], make(sp[4], sp[5])]
            pos = sp[3]
        order = list(dict.fromkeys(e for _, e in sorted(((-sp[2], sp[4]) for sp in spans))))
        return "".join(parts) + t[pos:], len(kept), -min(sp[0] for sp in spans), order

    def scan(batches):
        machines = [(e, float(s), Machine(p, flags)) for e, _, p, s in table]
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string())]
        for batch in batches:
            # a slice at a time: a task never holds a second copy of a batch of long texts
            for at in range(0, max(1, batch.num_rows), SLICE):
                b = batch.slice(at, SLICE)
                rows = [one(t, machines) if t else (t, 0, None, []) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                made = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)
                del rows, made, b
                pa.default_memory_pool().release_unused()

    return events.mapInArrow(scan, schema)


_REPLACE = {
    "placeholder": lambda e, m: f"[REDACTED_{e}]",
    "asterisk": lambda e, m: "*" * len(m),
    "masked": lambda e, m: "X" * (len(m) - 4) + m[-4:] if len(m) > 4 else "X" * len(m),
    "hash": lambda e, m: f"[HASH:{hashlib.sha256(m.encode()).hexdigest()[:8]}]",
    "category": lambda e, m: f"[PII: {e}]",
    "remove": lambda e, m: "",
}


def redact_values(events: DataFrame, leaks: DataFrame, tag: str = "[REDACTED]", key: str = "event_id",
                  by_field: bool = False) -> DataFrame:
    """Replace the leaked vault values of each event verbatim, longest first."""
    # by_field names the field in the mark
    rep = F.concat(F.lit("["), F.upper("field"), F.lit(" REDACTED]")) if by_field else F.lit(tag)
    vals = leaks.select(key, F.col("value"), rep.alias("rep")).distinct().groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "rep"))).alias("vals"))
    done = F.aggregate("vals", F.col("text"), lambda t, v: F.replace(t, v["value"], v["rep"]))
    return events.join(vals, key, "left").withColumn(
        "redacted", F.when(F.col("vals").isNull(), F.col("text")).otherwise(done)).drop("vals")


def redact_vault(events: DataFrame, vault: DataFrame, on=("scenario_id",), tag: str = "[REDACTED]", min_len: int = 4) -> DataFrame:
    """Replace every vault value that stands in a text, longest first."""
    on = list(on)
    v = vault.where(F.length("value") >= min_len)
    hits = ValueIndex(v, on, case_sensitive=True).hits(events).select("event_id", F.col("__v").alias("value"))
    return redact_values(events, hits, tag)


# --- decisions ------------------------------------------------------------------

def severity(entity) -> Column:
    e = col(entity)
    return F.when(e.isin(df_.HIGH_SEVERITY), "high").when(e.isin(df_.MEDIUM_SEVERITY), "medium").otherwise("low")


def block_high_severity(events: DataFrame, spans: DataFrame, key: str = "event_id") -> DataFrame:
    """Adds ``blocked`` and the entity that caused it (first by offset)."""
    high = spans.where(severity("entity") == "high").groupBy(key).agg(F.min_by("entity", F.struct("start", "entity")).alias("block_entity"))
    return events.join(high, key, "left").withColumn("blocked", F.col("block_entity").isNotNull())


def scope_channels(channel, internal: bool = True, external: bool = True, monitored=None) -> Column:
    """Is this channel under protection?"""
    c = col(channel)
    if monitored is not None:
        return c.isin(list(monitored))
    return F.when(c.isin(ch.INTERNAL), internal).when(c.isin(ch.EXTERNAL), external).otherwise(True)


def decide_action(blocked, redactions, protected=None) -> Column:
    b, r = col(blocked), col(redactions)
    act = F.when(b, "block").when(r > 0, "redact").otherwise("allow")
    return act if protected is None else F.when(col(protected), act).otherwise("allow")


def apply_defense(text, filtered, action) -> Column:
    """Text as it is recorded after the defence acted (before detection sees it)."""
    a = col(action)
    return F.when(a == "block", df_.BLOCKED_TEXT).when(a == "redact", F.coalesce(col(filtered), col(text))).otherwise(col(text))


def defend(events: DataFrame, recognizers, style="placeholder", block: bool = False, internal=True, external=True,
           flags: str = FLAGS) -> DataFrame:
    """Redact, block and decide for each event in one pass: action, final text, confidence."""
    red = redact_scan(events, recognizers, style, flags)
    worst = F.get(F.filter("entities", lambda e: e.isin(df_.HIGH_SEVERITY)), F.lit(0))
    out = red.withColumns({"block_entity": worst if block else F.lit(None).cast("string"),
                           "protected": scope_channels("channel", internal, external)})
    return out.withColumn("blocked", F.col("block_entity").isNotNull()).withColumns({
        "confidence": F.when(F.col("protected"), F.coalesce("confidence", F.lit(0.0))).otherwise(1.0),
        "action": decide_action("blocked", "redactions", "protected"),
    }).withColumn("final_text", apply_defense("text", "redacted", "action"))


def check_acl(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``reason``; unknown agents pass, the first failing rule gives the reason.

    messages: message_id, source, target, entities (array); profiles: agent_id,
    can_send_to, can_receive_from, denied_entities, allowed_entities (arrays; empty = no rule).
    """
    s = profiles.select(F.col("agent_id").alias("source"), F.col("can_send_to").alias("__send"))
    t = profiles.select(F.col("agent_id").alias("target"), F.col("can_receive_from").alias("__recv"),
                        F.col("denied_entities").alias("__deny"), F.col("allowed_entities").alias("__allow"))
    m = messages.join(s, "source", "left").join(t, "target", "left")
    has = lambda a: F.size(F.coalesce(F.col(a), F.array().cast("array<string>"))) > 0
    known = F.col("__send").isNotNull() & F.col("__recv").isNotNull()
    bad = F.filter("entities", lambda e: (
        (has("__deny") & F.array_contains("__deny", e)) | (has("__allow") & ~F.array_contains("__allow", e))))
    first_bad = F.get(bad, F.lit(0))
    reason = (
        F.when(~known, None)
        .when(has("__send") & ~F.array_contains("__send", F.col("target")),
              F.concat(F.lit("Agent "), "source", F.lit(" not authorized to send to "), "target"))
        .when(has("__recv") & ~F.array_contains("__recv", F.col("source")),
              F.concat(F.lit("Agent "), "target", F.lit(" not authorized to receive from "), "source"))
        .when(F.size(bad) > 0, F.when(has("__deny") & F.array_contains("__deny", first_bad),
              F.concat(F.lit("Agent "), "target", F.lit(" denied access to "), first_bad)).otherwise(
              F.concat(F.lit("Agent "), "target", F.lit(" not authorized for "), first_bad)))
    )
    return m.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("__send", "__recv", "__deny", "__allow")


def filter_messages(messages: DataFrame, recognizers, profiles: DataFrame, block_high: bool = False, flags: str = FLAGS) -> DataFrame:
    """Inter-agent messages (text, source, target): redact, check access, block by severity."""
    out = check_acl(redact_scan(messages, recognizers, flags=flags), profiles)
    if block_high:
        worst = F.get(F.filter("entities", lambda e: e.isin(df_.HIGH_SEVERITY)), F.lit(0))
        out = out.withColumn("__w", F.when(F.col("allowed"), worst)).withColumns({
            "reason": F.coalesce("reason", F.concat(F.lit("High severity PII ("), "__w", F.lit(") blocked"))),
            "allowed": F.col("allowed") & F.col("__w").isNull()}).drop("__w")
    return out.withColumn("filtered", F.when(F.col("allowed"), F.col("redacted")).otherwise(df_.BLOCKED_MESSAGE))


def filter_memory(memory: DataFrame, recognizers, flags: str = FLAGS) -> DataFrame:
    """Memory writes and reads by key, redacted."""
    return redact_scan(memory, recognizers, flags=flags).withColumn("changed", F.col("redactions") > 0)


def guardrail_decision(df: DataFrame, valid: str = "is_valid", original="text", sanitized="sanitized", risk="risk_score") -> DataFrame:
    action = F.when(~F.col(valid) & (F.col(sanitized) != F.col(original)), "redact").when(~F.col(valid), "block").otherwise("allow")
    return df.withColumn("action", action).withColumn("confidence", F.col(risk))


def defense_stats(decisions: DataFrame, by=()) -> DataFrame:
    """Totals and rates by action, mean confidence and latency."""
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_checks"),
        *[F.count_if(F.col("action") == a).alias(n) for a, n in (("block", "blocked"), ("redact", "redacted"), ("allow", "allowed"))],
        F.avg("confidence").alias("avg_confidence"), F.avg("latency_ms").alias("avg_latency_ms"),
    ).withColumns({"block_rate": tx.rate("blocked", "total_checks"), "redaction_rate": tx.rate("redacted", "total_checks")})


def entity_distribution(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def defense_effectiveness(tests: DataFrame, baseline: str = "vanilla") -> DataFrame:
    """Leak rate per defence and channel, and the drop relative to the undefended baseline.

    tests: defense, channel, blocked.
    """
    per = tests.groupBy("defense", "channel").agg(F.count(F.lit(1)).alias("n"), (F.avg((~F.col("blocked")).cast("int")) * 100).alias("leak_rate"))
    w = Window.partitionBy("channel")  # a handful of aggregated rows per channel
    base = F.max(F.when(F.col("defense") == baseline, F.col("leak_rate"))).over(w)
    return per.withColumn("base_rate", base).withColumn(
        "effectiveness", F.when(F.col("base_rate") > 0, (F.col("base_rate") - F.col("leak_rate")) / F.col("base_rate") * 100).otherwise(0.0))


def expected_leaks_after_defense(leaks_by_family: DataFrame, defenses: DataFrame) -> DataFrame:
    """Defence catalogue x observed leaks by (family, channel): leaks a defence covers and is expected to stop."""
    long = defenses.select("defense_id", "category", "strategy", "latency_ms", "fpr", F.explode("channels").alias("channel"),
                           F.col("effectiveness"))
    long = long.select("defense_id", "category", "strategy", "latency_ms", "fpr", "channel",
                       F.explode("effectiveness").alias("family", "effect"))
    j = leaks_by_family.join(long, ["family", "channel"])
    return j.groupBy("defense_id", "category", "strategy").agg(
        F.sum("leaks").alias("covered_leaks"), F.sum(F.col("leaks") * F.col("effect")).alias("stopped_leaks"),
        F.max("latency_ms").alias("latency_ms"), F.max("fpr").alias("fpr"))


def mitigate(events: DataFrame, leaks: DataFrame, pre_patterns=df_.SANITIZE_PATTERNS) -> DataFrame:
    """Chain: values replaced first, then the pattern filter; flags tell what acted."""
    out = redact_values(events, leaks)
    final = sanitize("redacted", pre_patterns)
    return out.withColumn("final_text", final).withColumns({
        "value_filtered": F.col("redacted") != F.col("text"), "pattern_filtered": F.col("final_text") != F.col("redacted")})
