"""Queries: redaction, blocking and access control."""
from pyspark.sql import functions as F

from ..dims import defenses as de
from ..dims import recognizers as rz
from ..operators import pii
from ..operators import redact as op
from . import query
from . import views as v
from .q_detect import leaks_of, LEAK_SQL
from .views import r6
from .views import with_views as sql


def _q(s):
    return s.replace("'", "''")


def sub_sql(expr, pairs):
    for p, t in pairs:
        expr = f"regexp_replace({expr}, '{_q(p)}', '{_q(t)}', 'g')"
    return expr


SAN = sub_sql("text", [(p, de.REDACTED) for _, p in de.SANITIZE_PATTERNS])
COUNT = " + ".join(f"len(regexp_extract_all(text, '{_q(p)}'))" for _, p in de.SANITIZE_PATTERNS)


@query("sanitize", "R1", sql("hv_event_ascii", f"SELECT event_id, md5({SAN}) AS sanitized_md5, {COUNT} AS hits FROM hv_event_ascii"))
def _(spark, d):
    return v.events_ascii(spark, d).select("event_id", F.md5(op.sanitize("text")).alias("sanitized_md5"), op.sanitize_hits("text").alias("hits"))


CUSTOM = [(n, p) for n, p in de.SANITIZE_PATTERNS if n != "email"] + [("money", r"\$\d+,\d+")]


@query("sanitize_custom", "R2", sql("hv_event_ascii", f"SELECT event_id, md5({sub_sql('text', [(p, '<hidden>') for _, p in CUSTOM])}) AS sanitized_md5 FROM hv_event_ascii"))
def _(spark, d):
    pats = op.sanitize_patterns(add={"money": r"\$\d+,\d+"}, remove=["email"])
    return v.events_ascii(spark, d).select("event_id", F.md5(op.sanitize("text", pats, "<hidden>")).alias("sanitized_md5"))


SSN_IP = [("US_SSN", 0, r"\b\d{3}-\d{2}-\d{4}\b", 0.85), ("IP_ADDRESS", 0, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95)]
OVERLAP = SSN_IP + [("ACCOUNT_NUMBER", 1, r"\b\d{8,12}\b", 0.4), ("CREDIT_CARD", 0, r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 1.0),
                    ("BUILDING_NUMBER", 0, r"\b\d{1,5}\b", 0.3)]


def spans(spark, d, table=SSN_IP):
    return pii.find_spans(v.events_ascii(spark, d), table, 0.0, offsets=True, flags="")


TWO = sub_sql(sub_sql("text", [(SSN_IP[0][2], "[REDACTED_US_SSN]")]), [(SSN_IP[1][2], "[REDACTED_IP_ADDRESS]")])


@query("redact_spans", "R3", sql("hv_event_ascii", f"SELECT event_id, md5({TWO}) AS redacted_md5, len(regexp_extract_all(text, '{SSN_IP[0][2]}')) + len(regexp_extract_all(text, '{SSN_IP[1][2]}')) AS redactions FROM hv_event_ascii"))
def _(spark, d):
    return op.redact_spans(v.events_ascii(spark, d), spans(spark, d)).select("event_id", F.md5("redacted").alias("redacted_md5"), "redactions")


@query("redact_scan", "R3 R4", sql("hv_event_ascii", f"SELECT event_id, md5({TWO}) AS redacted_md5, len(regexp_extract_all(text, '{SSN_IP[0][2]}')) + len(regexp_extract_all(text, '{SSN_IP[1][2]}')) AS redactions FROM hv_event_ascii"))
def _(spark, d):
    return op.redact_scan(v.events_ascii(spark, d), SSN_IP).select("event_id", F.md5("redacted").alias("redacted_md5"), "redactions")


@query("redact_styles", "R3", sql("hv_event_ascii", "\nUNION ALL ".join(
    f"SELECT event_id, '{st}' AS style, md5(regexp_replace(text, '{SSN_IP[0][2]}', '{rep}', 'g')) AS redacted_md5 FROM hv_event_ascii" for st, rep in
    [("asterisk", "***********"), ("category", "[PII: US_SSN]"), ("remove", "")])))
def _(spark, d):
    ev = v.events_ascii(spark, d)
    out = None
    for st in ("asterisk", "category", "remove"):
        x = op.redact_scan(ev, SSN_IP[:1], st).select("event_id", F.lit(st).alias("style"), F.md5("redacted").alias("redacted_md5"))
        out = x if out is None else out.unionByName(x)
    return out


@query("redact_masked_hash", "R3", sql("hv_doc", """SELECT doc_id AS event_id, 'XXXXXXX' || right(ssn, 4) AS masked, '[HASH:' || substring(sha256(ssn), 1, 8) || ']' AS hashed FROM hv_doc WHERE doc_id % 5 = 0"""))
def _(spark, d):
    s = spans(spark, d, SSN_IP[:1])
    return s.select("event_id", op.replacement("entity", "match", "masked").alias("masked"), op.replacement("entity", "match", "hash").alias("hashed"))


@query("resolve_overlaps", "R4")
def _(spark, d):
    """The whole catalogue, whatever the score; held against the greedy rule in the tests."""
    return op.resolve_overlaps(spans(spark, d, rz.flat())).groupBy("entity").agg(F.count(F.lit(1)).alias("kept"), F.sum("start").alias("offsets"))


@query("redact_catalogue", "R3 R4 R16")
def _(spark, d):
    """Every recognizer at once, overlaps settled; held against the greedy rule in the tests."""
    return op.redact_scan(v.events_ascii(spark, d), rz.flat()).select(
        "event_id", F.md5("redacted").alias("redacted_md5"), "redactions", "confidence", F.array_join("entities", ",").alias("entities"))


@query("defend_catalogue", "R8 R9 R10 R11 R13 R14")
def _(spark, d):
    """Decisions by the whole catalogue on all channels."""
    out = op.defend(v.events_ascii(spark, d), rz.flat(), block=True, internal=True, external=True)
    return out.select("event_id", "action", "confidence", F.md5("final_text").alias("final_md5"))


# all values found in a text, longest first, replaced one after the other
REPLACED = """, u AS (SELECT DISTINCT event_id, value FROM l), g AS (SELECT event_id, list(value ORDER BY length(value) DESC, value) AS vs FROM u GROUP BY 1)
 SELECT e.event_id, md5(CASE WHEN g.vs IS NULL THEN e.text ELSE list_reduce(list_prepend(e.text, g.vs), lambda t, x: replace(t, x, '[REDACTED]')) END) AS redacted_md5
 FROM hv_event e LEFT JOIN g ON e.event_id = g.event_id"""


@query("redact_values", "R5", sql("hv_event hv_vault hv_request hv_policy", f"""\n, l AS (SELECT event_id, value FROM ({LEAK_SQL})) {REPLACED}"""))
def _(spark, d):
    lk = leaks_of(spark, d).select("event_id", "value", "field")
    return op.redact_values(v.events(spark, d), lk).select("event_id", F.md5("redacted").alias("redacted_md5"))


@query("redact_vault", "R5", sql("hv_event hv_vault", f"""\n, l AS (SELECT e.event_id, v.value FROM hv_event e JOIN hv_vault v ON e.scenario_id = v.scenario_id
  AND length(v.value) >= 4 AND contains(e.text, v.value)) {REPLACED}"""))
def _(spark, d):
    return op.redact_vault(v.events(spark, d), v.vault_table(spark, d)).select("event_id", F.md5("redacted").alias("redacted_md5"))


@query("sanitize_named", "R6", sql("hv_event_ascii", f"SELECT event_id, md5({sub_sql('text', de.NAMED_PATTERNS)}) AS sanitized_md5 FROM hv_event_ascii"))
def _(spark, d):
    return v.events_ascii(spark, d).select("event_id", F.md5(op.sanitize_named("text")).alias("sanitized_md5"))


@query("severity", "R7", sql("hv_event_ascii", f"""SELECT severity, count(*) AS n FROM (SELECT 'high' AS severity, unnest(regexp_extract_all(text, '{SSN_IP[0][2]}')) FROM hv_event_ascii
 UNION ALL SELECT 'medium', unnest(regexp_extract_all(text, '{SSN_IP[1][2]}')) FROM hv_event_ascii UNION ALL SELECT 'low', unnest(regexp_extract_all(text, '\\b\\d{{8,12}}\\b')) FROM hv_event_ascii) GROUP BY 1"""))
def _(spark, d):
    s = pii.find_spans(v.events_ascii(spark, d), OVERLAP[:3], 0.0, flags="")
    return s.groupBy(op.severity("entity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("block_high_severity", "R8", sql("hv_event_ascii", f"SELECT event_id, regexp_matches(text, '{SSN_IP[0][2]}') AS blocked FROM hv_event_ascii"))
def _(spark, d):
    return op.block_high_severity(v.events_ascii(spark, d), spans(spark, d)).select("event_id", "blocked")


DECIDE = f"""SELECT event_id, channel, text, channel IN ('C2', 'C5') AS protected, regexp_matches(text, '{SSN_IP[0][2]}') AS ssn, regexp_matches(text, '{SSN_IP[1][2]}') AS ip, {TWO} AS red FROM hv_event_ascii"""
ACTION = "CASE WHEN NOT protected THEN 'allow' WHEN ssn THEN 'block' WHEN ip THEN 'redact' ELSE 'allow' END"
CONF = "CASE WHEN NOT protected THEN 1.0 WHEN ip THEN 0.95 WHEN ssn THEN 0.85 ELSE 0 END"


def decisions(spark, d):
    return op.defend(v.events_ascii(spark, d), SSN_IP, block=True, internal=True, external=False)


@query("decide_action", "R9 R10 R11", sql("hv_event_ascii", f"""SELECT event_id, {ACTION} AS action, CAST({CONF} AS DOUBLE) AS confidence,
 md5(CASE {ACTION} WHEN 'block' THEN '{de.BLOCKED_TEXT}' WHEN 'redact' THEN red ELSE text END) AS final_md5 FROM ({DECIDE})"""))
def _(spark, d):
    return decisions(spark, d).select("event_id", "action", "confidence", F.md5("final_text").alias("final_md5"))


@query("scope_channels", "R9", sql("hv_live", "SELECT channel, count(*) AS n, channel IN ('C2', 'C5') AS inside, channel IN ('C1', 'C6') AS monitored FROM hv_live GROUP BY 1"))
def _(spark, d):
    return v.live(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "inside": op.scope_channels("channel", True, False), "monitored": op.scope_channels("channel", monitored=["C1", "C6"])})


PROFILE = """SELECT n_nationkey AS agent, CASE WHEN n_nationkey % 3 = 0 THEN list_transform(range(0, 12), lambda x: x::BIGINT) ELSE [] END AS send,
 CASE WHEN n_nationkey % 4 = 1 THEN list_transform(range(5, 25), lambda x: x::BIGINT) ELSE [] END AS recv,
 CASE WHEN n_nationkey % 5 = 2 THEN ['US_SSN'] ELSE [] END AS deny, CASE WHEN n_nationkey % 7 = 3 THEN ['EMAIL'] ELSE [] END AS allow FROM nation"""
MSGS = """SELECT o_orderkey AS event_id, c_nationkey AS src, o_orderkey % 27 AS dst, CASE o_orderkey % 3 WHEN 0 THEN ['US_SSN'] WHEN 1 THEN ['EMAIL', 'US_SSN'] ELSE [] END AS ents
 FROM orders JOIN customer ON o_custkey = c_custkey"""
REASON = """CASE WHEN s.agent IS NULL OR t.agent IS NULL THEN NULL
 WHEN len(s.send) > 0 AND NOT list_contains(s.send, dst) THEN 'Agent ' || src || ' not authorized to send to ' || dst
 WHEN len(t.recv) > 0 AND NOT list_contains(t.recv, src) THEN 'Agent ' || dst || ' not authorized to receive from ' || src
 WHEN len(ents) > 0 AND ((list_contains(t.deny, ents[1])) OR (len(t.allow) > 0 AND NOT list_contains(t.allow, ents[1])))
  THEN CASE WHEN list_contains(t.deny, ents[1]) THEN 'Agent ' || dst || ' denied access to ' || ents[1] ELSE 'Agent ' || dst || ' not authorized for ' || ents[1] END
 WHEN len(ents) > 1 AND ((list_contains(t.deny, ents[2])) OR (len(t.allow) > 0 AND NOT list_contains(t.allow, ents[2])))
  THEN CASE WHEN list_contains(t.deny, ents[2]) THEN 'Agent ' || dst || ' denied access to ' || ents[2] ELSE 'Agent ' || dst || ' not authorized for ' || ents[2] END END"""


def profiles(spark, d):
    k = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    ids = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda x: x.cast("string"))
    return v.table(spark, d, "nation").select(
        k.cast("string").alias("agent_id"), F.when(k % 3 == 0, ids(0, 12)).otherwise(none).alias("can_send_to"),
        F.when(k % 4 == 1, ids(5, 25)).otherwise(none).alias("can_receive_from"),
        F.when(k % 5 == 2, F.array(F.lit("US_SSN"))).otherwise(none).alias("denied_entities"),
        F.when(k % 7 == 3, F.array(F.lit("EMAIL"))).otherwise(none).alias("allowed_entities"))


def agent_messages(spark, d):
    o, c = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("event_id"), F.col("c_nationkey").cast("string").alias("source"), (k % 27).cast("string").alias("target"),
        F.when(k % 3 == 0, F.array(F.lit("US_SSN"))).when(k % 3 == 1, F.array(F.lit("EMAIL"), F.lit("US_SSN"))).otherwise(F.array().cast("array<string>")).alias("entities"))


@query("check_acl", "R12", f"SELECT event_id, {REASON} AS reason, ({REASON}) IS NULL AS allowed FROM ({MSGS}) m LEFT JOIN ({PROFILE}) s ON s.agent = m.src LEFT JOIN ({PROFILE}) t ON t.agent = m.dst")
def _(spark, d):
    return op.check_acl(agent_messages(spark, d), profiles(spark, d)).select("event_id", "reason", "allowed")


@query("filter_messages", "R13", sql("hv_event_ascii", f"""\n, p AS ({PROFILE}), m AS (SELECT event_id, event_id % 25 AS src, (event_id * 3) % 25 AS dst, text, {TWO} AS red, regexp_matches(text, '{SSN_IP[0][2]}') AS ssn FROM hv_event_ascii)
 SELECT event_id, md5(CASE WHEN NOT blocked THEN red ELSE '[BLOCKED]' END) AS filtered_md5 FROM (SELECT m.*, ssn OR
  (len(s.send) > 0 AND NOT list_contains(s.send, dst)) OR (len(t.recv) > 0 AND NOT list_contains(t.recv, src)) OR
  (len(t.allow) > 0 AND (ssn OR regexp_matches(text, '{SSN_IP[1][2]}'))) AS blocked FROM m JOIN p s ON s.agent = src JOIN p t ON t.agent = dst)"""))
def _(spark, d):
    i = F.col("event_id")
    m = v.events_ascii(spark, d).select("event_id", (i % 25).cast("string").alias("source"), ((i * 3) % 25).cast("string").alias("target"), "text")
    return op.filter_messages(m, SSN_IP, profiles(spark, d), block_high=True).select("event_id", F.md5("filtered").alias("filtered_md5"))


@query("filter_memory", "R14", sql("hv_event_ascii", f"SELECT event_id, md5({TWO}) AS redacted_md5, {TWO} <> text AS changed FROM hv_event_ascii WHERE channel = 'C5'"))
def _(spark, d):
    mem = v.events_ascii(spark, d).where("channel = 'C5'")
    return op.filter_memory(mem, SSN_IP).select("event_id", F.md5("redacted").alias("redacted_md5"), "changed")


@query("guardrail_decision", "R15", sql("hv_event_ascii", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'allow' WHEN san <> text THEN 'redact' ELSE 'block' END AS action, (event_id % 10) / 10.0 AS confidence
 FROM (SELECT event_id, text, SAN AS san FROM hv_event_ascii)""".replace("SAN AS", SAN + " AS")))
def _(spark, d):
    e = v.events_ascii(spark, d).withColumns({"sanitized": op.sanitize("text"), "is_valid": F.col("event_id") % 4 == 0, "risk_score": (F.col("event_id") % 10) / 10.0})
    return op.guardrail_decision(e).select("event_id", "action", "confidence")


@query("defense_stats", "R16", sql("hv_event_ascii", f"""SELECT channel, count(*) AS total_checks, count(*) FILTER (WHERE a = 'block') AS blocked, count(*) FILTER (WHERE a = 'redact') AS redacted,
 count(*) FILTER (WHERE a = 'allow') AS allowed, round(avg(c), 6) AS avg_confidence, round(avg(event_id % 7), 6) AS avg_latency_ms, round(count(*) FILTER (WHERE a = 'block') / count(*), 6) AS block_rate,
 round(count(*) FILTER (WHERE a = 'redact') / count(*), 6) AS redaction_rate FROM (SELECT event_id, channel, {ACTION} AS a, CAST({CONF} AS DOUBLE) AS c FROM ({DECIDE})) GROUP BY 1"""))
def _(spark, d):
    return r6(op.defense_stats(decisions(spark, d).withColumn("latency_ms", (F.col("event_id") % 7).cast("double")), by=["channel"]))


@query("entity_distribution", "R16", sql("hv_event_ascii", f"""SELECT 'US_SSN' AS entity, sum(len(regexp_extract_all(text, '{SSN_IP[0][2]}')))::BIGINT AS n FROM hv_event_ascii
 UNION ALL SELECT 'IP_ADDRESS', sum(len(regexp_extract_all(text, '{SSN_IP[1][2]}')))::BIGINT FROM hv_event_ascii"""))
def _(spark, d):
    return op.entity_distribution(pii.find_spans(v.events_ascii(spark, d), SSN_IP, 0.0, flags=""))


@query("defense_effectiveness", "R17", """WITH t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'vanilla' WHEN 1 THEN 'sanitizer' WHEN 2 THEN 'prompt' ELSE 'roles' END AS defense,
 CASE WHEN o_custkey % 2 = 0 THEN 'C1' ELSE 'C2' END AS channel, (o_custkey * 7 + o_orderkey) % 10 < 2 + o_orderkey % 4 AS blocked FROM orders),
 g AS (SELECT defense, channel, count(*) AS n, avg(CASE WHEN blocked THEN 0 ELSE 1 END) * 100 AS r FROM t GROUP BY 1, 2)
 SELECT g.defense, g.channel, g.n, round(g.r, 6) AS leak_rate, round(b.r, 6) AS base_rate, round(CASE WHEN b.r > 0 THEN (b.r - g.r) / b.r * 100 ELSE 0 END, 6) AS effectiveness
 FROM g JOIN g b ON b.channel = g.channel AND b.defense = 'vanilla'""")
def _(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    t = v.table(spark, d, "orders").select(
        F.when(o % 4 == 0, "vanilla").when(o % 4 == 1, "sanitizer").when(o % 4 == 2, "prompt").otherwise("roles").alias("defense"),
        F.when(c % 2 == 0, "C1").otherwise("C2").alias("channel"), ((c * 7 + o) % 10 < 2 + o % 4).alias("blocked"))
    return r6(op.defense_effectiveness(t))


DEF = v.sql_values([(i, c, s, ch, fam, e, lat, fpr) for i, _, c, s, chs, eff, lat, fpr in de.DEFENSES for ch in chs for fam, e in zip(de.FAMILIES, eff)],
                   "defense_id, category, strategy, channel, family, effect, latency_ms, fpr", "dd")


@query("defense_catalogue", "R18", sql("hv_trace", f"""\n, dd AS ({DEF}), l AS (SELECT family, channel, count(*) FILTER (WHERE hit) AS leaks FROM (SELECT family, unnest(['C1', 'C2', 'C3', 'C5', 'C6']) AS channel,
 unnest([c1_leaked, c2_leaked, c3_leaked, c5_leaked, c6_leaked]) AS hit FROM hv_trace) GROUP BY 1, 2)
 SELECT defense_id, category, strategy, CAST(sum(leaks) AS BIGINT) AS covered_leaks, round(sum(leaks * effect)::DOUBLE, 6) AS stopped_leaks, max(latency_ms)::DOUBLE AS latency_ms, max(fpr)::DOUBLE AS fpr
 FROM dd JOIN l USING (family, channel) GROUP BY 1, 2, 3"""))
def _(spark, d):
    t = v.traces(spark, d)
    g = t.groupBy("family").agg(*[F.count_if(f"{c}_leaked").alias(c.upper()) for c in ("c1", "c2", "c3", "c5", "c6")])
    leaks = g.unpivot(["family"], ["C1", "C2", "C3", "C5", "C6"], "channel", "leaks")
    return r6(op.expected_leaks_after_defense(leaks, de.dim_defense(spark)))


@query("mitigate", "R19", sql("hv_event_ascii hv_vault", f"""\n, l AS (SELECT DISTINCT e.event_id, v.value FROM hv_event_ascii e JOIN hv_vault v ON e.scenario_id = v.scenario_id AND length(v.value) >= 4 AND contains(e.text, v.value)),
 g AS (SELECT event_id, list(value ORDER BY length(value) DESC, value) AS vs FROM l GROUP BY 1),
 m AS (SELECT e.event_id, e.text AS orig, CASE WHEN vs IS NULL THEN e.text ELSE list_reduce(list_prepend(e.text, vs), lambda t, x: replace(t, x, '[REDACTED]')) END AS text FROM hv_event_ascii e LEFT JOIN g ON e.event_id = g.event_id)
 SELECT event_id, md5({SAN}) AS final_md5, text <> orig AS value_filtered, {SAN} <> text AS pattern_filtered FROM m"""))
def _(spark, d):
    from ..operators.detect import leak_check
    ev = v.events_ascii(spark, d)
    # replaced is a value, whichever record holds it: without this, hits multiply with the records of an often-held value
    lk = leak_check(ev, v.vault_table(spark, d).dropDuplicates(["scenario_id", "value"]), case_sensitive=True)
    return op.mitigate(ev, lk).select("event_id", F.md5("final_text").alias("final_md5"), "value_filtered", "pattern_filtered")
