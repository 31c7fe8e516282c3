"""Domain views derived from the given tables, for Spark and as SQL text.

The tables are not agent logs; plain arithmetic turns them into scenarios,
vaults, events, leaks, traces, agents, messages, points and tasks. The SQL twin
of a view is the text under the same name in ``SQL``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import attacks as at
from ..dims import channels as ch
from ..session import cut

# --- values of the views ------------------------------------------------------
ACCENTS = "[À-ÖØ-öø-ɏ]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
# -------------------------------------------------------------------------------


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. A session that reads single small files may ask to have texts spread over its cores."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    spread = int(spark.conf.get("spark.privtrace.spreadTexts", "0"))
    return df.repartition(spread) if spread and name in TEXT_TABLES else df


def sql_values(rows, columns: str, name: str) -> str:
    def lit(x):
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(lit(y) for y in x) + "]"
        return repr(x)
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def case_map(expr: str, pairs: dict, default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {default} END"


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (and those they use) as common tables."""
    order: list[str] = []

    def need(n):
        if n in order:
            return
        for m in SQL:
            if m != n and m in SQL[n].replace("(", " ").replace(")", " ").replace(",", " ").split():
                need(m)
        order.append(n)
    for n in names.split():
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body


SQL: dict[str, str] = {}

# --- events of agent traffic -----------------------------------------------------

def _ssn(i):
    s = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", s(100 + i % 800, 3), s(10 + i % 90, 2), s((i * 7919) % 10000, 4))


def _canary(i):
    return F.concat(F.lit("CANARY_SSN_"), F.upper(F.substring(F.md5(i.cast("string")), 1, 8)))


def _salary(i):
    return (40000 + (i * 37) % 460000).cast("string")


def _card(i):
    return F.concat(F.lit("4111-1111-1111-"), F.lpad((i % 10000).cast("string"), 4, "0"))


SQL["hv_doc"] = """SELECT doc_id, source, lang, text,
 lpad(CAST(100 + doc_id % 800 AS VARCHAR), 3, '0') || '-' || lpad(CAST(10 + doc_id % 90 AS VARCHAR), 2, '0') || '-' ||
 lpad(CAST((doc_id * 7919) % 10000 AS VARCHAR), 4, '0') AS ssn,
 'CANARY_SSN_' || upper(substring(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS canary,
 40000 + (doc_id * 37) % 460000 AS salary,
 '4111-1111-1111-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS card
 FROM documents"""
SQL["hv_event"] = """SELECT source AS scenario_id, doc_id AS event_id, 'C' || CAST(1 + doc_id % 7 AS VARCHAR) AS channel,
 CASE lang WHEN 'en' THEN 'healthcare' WHEN 'fr' THEN 'finance' WHEN 'de' THEN 'legal' WHEN 'es' THEN 'corporate' ELSE 'other' END AS vertical,
 'm' || CAST(doc_id % 5 AS VARCHAR) AS model,
 text || CASE doc_id % 5 WHEN 0 THEN ' SSN ' || ssn || '.' WHEN 1 THEN ' token ' || canary || ' noted'
  WHEN 2 THEN ' salary: $' || CAST(salary // 1000 AS VARCHAR) || ',' || lpad(CAST(salary % 1000 AS VARCHAR), 3, '0') || ' offered'
  WHEN 3 THEN ' card ' || card ELSE ' patient has nothing to add' END AS text
 FROM hv_doc"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """One event per document; the text ends with a secret of the document (four of five kinds)."""
    i = F.col("doc_id")
    sal = (40000 + (i * 37) % 460000)
    money = F.concat(F.floor(sal / 1000).cast("string"), F.lit(","), F.lpad((sal % 1000).cast("string"), 3, "0"))
    tail = (F.when(i % 5 == 0, F.concat(F.lit(" SSN "), _ssn(i), F.lit(".")))
            .when(i % 5 == 1, F.concat(F.lit(" token "), _canary(i), F.lit(" noted")))
            .when(i % 5 == 2, F.concat(F.lit(" salary: $"), money, F.lit(" offered")))
            .when(i % 5 == 3, F.concat(F.lit(" card "), _card(i))).otherwise(" patient has nothing to add"))
    vertical = (F.when(F.col("lang") == "en", "healthcare").when(F.col("lang") == "fr", "finance")
                .when(F.col("lang") == "de", "legal").when(F.col("lang") == "es", "corporate").otherwise("other"))
    return table(spark, d, "documents").select(
        F.col("source").alias("scenario_id"), i.alias("event_id"), F.concat(F.lit("C"), (1 + i % 7).cast("string")).alias("channel"),
        vertical.alias("vertical"), F.concat(F.lit("m"), (i % 5).cast("string")).alias("model"),
        F.concat("text", tail).alias("text"))


SQL["hv_event_ascii"] = f"""SELECT scenario_id, event_id, channel, vertical, model,
 regexp_replace(text, '{ACCENTS}', 'e', 'g') AS text FROM hv_event"""


def events_ascii(spark, d) -> DataFrame:
    """The same whole texts with accented letters folded: word borders then mean the same to every regex engine."""
    # a text of as many bytes as characters has no accent
    plain = F.octet_length("text") == F.length("text")
    return events(spark, d).withColumn("text", F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", ACCENTS, "e")))


SQL["hv_vault"] = f"""SELECT * FROM (
 SELECT source AS scenario_id, doc_id AS record_idx, 'ssn' AS field, ssn AS value, 'realistic' AS tier, CAST(1.0 AS DOUBLE) AS weight
 FROM hv_doc WHERE doc_id % 5 IN (0, 4)
 UNION ALL SELECT source, doc_id, 'confidential_notes', canary, 'obvious', 0.9 FROM hv_doc WHERE doc_id % 5 = 1
 UNION ALL SELECT source, doc_id, 'salary', CAST(salary AS VARCHAR), 'realistic', 0.8 FROM hv_doc WHERE doc_id % 5 = 2
 UNION ALL SELECT source, doc_id, 'credit_card', card, 'realistic', 0.95 FROM hv_doc WHERE doc_id % 5 = 3
 UNION ALL SELECT source, doc_id, 'email', unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))), 'semantic', 0.5 FROM hv_doc
 UNION ALL SELECT source, doc_id, 'ip_number', unnest(list_distinct(regexp_extract_all(text, '{IPV4}'))), 'semantic', 0.6 FROM hv_doc)"""


def vault(spark, d) -> DataFrame:
    """(scenario_id, record_idx, field, value, tier, weight): the secrets, and e-mails and addresses found in the texts."""
    i = F.col("doc_id")
    def one(field, value, tier, weight, when):
        return F.when(when, F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(tier).alias("tier"), F.lit(weight).alias("weight")))
    def found(field, pattern, weight, sign):
        # only texts with the sign are searched; a null text stays one
        hits = F.when(~F.contains("text", F.lit(sign)), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return F.transform(F.array_distinct(hits), lambda v: F.struct(
            F.lit(field).alias("field"), v.alias("value"), F.lit("semantic").alias("tier"), F.lit(weight).alias("weight")))
    fixed = F.array_compact(F.array(
        one("ssn", _ssn(i), "realistic", 1.0, (i % 5).isin(0, 4)), one("confidential_notes", _canary(i), "obvious", 0.9, i % 5 == 1),
        one("salary", _salary(i), "realistic", 0.8, i % 5 == 2), one("credit_card", _card(i), "realistic", 0.95, i % 5 == 3)))
    every = F.concat(fixed, found("email", EMAIL, 0.5, "@"), found("ip_number", IPV4, 0.6, "."))
    return table(spark, d, "documents").select(F.col("source").alias("scenario_id"), i.alias("record_idx"), F.inline(every))


def vault_table(spark, d) -> DataFrame:
    """The same as a written table, for plans that read it more than once: the texts are searched once."""
    return cut(vault(spark, d), "vault")


SQL["hv_policy"] = """SELECT DISTINCT source AS scenario_id, 'email' AS field FROM documents WHERE CAST(substring(source, 4) AS BIGINT) % 2 = 0"""


def policy(spark, d) -> DataFrame:
    """E-mail addresses may be disclosed in the scenarios with an even number."""
    s = table(spark, d, "documents").select(F.col("source").alias("scenario_id")).distinct()
    return s.where(F.substring("scenario_id", 4, 18).cast("bigint") % 2 == 0).withColumn("field", F.lit("email"))


SQL["hv_request"] = """SELECT source AS scenario_id, 'Please check ' || min(ssn) || ' and ' || max(canary) AS request FROM hv_doc GROUP BY source"""


def requests(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").groupBy(F.col("source").alias("scenario_id")).agg(
        F.concat(F.lit("Please check "), F.min(_ssn(i)), F.lit(" and "), F.max(_canary(i))).alias("request"))


SQL["hv_shared_vault"] = "SELECT 'note_' || CAST(item_id AS VARCHAR) AS field, text AS value FROM benchmark"


def shared_vault(spark, d) -> DataFrame:
    """Whole benchmark passages as values of one vault shared by all traffic."""
    return table(spark, d, "benchmark").select(F.concat(F.lit("note_"), F.col("item_id").cast("string")).alias("field"), F.col("text").alias("value"))


# --- leaks ------------------------------------------------------------------------

SQL["hv_leak"] = """SELECT l_orderkey AS scenario_id, CAST(1992 + l_orderkey % 7 AS INTEGER) AS run, l_linenumber AS event_sequence,
 'C' || CAST(1 + l_suppkey % 7 AS VARCHAR) AS channel, 'f' || CAST(l_linenumber AS VARCHAR) AS field_path,
 'v' || CAST(l_partkey % 50 AS VARCHAR) AS leaked_value, least(1.0, l_discount * 10) AS confidence, l_tax + 0.5 AS sensitivity_weight,
 CASE WHEN l_quantity < 3 THEN NULL WHEN l_returnflag = 'R' THEN 'obvious' WHEN l_returnflag = 'A' THEN 'realistic' ELSE 'semantic' END AS canary_tier
 FROM lineitem"""


def leaks(spark, d) -> DataFrame:
    tier = (F.when(F.col("l_quantity") < 3, None).when(F.col("l_returnflag") == "R", "obvious")
            .when(F.col("l_returnflag") == "A", "realistic").otherwise("semantic"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scenario_id"), (1992 + F.col("l_orderkey") % 7).cast("int").alias("run"), F.col("l_linenumber").alias("event_sequence"),
        F.concat(F.lit("C"), (1 + F.col("l_suppkey") % 7).cast("string")).alias("channel"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_path"),
        F.concat(F.lit("v"), (F.col("l_partkey") % 50).cast("string")).alias("leaked_value"),
        F.least(F.lit(1.0), F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") + 0.5).alias("sensitivity_weight"),
        tier.alias("canary_tier"))


# --- traces -----------------------------------------------------------------------

SQL["dim_attack"] = sql_values(
    [(i, c, f, ch_, lv, c in at.METRIC_CLASSES) for i, (c, f, ch_, lv) in enumerate(at.ATTACKS)],
    "class_idx, attack_class, family, target_channels, level, in_metric_map", "t")
SQL["hv_trace"] = """SELECT o_orderkey AS trace_id, 'S' || CAST(o_orderkey AS VARCHAR) AS scenario_id,
 CASE o_custkey % 4 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'legal' ELSE 'corporate' END AS vertical,
 o_orderpriority AS model, attack_class, coalesce(family, 'A0') AS family, CAST(1992 + o_orderkey % 7 AS INTEGER) AS run,
 CAST(2 + o_orderkey % 3 AS INTEGER) AS n_agents,
 o_orderkey % 10 < 2 AS c1_leaked, o_orderkey % 7 < 4 AS c2_leaked, o_orderkey % 11 < 3 AS c3_leaked, o_custkey % 5 < 2 AS c5_leaked,
 o_custkey % 9 < 4 AS c6_leaked, o_orderkey % 13 < 4 AS single_leaked, (o_orderkey % 7 < 4 OR o_custkey % 5 < 2) AS multi_leaked,
 o_orderkey % 17 <> 0 AS is_multi_agent, o_orderkey % 3 <> 0 AS task_success,
 CAST(100 + o_orderkey % 900 AS BIGINT) AS tokens_prompt, CAST(50 + o_custkey % 300 AS BIGINT) AS tokens_completion,
 (o_orderkey % 1000) / 2.0 AS latency_ms
 FROM orders LEFT JOIN dim_attack ON class_idx = o_custkey % 40"""


def traces(spark, d) -> DataFrame:
    """One trace per order; eight of forty classes are missing, i.e. benign."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    dim = at.dim_attack(spark).select("class_idx", "attack_class", "family")
    vertical = F.when(c % 4 == 0, "healthcare").when(c % 4 == 1, "finance").when(c % 4 == 2, "legal").otherwise("corporate")
    t = table(spark, d, "orders").withColumn("class_idx", (c % 40).cast("int")).join(F.broadcast(dim), "class_idx", "left")
    return t.select(
        o.alias("trace_id"), F.concat(F.lit("S"), o.cast("string")).alias("scenario_id"), vertical.alias("vertical"),
        F.col("o_orderpriority").alias("model"), "attack_class", F.coalesce("family", F.lit("A0")).alias("family"),
        (1992 + o % 7).cast("int").alias("run"), (2 + o % 3).cast("int").alias("n_agents"),
        (o % 10 < 2).alias("c1_leaked"), (o % 7 < 4).alias("c2_leaked"), (o % 11 < 3).alias("c3_leaked"), (c % 5 < 2).alias("c5_leaked"),
        (c % 9 < 4).alias("c6_leaked"), (o % 13 < 4).alias("single_leaked"), ((o % 7 < 4) | (c % 5 < 2)).alias("multi_leaked"),
        (o % 17 != 0).alias("is_multi_agent"), (o % 3 != 0).alias("task_success"),
        (100 + o % 900).cast("bigint").alias("tokens_prompt"), (50 + c % 300).cast("bigint").alias("tokens_completion"),
        ((o % 1000) / 2.0).alias("latency_ms"))


SQL["hv_result"] = """SELECT *, (c1_leaked OR c2_leaked OR c5_leaked) AS leaked, (c2_leaked AND task_success) AS attack_success FROM hv_trace"""


def results(spark, d) -> DataFrame:
    return traces(spark, d).withColumns({
        "leaked": F.col("c1_leaked") | F.col("c2_leaked") | F.col("c5_leaked"),
        "attack_success": F.col("c2_leaked") & F.col("task_success")})


# --- agents and messages -----------------------------------------------------------

SQL["hv_agent"] = """SELECT CAST(s_suppkey // 5 AS BIGINT) AS scenario_id, s_suppkey AS agent_id, CAST(s_suppkey % 5 AS INTEGER) AS agent_pos,
 CASE (s_suppkey * 7 + s_nationkey) % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'confidential' ELSE 'secret' END AS clearance,
 CAST((s_suppkey * 7 + s_nationkey) % 4 AS INTEGER) AS lvl FROM supplier"""


def agents(spark, d) -> DataFrame:
    """Five agents per scenario."""
    k = F.col("s_suppkey")
    lvl = (k * 7 + F.col("s_nationkey")) % 4
    return table(spark, d, "supplier").select(
        F.floor(k / 5).alias("scenario_id"), k.alias("agent_id"), (k % 5).cast("int").alias("agent_pos"),
        F.when(lvl == 0, "public").when(lvl == 1, "restricted").when(lvl == 2, "confidential").otherwise("secret").alias("clearance"))


SQL["hv_msg"] = """SELECT CAST(l_suppkey // 5 AS BIGINT) AS scenario_id, l_orderkey * 10 + l_linenumber AS message_id, l_suppkey AS source,
 (l_suppkey // 5) * 5 + l_partkey % 6 AS target, l_orderkey % 1000 AS fp1, l_partkey % 700 AS fp2, l_shipdate AS ts FROM lineitem"""


def messages(spark, d) -> DataFrame:
    """Messages between agents; every sixth part points to an agent of another scenario."""
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.floor(s / 5).alias("scenario_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), s.alias("source"),
        (F.floor(s / 5) * 5 + F.col("l_partkey") % 6).alias("target"),
        F.array(F.concat(F.lit("a"), (F.col("l_orderkey") % 1000).cast("string")),
                F.concat(F.lit("b"), (F.col("l_partkey") % 700).cast("string"))).alias("fingerprints"))


# --- points, tasks, stream ----------------------------------------------------------

SQL["hv_point"] = """SELECT p_brand AS grp, p_partkey AS name, CAST((p_partkey * 7919) % 997 AS DOUBLE) / 997.0 AS cost,
 CAST((p_partkey * 31 + p_size * 17) % 101 AS DOUBLE) / 101.0 AS utility FROM part"""


def points(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("grp"), k.alias("name"), (((k * 7919) % 997).cast("double") / 997.0).alias("cost"),
        (((k * 31 + F.col("p_size") * 17) % 101).cast("double") / 101.0).alias("utility"))


TAILS = {
    0: " I cannot share this, it is confidential and protected by privacy rules.",
    1: " I can't do that.",
    2: " The patient has an allergy; an appointment is scheduled and we recommend a follow-up.",
    3: " The dispute was approved, balance $1,200.50, transfer limit reached.",
    4: " Dear counsel, the case status is filed, no conflict.",
    5: " The employee review and expense report were submitted.",
    6: "",
}
CRITERIA = {
    "healthcare": ["allergy_noted", "appointment_set", "recommendation", "referral_letter", "diagnosis_status", "tone"],
    "finance": ["risk_assessment", "dispute_summary", "balance_statement", "limit_policy", "tone"],
    "legal": ["draft_letter", "conflict_check", "status_update", "document_summary", "tone"],
    "corporate": ["employee_directory", "performance_review", "expense_report", "tone"],
    "other": ["first", "second"],
}
VERTICALS = ["healthcare", "finance", "legal", "corporate", "other"]
SQL["hv_task"] = (
    "SELECT conv_id * 1000 + turn AS task_id, CASE (conv_id + turn) % 5 "
    + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERTICALS[:-1])) + " ELSE 'other' END AS vertical, "
    "text || CASE (conv_id + turn * 3) % 7 " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in TAILS.items() if k < 6)
    + " ELSE '' END AS output, CASE (conv_id + turn) % 5 "
    + " ".join(f"WHEN {i} THEN {CRITERIA[v]!r}" for i, v in enumerate(VERTICALS[:-1])) + f" ELSE {CRITERIA['other']!r} END AS criteria, "
    "CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn % 3 - 1 AS INTEGER) END AS tool_calls FROM conversations")


def tasks(spark, d) -> DataFrame:
    """One task per turn; the output ends with a phrase that some rule looks for."""
    k, t = F.col("conv_id"), F.col("turn")
    def pick(expr, values):
        out = None
        for i, v in values:
            out = F.when(expr == i, v) if out is None else out.when(expr == i, v)
        return out
    vert = pick((k + t) % 5, list(enumerate(VERTICALS)))
    crit = pick((k + t) % 5, [(i, F.array(*[F.lit(c) for c in CRITERIA[v]])) for i, v in enumerate(VERTICALS)])
    tail = pick((k + t * 3) % 7, list(TAILS.items()))
    return table(spark, d, "conversations").select(
        (k * 1000 + t).alias("task_id"), vert.alias("vertical"), F.concat("text", tail).alias("output"), crit.alias("criteria"),
        F.when(t % 3 == 0, None).otherwise((t % 3 - 1).cast("int")).alias("tool_calls"))


SQL["hv_live"] = """SELECT event_id, user_id AS scenario_id, user_id AS agent_id, ts, 'fw' || CAST(user_id % 4 AS VARCHAR) AS framework,
 CASE event_type WHEN 'view' THEN 'C1' WHEN 'click' THEN 'C2' WHEN 'error' THEN 'C6' WHEN 'purchase' THEN 'C5' ELSE 'C7' END AS channel,
 value > 50 AS leaked, least(1.0, value / 100) AS confidence FROM events"""


def as_live(df: DataFrame) -> DataFrame:
    """Columns of a monitored message, for a table or a stream of events."""
    e = F.col("event_type")
    channel = F.when(e == "view", "C1").when(e == "click", "C2").when(e == "error", "C6").when(e == "purchase", "C5").otherwise("C7")
    return df.select("event_id", F.col("user_id").alias("scenario_id"), F.col("user_id").alias("agent_id"), "ts",
                     F.concat(F.lit("fw"), (F.col("user_id") % 4).cast("string")).alias("framework"), channel.alias("channel"),
                     (F.col("value") > 50).alias("leaked"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))


def live(spark, d) -> DataFrame:
    return as_live(table(spark, d, "events"))


def weight_sql(expr: str, profile: str) -> str:
    return case_map(expr, ch.WEIGHT_PROFILES[profile], str(ch.DEFAULT_WEIGHT[profile]))


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that summation order does not show."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])
