"""Queries: reshaping."""
from pyspark.sql import functions as F

from ..operators import reshape as op
from ..functions import text as tx
from . import query
from . import views as v
from .views import with_views as sql


def nested_traces(spark, d):
    """Trace documents with three channel messages per document of text."""
    m = lambda c, s, t, x: F.struct(F.lit(c).alias("channel"), F.lit(s).alias("source"), F.lit(t).alias("target"), x.alias("content"))
    return v.events(spark, d).select(
        F.col("event_id").alias("trace_id"), "scenario_id", F.array(
            m("C2", "coordinator", "worker", F.concat(F.lit("handle: "), "text")),
            m("C5", "worker", "memory", op.memory_event_text("text")),
            m("C1", "coordinator", "user", F.col("text"))).alias("channel_messages"))


NESTED = """SELECT event_id AS trace_id, scenario_id, 0 AS msg_idx, 'C2' AS channel, 'coordinator' AS source, 'handle: ' || text AS content FROM hv_event
 UNION ALL SELECT event_id, scenario_id, 1, 'C5', 'worker', 'Cache: ' || substring(text, 1, 300) FROM hv_event
 UNION ALL SELECT event_id, scenario_id, 2, 'C1', 'coordinator', text FROM hv_event"""


@query("explode_messages", "P1 P14", sql("hv_event", f"SELECT trace_id, msg_idx, channel, source, md5(content) AS content_md5 FROM ({NESTED})"))
def _(spark, d):
    return op.explode_messages(nested_traces(spark, d)).select("trace_id", "msg_idx", "channel", "source", F.md5("content").alias("content_md5"))


@query("derive_log_event", "P14", sql("hv_event", """SELECT event_id, md5('INFO [AgentExecutor]: Step Execution' || chr(10) || 'Timestamp: ' || model || chr(10) ||
 'Agent: primary_agent' || chr(10) || 'Execution Trace:' || chr(10) || text || chr(10)) AS log_md5 FROM hv_event"""))
def _(spark, d):
    return v.events(spark, d).select("event_id", F.md5(op.log_event_text("text", stamp=F.col("model"))).alias("log_md5"))


@query("vault_long_indexed", "P2", sql("hv_vault", """SELECT scenario_id, record_idx, field, value,
 field || CASE WHEN rn = 1 THEN '' ELSE '_' || CAST(rn - 1 AS VARCHAR) END AS field_key,
 last_value(field) OVER (PARTITION BY scenario_id, lower(value) ORDER BY record_idx, field ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS name_of_value
 FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, field ORDER BY record_idx, value) AS rn FROM hv_vault)"""))
def _(spark, d):
    return op.vault_long_indexed(v.vault_table(spark, d)).select("scenario_id", "record_idx", "field", "value", "field_key", "name_of_value")


@query("vault_long_last_wins", "P3", sql("hv_vault", """SELECT scenario_id, field, value, record_idx FROM (SELECT *,
 row_number() OVER (PARTITION BY scenario_id, field ORDER BY record_idx DESC, value DESC) AS rn FROM hv_vault) WHERE rn = 1"""))
def _(spark, d):
    return op.vault_long_last_wins(v.vault(spark, d)).select("scenario_id", "field", "value", "record_idx")


def wide_events(spark, d):
    """Events with tool and memory parts, taken from the columns of a conversation turn."""
    t = F.col("turn")
    return v.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("event_id"), F.when(F.col("role") != "system", F.col("text")).alias("content"),
        F.when(F.col("role") == "assistant", F.col("role")).alias("tool_args"), F.when(t % 2 == 0, F.concat("text", "role")).alias("tool_output"),
        F.when(t % 3 == 0, "").otherwise(F.col("role")).alias("memory_value"), "role")


@query("all_content", "P4", """WITH w AS (SELECT conv_id * 1000 + turn AS event_id, role, text, turn FROM conversations)
SELECT event_id, 'content' AS part, md5(text) AS text_md5 FROM w WHERE role <> 'system' AND length(text) > 0
UNION ALL SELECT event_id, 'tool_args', md5(role) FROM w WHERE role = 'assistant'
UNION ALL SELECT event_id, 'tool_output', md5(text || role) FROM w WHERE turn % 2 = 0
UNION ALL SELECT event_id, 'memory_value', md5(role) FROM w WHERE turn % 3 <> 0""")
def _(spark, d):
    return op.all_content(wide_events(spark, d)).select("event_id", "part", F.md5("text").alias("text_md5"))


@query("channel_events", "P10", """SELECT conv_id * 1000 + turn AS event_id, CASE role WHEN 'user' THEN 'C1' WHEN 'assistant' THEN 'C2' ELSE 'C1' END AS channel,
 md5(CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN text ELSE role || text END) AS text_md5 FROM conversations WHERE NOT (turn % 3 = 1 AND text = '')""")
def _(spark, d):
    t = F.col("turn")
    e = v.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("event_id"),
        F.when(F.col("role") == "user", "final_output").when(F.col("role") == "assistant", "C2_inter_agent").otherwise("odd").alias("channel"),
        F.when(t % 3 == 0, F.col("role")).otherwise("").alias("content"), F.when(t % 3 == 1, F.col("text")).alias("message"),
        F.when(t % 3 == 2, F.concat("role", "text")).alias("data"))
    return op.channel_events(e).select("event_id", "channel", F.md5("text").alias("text_md5"))


@query("filter_events", "P5", """SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id", "event_type", "value")
    return op.filter_events(e, types=["click", "purchase"])


SCEN = """SELECT o_orderkey AS scenario_id, 1 + o_orderkey % 3 AS n_agents, 'A' || CAST(o_custkey % 3 AS VARCHAR) AS adversary_level,
 CASE o_custkey % 4 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'legal' ELSE 'corporate' END AS vertical,
 o_orderkey % 5 AS n_tools FROM orders"""


def scenarios(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table(spark, d, "orders").select(
        o.alias("scenario_id"), F.sequence(F.lit(1), (1 + o % 3).cast("int")).alias("agents"),
        F.concat(F.lit("A"), (c % 3).cast("string")).alias("adversary_level"),
        F.when(c % 4 == 0, "healthcare").when(c % 4 == 1, "finance").when(c % 4 == 2, "legal").otherwise("corporate").alias("vertical"),
        F.slice(F.array(*[F.lit(f"tool{i}") for i in range(4)]), F.lit(1), (o % 5).cast("int")).alias("tools"))


@query("filter_scenarios", "P6", f"""SELECT scenario_id, vertical, adversary_level, adversary_level <> 'A0' AS is_adversarial, least(n_tools, 4) AS tool_count
 FROM ({SCEN}) WHERE n_agents > 1 AND vertical = 'healthcare'""")
def _(spark, d):
    return op.filter_scenarios(scenarios(spark, d), vertical="healthcare", multi_agent=True).select(
        "scenario_id", "vertical", "adversary_level", "is_adversarial", "tool_count")


@query("extract_canaries", "P7", sql("hv_vault hv_doc", """SELECT DISTINCT scenario_id, canary FROM (
 SELECT scenario_id, value AS canary FROM hv_vault WHERE contains(value, 'CANARY_') UNION ALL SELECT source, max(canary) FROM hv_doc GROUP BY source)"""))
def _(spark, d):
    listed = v.table(spark, d, "documents").groupBy(F.col("source").alias("scenario_id")).agg(F.max(v._canary(F.col("doc_id"))).alias("canary"))
    return op.extract_canaries(v.vault(spark, d), listed)


@query("sensitive_values", "P8", sql("hv_vault", "SELECT scenario_id, value FROM hv_vault WHERE value IS NOT NULL"))
def _(spark, d):
    return op.sensitive_values(v.vault(spark, d))


@query("is_allowed", "P9", """SELECT o_orderkey, o_orderstatus, (o_orderstatus <> 'P' AND (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_custkey % 2 = 0))) AS allowed FROM orders""")
def _(spark, d):
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    allow = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("F"), F.lit("O"), F.lit("P"))).otherwise(F.array(F.lit("F")))
    return o.select("o_orderkey", "o_orderstatus", tx.is_allowed("o_orderstatus", allow, F.array(F.lit("P"))).alias("allowed"))


@query("normalize_channel", "P11", """SELECT event_type, channel, count(*) AS n FROM (SELECT event_type,
 CASE event_type WHEN 'view' THEN 'C1' WHEN 'click' THEN 'C2' WHEN 'error' THEN 'C6' WHEN 'purchase' THEN 'C7' ELSE 'C1' END AS channel FROM events) GROUP BY 1, 2""")
def _(spark, d):
    e = F.col("event_type")
    raw = (F.when(e == "view", "C1_final_output").when(e == "click", "inter_agent").when(e == "error", "c6_LOG")
           .when(e == "purchase", "C7").otherwise("somewhere"))
    return v.table(spark, d, "events").select("event_type", tx.normalize_channel(raw).alias("channel")).groupBy("event_type", "channel").agg(
        F.count(F.lit(1)).alias("n"))


@query("apply_channel_config", "P12", sql("hv_live", """SELECT channel, CASE channel WHEN 'C2' THEN 0.25 WHEN 'C1' THEN 1.0 WHEN 'C5' THEN 0.7 ELSE 1.0 END::DOUBLE AS weight,
 count(*) AS events FROM hv_live WHERE channel <> 'C6' GROUP BY 1, 2"""))
def _(spark, d):
    e = op.apply_channel_config(v.live(spark, d), {"C6": (False, None), "C2": (True, 0.25)})
    return e.groupBy("channel", "weight").agg(F.count(F.lit(1)).alias("events"))


@query("split_react", "P13", """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN trim(role, ' ') ELSE role END) AS json_md5,
 length(CASE WHEN turn % 2 = 0 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') ELSE '' END) AS thought_len FROM conversations""")
def _(spark, d):
    c = v.table(spark, d, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("THOUGHT: "), "text", F.lit("\nJSON: "), "role")).otherwise(F.col("role"))
    thought, js = tx.split_react("raw")
    return c.withColumn("raw", raw).select("conv_id", "turn", F.md5(js).alias("json_md5"), F.length(thought).alias("thought_len"))


@query("preview", "P15", sql("hv_event", "SELECT event_id, md5(substring(text, 1, 200)) AS p200, md5(substring(text, 1, 50)) AS p50 FROM hv_event"))
def _(spark, d):
    return v.events(spark, d).select("event_id", F.md5(tx.preview("text", 200)).alias("p200"), F.md5(tx.preview("text", 50)).alias("p50"))


@query("parse_tags", "P16", """SELECT o_orderkey, 'A' || CAST(o_custkey % 3 AS VARCHAR) AS adversary, CAST(o_orderkey % 4 AS VARCHAR) AS records FROM orders""")
def _(spark, d):
    o = v.table(spark, d, "orders")
    tags = F.array(F.concat(F.lit("adversary:A"), (F.col("o_custkey") % 3).cast("string")),
                   F.concat(F.lit("records:"), (F.col("o_orderkey") % 4).cast("string")), F.lit("plain"))
    return o.select("o_orderkey", op.parse_tags(tags).alias("t")).select("o_orderkey", F.col("t.adversary"), F.col("t.records"))


@query("records_by_field_and_weight", "P17", sql("hv_vault", """SELECT scenario_id, record_idx, max(value) AS email, max(weight) AS weight FROM hv_vault
 WHERE field = 'email' GROUP BY 1, 2 HAVING max(weight) >= 0.5"""))
def _(spark, d):
    v_ = v.vault(spark, d)
    rec = v_.groupBy("scenario_id", "record_idx", "field").agg(F.max("value").alias("value"), F.max("weight").alias("w")).where(F.col("field") == "email")
    rec = rec.select("scenario_id", "record_idx", F.create_map("field", "value").alias("fields"), F.col("w").alias("sensitivity_weight"))
    out = op.records_by_sensitivity(op.records_with_field(rec, "email"), 0.5)
    return out.select("scenario_id", "record_idx", F.col("fields.email").alias("email"), F.col("sensitivity_weight").alias("weight"))


@query("render_template", "P18", """SELECT c_custkey, 'Does ' || c_name || ' (' || c_mktsegment || ') allow sending the balance to nation ' || CAST(c_nationkey AS VARCHAR) || '?' AS prompt FROM customer""")
def _(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", op.render_template(
        "Does {name} ({segment}) allow sending the balance to nation {nation}?", name="c_name", segment="c_mktsegment", nation="c_nationkey").alias("prompt"))
