"""Queries: multi-agent flows."""
from pyspark.sql import functions as F

from ..operators import flows as op
from ..operators.reshape import extract_canaries
from . import query
from . import views as v
from .views import r6
from .views import with_views as sql

FLOWS = """SELECT m.scenario_id, m.message_id, m.source, m.target, unnest(['a' || fp1, 'b' || fp2]) AS fingerprint, s.lvl AS src_level, t.lvl AS dst_level, s.agent_pos AS src_pos, t.agent_pos AS dst_pos,
 t.lvl >= s.lvl AS authorized, s.lvl >= 2 AND t.lvl < 2 AS violation
 FROM hv_msg m JOIN hv_agent s ON s.scenario_id = m.scenario_id AND s.agent_id = m.source JOIN hv_agent t ON t.scenario_id = m.scenario_id AND t.agent_id = m.target"""


def flows(spark, d):
    return op.data_flows(v.messages(spark, d), v.agents(spark, d))


@query("data_flows", "M1 M3 M4", sql("hv_msg hv_agent", f"SELECT scenario_id, message_id, source, target, fingerprint, authorized, violation FROM ({FLOWS})"))
def _(spark, d):
    return flows(spark, d).select("scenario_id", "message_id", "source", "target", "fingerprint", "authorized", "violation")


@query("fingerprint", "M2", """SELECT c_custkey, substring(sha256('{"acct":' || CAST(c_nationkey AS VARCHAR) || ',"name":"' || c_name || '"}'), 1, 16) AS fp FROM customer""")
def _(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", op.fingerprint(F.to_json(F.struct(F.col("c_nationkey").alias("acct"), F.col("c_name").alias("name")))).alias("fp"))


@query("flow_authorized", "M3", sql("hv_msg hv_agent", f"SELECT src_level, dst_level, authorized, violation, count(*) AS n FROM ({FLOWS}) GROUP BY 1, 2, 3, 4"))
def _(spark, d):
    return flows(spark, d).groupBy("src_level", "dst_level", "authorized", "violation").agg(F.count(F.lit(1)).alias("n"))


@query("calr_cvr", "M5", sql("hv_msg hv_agent", f"""SELECT scenario_id, count(*) AS flows, round(avg(CASE WHEN authorized THEN 0 ELSE 1 END), 6) AS calr,
 round(avg(CASE WHEN violation THEN 1 ELSE 0 END), 6) AS cvr FROM ({FLOWS}) GROUP BY 1"""))
def _(spark, d):
    return r6(op.calr_cvr(flows(spark, d)))


@query("forbidden_flows", "M6", sql("hv_agent", "SELECT a.scenario_id, a.agent_id AS source, b.agent_id AS target FROM hv_agent a JOIN hv_agent b ON a.scenario_id = b.scenario_id AND a.agent_pos < b.agent_pos AND a.lvl > b.lvl"))
def _(spark, d):
    # the scenario record with its list of five agents
    s = v.agents(spark, d).groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("agent_pos", "agent_id", "clearance"))).alias("agents"))
    return op.forbidden_flows(s)


@query("protected_patterns", "M7", sql("hv_vault", "SELECT scenario_id, record_idx, field, substring(value, 1, 50) AS pattern FROM hv_vault WHERE contains(value, 'CANARY') OR weight > 0.5"))
def _(spark, d):
    return op.protected_patterns(v.vault(spark, d))


@query("match_tool_calls", "M8", """WITH e AS (SELECT l_suppkey AS agent_id, l_returnflag AS tool, l_linenumber AS arg, count(*) AS expected FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
 a AS (SELECT l_suppkey AS agent_id, l_returnflag AS tool, l_linenumber AS arg, count(*) AS actual FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3)
 SELECT e.agent_id, e.tool, e.arg, expected, coalesce(actual, 0) AS actual, least(expected, coalesce(actual, 0)) AS matched, greatest(0, expected - coalesce(actual, 0)) AS missing
 FROM e LEFT JOIN a USING (agent_id, tool, arg)""")
def _(spark, d):
    c = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("agent_id"), F.col("l_returnflag").alias("tool"), F.col("l_linenumber").alias("arg"), "l_linestatus")
    return op.match_tool_calls(c.where("l_linestatus = 'O'"), c.where("l_linestatus = 'F'"), ["arg"], by=("agent_id",))


@query("match_tool_calls_greedy", "M8")
def _(spark, d):
    """Expected calls name one or two arguments; an order's lines are the calls of one scenario."""
    li = v.table(spark, d, "lineitem")
    one = lambda k, c: F.create_map(F.lit(k), c.cast("string"))
    calls = li.select(F.col("l_orderkey").alias("scenario_id"), (F.col("l_suppkey") % 3).alias("agent_id"), F.col("l_returnflag").alias("tool"),
                      (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("call_no"), "l_linestatus", "l_linenumber",
                      F.map_concat(one("a", F.col("l_quantity") % 5), one("b", F.col("l_linenumber"))).alias("full"))
    exp = calls.where("l_linestatus = 'O'").select("scenario_id", "agent_id", "tool", "call_no", F.when(F.col("l_linenumber") % 2 == 0, F.map_filter("full", lambda k, x: k == "a")).otherwise(F.col("full")).alias("args"),
                                                  F.array(F.lit("b")).alias("dynamic"))
    act = calls.where("l_linestatus = 'F'").select("scenario_id", "agent_id", "tool", "call_no", F.col("full").alias("args"))
    return op.match_tool_calls_greedy(exp, act).groupBy("tool", "found").agg(F.count(F.lit(1)).alias("n"))


@query("forbidden_flow_issues", "M9", sql("hv_msg hv_agent", f"SELECT message_id, source, target, fingerprint FROM ({FLOWS}) WHERE src_pos < dst_pos AND src_level > dst_level"))
def _(spark, d):
    return op.forbidden_flow_issues(flows(spark, d)).select("message_id", "source", "target", "fingerprint")


PRE = "SELECT o_orderkey % 500 AS scenario_id, o_custkey AS key, max(o_orderstatus) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1, 2"
POST = "SELECT o_orderkey % 500 AS scenario_id, o_custkey AS key, max(o_orderstatus) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY 1, 2"
DIFF = f"""SELECT scenario_id, key, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM ({PRE}) a FULL JOIN ({POST}) b USING (scenario_id, key) WHERE a.value IS DISTINCT FROM b.value"""


def diff(spark, d):
    o = v.table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("scenario_id"), F.col("o_custkey").alias("key"), "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    snap = lambda cond: o.where(cond).groupBy("scenario_id", "key").agg(F.max("o_orderstatus").alias("value"))
    return op.state_diff(snap("day < date '1998-06-01'"), snap("day >= date '1996-06-01'"))


@query("state_diff", "M10", DIFF)
def _(spark, d):
    return diff(spark, d)


@query("canary_in_messages", "M11", sql("hv_event hv_vault", """SELECT e.event_id, c.value, contains(substring(e.text, 1, 200), c.value) AS in_preview, 'canary:' || substring(c.value, 1, 20) AS leaked_data_type
 FROM hv_event e JOIN (SELECT DISTINCT scenario_id, value FROM hv_vault WHERE contains(value, 'CANARY_')) c ON c.scenario_id = e.scenario_id AND contains(e.text, c.value)"""))
def _(spark, d):
    return op.canary_in_messages(v.events(spark, d), extract_canaries(v.vault_table(spark, d))).select("event_id", "value", "in_preview", "leaked_data_type")


@query("privacy_scores", "M12", sql("hv_msg hv_agent", f"""\n, f AS (SELECT scenario_id, source, count(*) FILTER (WHERE (NOT authorized OR violation) AND message_id % 40 = 0) AS leaks, count(*) FILTER (WHERE violation AND message_id % 90 = 0) AS violations,
 count(*) FILTER (WHERE src_pos < dst_pos AND src_level > dst_level AND message_id % 50 = 0) AS issues FROM ({FLOWS}) GROUP BY 1, 2)
 SELECT scenario_id, source, round(greatest(0, 1 - leaks * 0.2 - violations * 0.15 - (source % 3) * 0.1)::DOUBLE, 6) AS privacy_score, round(greatest(0, 1 - issues * 0.1)::DOUBLE, 6) AS task_score,
 greatest(0, 1 - leaks * 0.2 - violations * 0.15 - (source % 3) * 0.1) >= 0.8 AND greatest(0, 1 - issues * 0.1) >= 0.6 AND violations = 0 AS success FROM f"""))
def _(spark, d):
    f = flows(spark, d)
    m = F.col("message_id")
    per = f.groupBy("scenario_id", "source").agg(
        F.count_if((~F.col("authorized") | F.col("violation")) & (m % 40 == 0)).alias("leaks"), F.count_if(F.col("violation") & (m % 90 == 0)).alias("violations"),
        F.count_if(op.is_forbidden_flow() & (m % 50 == 0)).alias("issues")).withColumn("mutations", F.col("source") % 3)
    return r6(op.privacy_scores(per).select("scenario_id", "source", "privacy_score", "task_score", "success"))


@query("probing_accuracy", "M13", """SELECT scenario_id, count(*) AS levels, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy FROM (
 SELECT user_id AS scenario_id, CASE event_id % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'vignette' ELSE 'trajectory' END AS level, arg_max(value > 30, event_id) AS ok FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    i = F.col("event_id")
    p = v.table(spark, d, "events").select(F.col("user_id").alias("scenario_id"), i.alias("probe_id"), (F.col("value") > 30).alias("is_correct"),
                                           F.when(i % 3 == 0, "seed").when(i % 3 == 1, "vignette").otherwise("trajectory").alias("level"))
    return r6(op.probing_accuracy(p))


@query("seen_by_agent", "M14", sql("hv_msg", "SELECT DISTINCT source, fp2 FROM hv_msg m WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 350 = m.fp2)"))
def _(spark, d):
    m = v.messages(spark, d).select("source", F.element_at("fingerprints", 2).alias("fp")).distinct()
    seen = v.table(spark, d, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 350).cast("string")).alias("fp"))
    return op.seen_by_agent(m, seen, on=("fp",)).select("source", F.substring("fp", 2, 20).cast("bigint").alias("fp2"))


@query("agent_activity", "M15", sql("hv_msg hv_agent", """SELECT a.scenario_id, a.agent_id, coalesce(s.n, 0) AS sent, coalesce(r.n, 0) AS received, coalesce(c.n, 0) AS tool_calls FROM hv_agent a
 LEFT JOIN (SELECT scenario_id, source, count(*) AS n FROM hv_msg GROUP BY 1, 2) s ON s.scenario_id = a.scenario_id AND s.source = a.agent_id
 LEFT JOIN (SELECT scenario_id, target, count(*) AS n FROM hv_msg GROUP BY 1, 2) r ON r.scenario_id = a.scenario_id AND r.target = a.agent_id
 LEFT JOIN (SELECT scenario_id, source, count(*) AS n FROM hv_msg WHERE message_id % 10 < 3 GROUP BY 1, 2) c ON c.scenario_id = a.scenario_id AND c.source = a.agent_id"""))
def _(spark, d):
    m = v.messages(spark, d)
    calls = m.where(F.col("message_id") % 10 < 3).select("scenario_id", F.col("source").alias("agent_id"))
    return op.agent_activity(v.agents(spark, d), m, calls)
