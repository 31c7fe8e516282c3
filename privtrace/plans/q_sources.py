"""Queries: sources and sinks; each writes derived data to the work folder and reads it back."""
from pyspark.sql import functions as F

from ..operators import metrics as mx
from ..session import new_work_path
from ..sources import readers as rd
from ..sources import sinks as sk
from . import query
from . import views as v
from .q_metrics import GAP, RATES, C
from .views import r6
from .views import with_views as sql


def trace_docs(spark, d):
    """Trace documents: the text as output, its head as memory note, with results and token counts."""
    e = v.events(spark, d)
    m = lambda c, s, t, x: F.struct(F.lit(c).alias("channel"), F.lit(s).alias("source"), F.lit(t).alias("target"), x.alias("content"), F.lit(False).alias("has_leak"))
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("trace_"), i.cast("string")).alias("trace_id"), "scenario_id", "model", "vertical",
        F.array(m("C1", "coordinator", "user", F.col("text")), m("C2", "coordinator", "worker", F.concat(F.lit("do: "), "text"))).alias("channel_messages"),
        F.struct((i % 3 == 0).alias("c1_leaked"), (i % 2 == 0).alias("c2_leaked"), (i % 5 == 0).alias("c5_leaked")).alias("results"),
        F.struct(F.length("text").cast("bigint").alias("total_tokens")).alias("metrics"))


@query("read_traces", "S1", sql("hv_event", """SELECT vertical, count(*) AS traces, CAST(sum(2 * length(text) + 4) AS BIGINT) AS chars, count(*) FILTER (WHERE event_id % 3 = 0) AS c1, CAST(sum(length(text)) AS BIGINT) AS tokens FROM hv_event GROUP BY 1"""))
def _(spark, d):
    path = new_work_path(spark, "traces")
    trace_docs(spark, d).write.json(path)
    t = rd.read_traces(spark, path, one_per_file=False)
    chars = F.aggregate("channel_messages", F.lit(0), lambda s, m: s + F.length(m["content"]))
    return t.groupBy("vertical").agg(F.count(F.lit(1)).alias("traces"), F.sum(chars).alias("chars"), F.count_if("results.c1_leaked").alias("c1"), F.sum("metrics.total_tokens").alias("tokens"))


@query("read_scenarios", "S2", """SELECT CASE o_custkey % 2 WHEN 0 THEN 'legal' ELSE 'finance' END AS vertical, count(*) AS n, CAST(sum(1 + o_orderkey % 3) AS BIGINT) AS agents, count(DISTINCT o_orderpriority) AS values_ FROM orders GROUP BY 1""")
def _(spark, d):
    path = new_work_path(spark, "scenarios")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    v.table(spark, d, "orders").select(
        F.concat(F.lit("S"), o.cast("string")).alias("scenario_id"), F.when(c % 2 == 0, "legal").otherwise("finance").alias("vertical"),
        F.transform(F.sequence(F.lit(1), (1 + o % 3).cast("int")), lambda x: F.struct(x.cast("string").alias("agent_id"), F.lit("public").alias("clearance"))).alias("agents"),
        F.struct(F.array(F.struct(F.lit("order").alias("record_type"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("fields"),
                                  F.lit(0.5).alias("sensitivity_weight"))).alias("records")).alias("private_vault")).write.json(path)
    s = rd.read_scenarios(spark, path)
    return s.groupBy("vertical").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("agents")).alias("agents"),
                                     F.countDistinct(F.col("private_vault.records")[0]["fields"]["priority"]).alias("values_"))


@query("read_event_log", "S3", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1 UNION ALL SELECT 'metadata', count(DISTINCT user_id % 8), 8 FROM events")
def _(spark, d):
    path = new_work_path(spark, "eventlog")
    e = v.table(spark, d, "events")
    head = e.select((F.col("user_id") % 8).alias("b")).distinct().select("b", F.lit(0).alias("k"), F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("b").alias("bucket"))).alias("value"))
    body = e.select((F.col("user_id") % 8).alias("b"), F.lit(1).alias("k"), F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("scenario_id"), "event_type",
        F.col("props").alias("message_content"))).alias("value"))
    head.unionByName(body).repartition(8, "b").sortWithinPartitions("b", "k").select("value").write.text(path)
    meta, ev = rd.read_event_log(spark, path)
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("bigint")).alias("ids")).unionByName(
        meta.agg(F.lit("metadata").alias("event_type"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.element_at("metadata", "bucket")).alias("ids")))


@query("read_pair_traces", "S4", """SELECT channel, source, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT 'C2' AS channel, 'planner' AS source, o_orderpriority AS text FROM orders
 UNION ALL SELECT 'C5', CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0) GROUP BY 1, 2""")
def _(spark, d):
    path = new_work_path(spark, "pairs")
    k = F.col("o_orderkey")
    v.table(spark, d, "orders").select(
        F.concat(F.lit("S"), k.cast("string")).alias("scenario_id"), F.lit("crew").alias("framework"),
        F.struct(F.lit("planner").alias("from"), F.lit("worker").alias("to"), F.col("o_orderpriority").alias("message")).alias("channel_c2"),
        F.when(k % 3 > 0, F.struct(F.when(k % 2 == 0, "even").otherwise("odd").alias("agent"), F.lit("note").alias("memory_key"), F.col("o_orderstatus").alias("memory_value"))).alias("channel_c5")).write.json(path)
    return rd.read_pair_traces(spark, path).groupBy("channel", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


def annotated(spark, d):
    return v.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.col("text").alias("source_text"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("US_SSN"))).otherwise(F.array().cast("array<string>")).alias("expected_detections"))


def annotated_stats(df):
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("source_text")).alias("chars"), F.count_if(F.array_contains("expected_detections", "US_SSN")).alias("with_ssn"))


ANNOTATED = "SELECT lang AS category, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_ssn FROM documents GROUP BY 1"


@query("read_annotated", "S5", ANNOTATED)
def _(spark, d):
    path = new_work_path(spark, "annotated")
    annotated(spark, d).write.json(path)
    return annotated_stats(rd.read_annotated(spark, path, array_file=False))


@query("read_annotated_arrays", "S5", ANNOTATED)
def _(spark, d):
    """Pretty-printed files, each an array of the samples of 50 consecutive ids."""
    path = new_work_path(spark, "annotated-arrays")
    df = annotated(spark, d)
    files = df.groupBy(F.expr("bigint(id) div 50").alias("file")).agg(F.collect_list(F.struct(*df.columns)).alias("samples"))
    files.select("file", F.to_json("samples", {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    return annotated_stats(rd.read_annotated(spark, path))


def result_rows(spark, d):
    t = v.results(spark, d)
    chans = F.array_compact(F.array(*[F.when(F.col(f"{c}_leaked"), c.upper()) for c in ("c1", "c2", "c5")]))
    return t.select("scenario_id", "vertical", F.col("attack_class").alias("attack"), "task_success", "leaked", chans.alias("leak_channels"))


RESULT = """SELECT scenario_id, vertical, coalesce(attack_class, '') AS attack, task_success, leaked,
 array_to_string(list_filter([CASE WHEN c1_leaked THEN 'C1' END, CASE WHEN c2_leaked THEN 'C2' END, CASE WHEN c5_leaked THEN 'C5' END], lambda x: x IS NOT NULL), ',') AS leak_channels FROM hv_result"""


@query("results_projection", "S6", sql("hv_result", RESULT))
def _(spark, d):
    return sk.results_projection(result_rows(spark, d))


@query("write_results", "S6", sql("hv_result", f"SELECT attack, leak_channels, count(*) AS n FROM ({RESULT}) GROUP BY 1, 2"))
def _(spark, d):
    path = new_work_path(spark, "results")
    sk.write_results(result_rows(spark, d), path, "csv")
    back = spark.read.option("header", True).schema("scenario_id string, vertical string, attack string, task_success boolean, leaked boolean, leak_channels string").csv(path)
    return back.groupBy(F.coalesce("attack", F.lit("")).alias("attack"), F.coalesce("leak_channels", F.lit("")).alias("leak_channels")).agg(F.count(F.lit(1)).alias("n"))


@query("assemble_trace", "S7", """SELECT o_orderkey AS trace_id, count(l_orderkey) AS messages, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS content
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, d):
    m = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("msg_idx"), "l_partkey", "l_suppkey")
    t = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"))
    docs = sk.assemble_trace(t, m)
    text = F.array_join(F.transform("channel_messages", lambda x: F.concat_ws(":", x["msg_idx"], x["l_partkey"])), ",")
    return docs.select("trace_id", F.coalesce(F.size("channel_messages"), F.lit(0)).cast("bigint").alias("messages"), F.coalesce(text, F.lit("")).alias("content"))


@query("resume_plan", "S8", """SELECT o_orderkey AS scenario_id, o_orderpriority AS model, 'todo' AS state FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
 UNION ALL SELECT DISTINCT l_orderkey, NULL, 'done' FROM lineitem WHERE l_returnflag = 'R'""")
def _(spark, d):
    done = v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scenario_id"), F.lit("done").alias("state")).distinct()
    todo = sk.resume_plan(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("model")), done)
    return sk.merge_results(done, todo.withColumn("state", F.lit("todo"))).select("scenario_id", "model", "state")


@query("append_incidents", "S9", sql("hv_live", "SELECT framework, channel, count(*) AS n FROM hv_live WHERE leaked GROUP BY 1, 2"))
def _(spark, d):
    from ..schemas import INCIDENT
    path = new_work_path(spark, "incidents")
    e = v.live(spark, d).where("leaked").select("framework", "channel", "confidence", F.array(F.col("event_id").cast("string")).alias("leaked_items"))
    sk.append_incidents(e.where("confidence >= 0.7"), path)
    sk.append_incidents(e.where("confidence < 0.7"), path)
    return spark.read.schema(INCIDENT).json(path).groupBy("framework", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("results_table", "S10", sql("hv_trace", f"""\n, r AS (SELECT {RATES} FROM hv_trace), g AS ({GAP.format(by="", group="")}) SELECT 'C1 leak rate' AS metric, c1_rate AS value, '' AS ci FROM r UNION ALL SELECT 'C2 leak rate', c2_rate, '' FROM r
 UNION ALL SELECT 'C5 leak rate', c5_rate, '' FROM r UNION ALL SELECT 'audit gap', h1_rate, format('[{{:.1f}}, {{:.1f}}]', ci_lower, ci_upper) FROM g UNION ALL SELECT 'single agent', single_rate, '' FROM r UNION ALL SELECT 'multi agent', multi_rate, '' FROM r"""))
def _(spark, d):
    return r6(sk.results_table(mx.headline(v.traces(spark, d))))


CLAIMS = sql("hv_trace", f"SELECT model, round(({C['c3']})::DOUBLE, 6) AS c3, round(({C['c6']})::DOUBLE, 6) AS c6 FROM hv_trace GROUP BY 1")


def claims(spark, d):
    g = v.traces(spark, d).groupBy(F.col("model").alias("m")).agg(mx.pct("c3_leaked").alias("c3"), mx.pct("c6_leaked").alias("c6"))
    return g.select("m", F.struct(F.col("c3").alias("rate")).alias("C3_tool_input"), F.struct(F.col("c6").alias("rate")).alias("C6_logs"))


def claims_read(spark, path, multi_line):
    c = rd.collect_claims(spark, f"{path}/*/*", multi_line=multi_line)
    name = F.call_function("url_decode", F.regexp_replace("model", "^m=", ""))
    return r6(c.select(name.alias("model"), "c3", "c6"))


@query("collect_claims", "S11", CLAIMS)
def _(spark, d):
    path = new_work_path(spark, "claims")
    claims(spark, d).write.partitionBy("m").json(path)
    return claims_read(spark, path, False)


@query("collect_claims_pretty", "S11", CLAIMS)
def _(spark, d):
    """One pretty-printed file for each model."""
    path = new_work_path(spark, "claims-pretty")
    claims(spark, d).select("m", F.to_json(F.struct("C3_tool_input", "C6_logs"), {"pretty": "true"}).alias("value")).write.partitionBy("m").text(path)
    return claims_read(spark, path, True)
