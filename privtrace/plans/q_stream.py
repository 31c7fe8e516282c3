"""Queries: live monitoring; every stream is drained into a table and compared with its batch meaning."""
from pyspark.sql import functions as F

from ..streaming import monitor as op
from ..session import new_work_path
from . import query
from . import views as v
from .views import r6
from .views import with_views as sql


def live_stream(spark, d):
    return v.as_live(op.stream_parquet(spark, f"{d}/events.parquet"))


def doc_stream(spark, d):
    s = op.stream_parquet(spark, f"{d}/documents.parquet")
    return s.select(F.col("source").alias("scenario_id"), F.col("doc_id").alias("event_id"), "text")


@query("monitor_stream", "T1", sql("hv_shared_vault", "SELECT d.doc_id AS event_id, field FROM documents d JOIN hv_shared_vault ON contains(lower(d.text), lower(value))"))
def _(spark, d):
    return op.monitor_stream(doc_stream(spark, d), v.shared_vault(spark, d), on=()).select("event_id", "field")


@query("monitor_batches", "T1", sql("hv_vault", "SELECT d.doc_id AS event_id, field, value FROM documents d JOIN hv_vault v ON d.source = v.scenario_id WHERE length(value) > 3 AND contains(lower(d.text), lower(value))"))
def _(spark, d):
    """The scenarios' own vault, any size: each micro-batch runs the batch operator."""
    out, ck = new_work_path(spark, "found"), new_work_path(spark, "found-state")
    def sink(df, batch_id):
        df.select("event_id", "field", "value").write.mode("overwrite").parquet(f"{out}/b={batch_id}")
    op.monitor_batches(doc_stream(spark, d), v.vault_table(spark, d), sink, ck).awaitTermination()
    return spark.read.parquet(f"{out}/b=*")


@query("alerts", "T2", sql("hv_live", "SELECT event_id, CASE WHEN confidence >= 0.7 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN confidence >= 0.7 THEN 'block' ELSE 'log' END AS action FROM hv_live WHERE leaked"))
def _(spark, d):
    a = op.alerts(live_stream(spark, d).where("leaked"), block=True)
    return op.run_to_table(a.select("event_id", "severity", "action"), "alerts")


@query("running_stats", "T3", sql("hv_live", "SELECT framework, channel, count(*) AS checks, count(*) FILTER (WHERE leaked) AS leaks, count(*) FILTER (WHERE leaked AND confidence >= 0.7) AS high_confidence FROM hv_live GROUP BY 1, 2"))
def _(spark, d):
    return op.run_to_table(op.running_stats(live_stream(spark, d)), "stats", mode="complete")


CLOSED = "(SELECT epoch_us(max(ts)) - 600000000 FROM hv_live)"


@query("leak_rate_tumbling", "T4", sql("hv_live", f"""SELECT window_start, channel, checks, leaks, round(leaks / checks, 6) AS leak_rate FROM (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS window_start, channel,
 count(*) AS checks, count(*) FILTER (WHERE leaked) AS leaks FROM hv_live GROUP BY 1, 2) WHERE (window_start + 3600) * 1000000 <= {CLOSED}"""))
def _(spark, d):
    return r6(op.run_to_table(op.leak_rate(live_stream(spark, d)), "tumbling"))


@query("leak_rate_sliding", "T5", sql("hv_live", f"""SELECT window_start, channel, checks, leaks, round(leaks / checks, 6) AS leak_rate FROM (SELECT ws AS window_start, channel, count(*) AS checks, count(*) FILTER (WHERE leaked) AS leaks
 FROM (SELECT channel, leaked, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) // 1000000 - 900 * unnest([0, 1, 2, 3]) AS ws FROM hv_live) GROUP BY 1, 2) WHERE (window_start + 3600) * 1000000 <= {CLOSED}"""))
def _(spark, d):
    return r6(op.run_to_table(op.leak_rate(live_stream(spark, d), slide="15 minutes"), "sliding"))


@query("agent_sessions", "T6", sql("hv_live", f"""\n, g AS (SELECT agent_id, ts, leaked, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM hv_live WINDOW w AS (PARTITION BY agent_id ORDER BY ts)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY agent_id ORDER BY ts) AS sid FROM g)
 SELECT agent_id, session_start, session_end, events, leaks FROM (SELECT agent_id, sid, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1800000000 AS session_end, count(*) AS events, count(*) FILTER (WHERE leaked) AS leaks FROM s GROUP BY 1, 2)
 WHERE session_end <= {CLOSED}"""))
def _(spark, d):
    return op.run_to_table(op.agent_sessions(live_stream(spark, d)), "sessions")


@query("leak_then_output", "T7", sql("hv_live", """SELECT a.scenario_id, a.event_id AS leak_id, b.event_id AS output_id, epoch_us(b.ts) - epoch_us(a.ts) AS lag_us FROM hv_live a JOIN hv_live b ON a.scenario_id = b.scenario_id
 AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.leaked AND a.channel IN ('C2', 'C5') AND b.channel = 'C1'"""))
def _(spark, d):
    internal = live_stream(spark, d).where("leaked AND channel IN ('C2', 'C5')")
    output = live_stream(spark, d).where("channel = 'C1'")
    return op.run_to_table(op.leak_then_output(internal, output, within="12 hours"), "followed")


@query("dedup_stream", "T8", sql("hv_live", "SELECT scenario_id, framework AS field, channel, 1 AS n FROM hv_live WHERE leaked GROUP BY 1, 2, 3"))
def _(spark, d):
    """The delay covers all events, so each signature comes once, whichever row is first."""
    s = live_stream(spark, d).where("leaked").withColumn("field", F.col("framework"))
    once = op.run_to_table(op.dedup_stream(s, delay="3650 days").select("event_id", "scenario_id", "field", "channel"), "dedup")
    return once.groupBy("scenario_id", "field", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("audit_gap_state", "T9", sql("hv_live", f"""\n, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM hv_live WINDOW w AS (PARTITION BY scenario_id ORDER BY ts)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY scenario_id ORDER BY ts) AS sid FROM g)
 SELECT scenario_id, closed_at, c1, c2, c5, NOT c1 AND (c2 OR c5) AS audit_gap, events FROM (SELECT scenario_id, sid, epoch_us(max(ts)) + 3600000000 AS closed_at, bool_or(leaked AND channel = 'C1') AS c1,
 bool_or(leaked AND channel = 'C2') AS c2, bool_or(leaked AND channel = 'C5') AS c5, count(*) AS events FROM s GROUP BY 1, 2) WHERE closed_at <= {CLOSED}"""))
def _(spark, d):
    return op.run_to_table(op.audit_gap_state(live_stream(spark, d), timeout="1 hour"), "gapstate")


@query("late_events", "T10", """WITH m AS (SELECT event_id % 4 AS b, max(ts) AS newest FROM events GROUP BY 1)
 SELECT e.event_id % 4 AS batch, count(*) AS n, count(*) FILTER (e.ts < (SELECT max(newest) FROM m WHERE m.b < e.event_id % 4) - INTERVAL 10 MINUTE) AS late FROM events e GROUP BY 1""")
def _(spark, d):
    """The events arrive in four lots, each over the whole period: later lots hold late rows."""
    path = new_work_path(spark, "arrivals")
    e = v.table(spark, d, "events")
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).repartition(4).write.mode("append").parquet(path)
    return op.late_events(op.stream_parquet(spark, path, files_per_trigger=4))


@query("incident_sink", "T11", sql("hv_live", "SELECT framework, count(*) AS n FROM hv_live WHERE leaked GROUP BY 1"))
def _(spark, d):
    out, ck = new_work_path(spark, "sink"), new_work_path(spark, "sink-state")
    op.incident_sink(live_stream(spark, d).where("leaked").select("event_id", "framework", "channel", "confidence"), out, ck).awaitTermination()
    return spark.read.schema("event_id bigint, framework string, channel string, confidence double").json(out).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))
