"""Queries: trade-off, orderings, top-k."""
from pyspark.sql import functions as F

from ..operators import metrics as mx
from ..operators import pareto as op
from . import query
from . import views as v
from .q_metrics import MS, RUNS
from .views import r6
from .views import with_views as sql

DOM = "(q.cost <= p.cost AND q.utility >= p.utility AND (q.cost < p.cost OR q.utility > p.utility))"
FRONT = f"SELECT p.* FROM hv_point p WHERE NOT EXISTS (SELECT 1 FROM hv_point q WHERE q.grp = p.grp AND {DOM})"
STEPS = f"SELECT DISTINCT grp, cost, utility FROM ({FRONT})"


@query("pareto_frontier", "W1", sql("hv_point", f"SELECT grp, name, round(cost, 6) AS cost, round(utility, 6) AS utility FROM ({FRONT})"))
def _(spark, d):
    return r6(op.pareto_frontier(v.points(spark, d), by=["grp"]).select("grp", "name", "cost", "utility"))


@query("pareto_frontier_all", "W1", sql("hv_point", f"SELECT p.name, NOT EXISTS (SELECT 1 FROM hv_point q WHERE {DOM}) AS is_optimal FROM hv_point p"))
def _(spark, d):
    return op.with_optimal_flag(v.points(spark, d)).select("name", "is_optimal")


@query("pareto_auc", "W2", sql("hv_point", f"""\n, f AS ({STEPS}), n AS (SELECT grp, count(*) AS n_points FROM ({FRONT}) GROUP BY 1), x AS (SELECT *, lead(cost) OVER w AS nc, lead(utility) OVER w AS nu, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY grp ORDER BY cost))
 SELECT grp, n_points, round(CASE WHEN n_points = 1 THEN max((1 - cost) * utility) ELSE sum(CASE WHEN rn = 1 THEN cost * utility / 2 ELSE 0 END + CASE WHEN nc IS NULL THEN (1 - cost) * utility ELSE (nc - cost) * (nu + utility) / 2 END) END, 6) AS auc
 FROM x JOIN n USING (grp) GROUP BY grp, n_points"""))
def _(spark, d):
    return r6(op.pareto_auc(v.points(spark, d), by=["grp"]))


@query("hypervolume", "W3", sql("hv_point", f"""\n, f AS ({STEPS}), x AS (SELECT *, lead(cost, 1, 0.9) OVER (PARTITION BY grp ORDER BY cost) AS nc FROM f WHERE cost < 0.9 AND utility > 0.1)
 SELECT g.grp, round(coalesce(sum((nc - cost) * (utility - 0.1)), 0)::DOUBLE, 6) AS hypervolume FROM (SELECT DISTINCT grp FROM hv_point) g LEFT JOIN x USING (grp) GROUP BY 1"""))
def _(spark, d):
    return r6(op.hypervolume(v.points(spark, d), by=["grp"], ref=(0.9, 0.1)))


@query("pareto_layers", "W4", sql("hv_point", f"""\n, u AS (SELECT DISTINCT grp, cost, utility FROM hv_point), c AS (SELECT grp, cost, utility, 1 AS layer FROM u
 UNION SELECT p.grp, p.cost, p.utility, q.layer + 1 FROM c q JOIN u p ON q.grp = p.grp AND {DOM})
 SELECT p.name, max(layer) AS layer FROM hv_point p JOIN c USING (grp, cost, utility) GROUP BY 1"""))
def _(spark, d):
    return op.pareto_layers(v.points(spark, d), by=["grp"]).select("name", "layer")


@query("optimal_point", "W5", sql("hv_point", f"""SELECT grp, name, round(cost, 6) AS cost, round(utility, 6) AS utility, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY dist, cost, name) AS rn
 FROM (SELECT *, sqrt(cost * cost + (utility - 1) * (utility - 1)) AS dist FROM ({FRONT}) WHERE cost <= 0.5 AND utility >= 0.3)) WHERE rn = 1"""))
def _(spark, d):
    return r6(op.optimal_point(v.points(spark, d), by=["grp"], max_cost=0.5, min_utility=0.3))


@query("pareto_point", "W6", sql("hv_result hv_leak", f"SELECT run AS name, round(elr::DOUBLE, 6) AS cost, round(tsr, 6) AS utility FROM ({RUNS})"))
def _(spark, d):
    return r6(op.pareto_point(mx.run_metrics(v.results(spark, d), v.leaks(spark, d))))


@query("top_models", "W7", sql("hv_trace", f"SELECT model, n, round(c2, 6) AS c2 FROM ({MS}) ORDER BY n DESC, model LIMIT 3"))
def _(spark, d):
    return r6(op.top_models(mx.model_stats(v.traces(spark, d)), "n", 3).select("model", "n", "c2"))


@query("first_k_canaries", "W8", sql("hv_vault", "SELECT scenario_id, canary, rn FROM (SELECT scenario_id, value AS canary, row_number() OVER (PARTITION BY scenario_id ORDER BY record_idx, value) AS rn FROM hv_vault WHERE contains(value, 'CANARY_')) WHERE rn <= 5"))
def _(spark, d):
    c = v.vault(spark, d).where(F.contains("value", F.lit("CANARY_"))).select("scenario_id", "record_idx", F.col("value").alias("canary"))
    return op.first_k_canaries(c).select("scenario_id", "canary", "rn")


@query("event_order", "W9", sql("hv_live", """SELECT event_id, CAST(sum(CASE WHEN leaked THEN 1 ELSE 0 END) OVER w AS BIGINT) AS leaks_so_far, lag(event_id) OVER (PARTITION BY framework ORDER BY event_id) AS prev_seq,
 leaked AND sum(CASE WHEN leaked THEN 1 ELSE 0 END) OVER w = 1 AS is_first_leak FROM hv_live WINDOW w AS (PARTITION BY framework ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""))
def _(spark, d):
    e = v.live(spark, d).withColumn("seq", F.col("event_id"))
    return op.event_order(e, by=["framework"]).select("event_id", "leaks_so_far", "prev_seq", "is_first_leak")
