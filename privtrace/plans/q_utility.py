"""Queries: task utility."""
from pyspark.sql import functions as F

from ..dims import task_rules as tr
from ..operators import utility as op
from . import query
from . import views as v
from .views import r6
from .views import with_views as sql


def _q(s):
    return s.replace("'", "''")


def has(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{_q(w)}')" for w in words) + ")"


def strict_sql(vertical, trace=False):
    """Verdicts of one vertical: criteria as rows, one CASE per rule."""
    r = tr.STRICT_RULES[vertical]
    whens = []
    for words, needed, min_len, pattern in r["criteria"]:
        ok = has("low", needed) if needed else "TRUE"
        if pattern:
            ok = f"({ok} OR regexp_matches(low, '{pattern}'))"
        if min_len:
            ok = f"({ok} AND n > {min_len})"
        whens.append(f"WHEN {has('c', words)} THEN CASE WHEN {ok} THEN 1 ELSE 0 END")
    state = f"CASE {' '.join(whens)} WHEN n > {r['fallback_length']} THEN 1 ELSE NULL END"
    tool = "+ CASE WHEN max(tool_calls) > 0 THEN 1 ELSE 0 END" if trace else ""
    tool_f = "+ CASE WHEN max(tool_calls) = 0 THEN 1 ELSE 0 END" if trace else ""
    mode = ("CASE WHEN ok THEN 'none' WHEN n < {m} THEN 'incomplete' ELSE 'missing_fields' END" if vertical in ("healthcare", "finance")
            else "CASE WHEN ok THEN 'none' ELSE 'missing_fields' END").format(m=r["min_length"])
    return f"""SELECT task_id, vertical, CASE WHEN ref THEN priv ELSE ok END AS success, CASE WHEN ref THEN CASE WHEN priv THEN 0.8 ELSE 0 END ELSE score END::DOUBLE AS score,
 CASE WHEN ref THEN CASE WHEN priv THEN 'privacy_refusal' ELSE 'refused' END ELSE {mode} END AS failure_mode FROM (
 SELECT *, met / (met + failed) AS score, met / (met + failed) >= 0.6 AND n >= {r['min_length']} AS ok FROM (
 SELECT task_id, vertical, max(n) AS n, bool_or(ref) AS ref, bool_or(priv) AS priv, count(*) FILTER (WHERE st = 1) + CASE WHEN max(n) >= {r['min_length']} THEN 1 ELSE 0 END {tool} AS met,
 count(*) FILTER (WHERE st = 0) + CASE WHEN max(n) >= {r['min_length']} THEN 0 ELSE 1 END {tool_f} AS failed FROM (
 SELECT *, {state} AS st, {has('low', r['refusal'])} AS ref, {has('low', r['privacy'])} AS priv FROM (
 SELECT task_id, vertical, lower(output) AS low, length(output) AS n, tool_calls, replace(lower(unnest(criteria)), '_', ' ') AS c FROM hv_task WHERE vertical = '{vertical}')) GROUP BY 1, 2))"""


GENERIC = """SELECT task_id, vertical, s >= 0.5 AS success, s AS score, CASE WHEN s >= 0.5 THEN 'none' ELSE 'incomplete' END AS failure_mode FROM (
 SELECT task_id, vertical, ((CASE WHEN length(output) >= 50 THEN 1 ELSE 0 END + CASE WHEN length(output) > 100 THEN len(criteria) ELSE 0 END) / (1 + len(criteria)))::DOUBLE AS s FROM hv_task WHERE vertical = 'other')"""


def _one(vertical, uid, trace=False):
    body = GENERIC if vertical == "other" else strict_sql(vertical, trace)
    name = f"strict_{'generic' if vertical == 'other' else vertical}"

    @query(name, uid, sql("hv_task", f"SELECT task_id, success, round(score, 6) AS score, failure_mode FROM ({body})"))
    def run(spark, d):
        t = v.tasks(spark, d).where(F.col("vertical") == vertical)
        return r6(op.strict_eval(t, tools="tool_calls" if trace else None).select("task_id", "success", "score", "failure_mode"))
    return run


_one("healthcare", "U1", trace=True)
_one("finance", "U2")
_one("legal", "U3")
_one("corporate", "U4")
_one("other", "U5")
ALL = "\nUNION ALL ".join(f"SELECT * FROM ({strict_sql(x)})" for x in tr.STRICT_RULES) + f"\nUNION ALL SELECT * FROM ({GENERIC})"


@query("strict_summary", "U6", sql("hv_task", f"SELECT vertical, count(*) AS total, count(*) FILTER (WHERE success) AS success_count, round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate, round(avg(score), 6) AS average_score FROM ({ALL}) GROUP BY ROLLUP (vertical)"))
def _(spark, d):
    return r6(op.strict_summary(op.strict_eval(v.tasks(spark, d))))


@query("failure_modes", "U6", sql("hv_task", f"SELECT vertical, failure_mode, count(*) AS n FROM ({ALL}) GROUP BY 1, 2"))
def _(spark, d):
    return op.failure_modes(op.strict_eval(v.tasks(spark, d)))


@query("string_match", "U7", sql("hv_task", """SELECT task_id, contains(lower(output), 'allergy') OR contains(lower(output), 'no conflict') AS loose, contains(output, 'Dear counsel') AS strict_case,
 vertical = 'legal' OR vertical = 'finance' AS exact FROM hv_task"""))
def _(spark, d):
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    return v.tasks(spark, d).select(
        "task_id", op.string_match("output", arr("Allergy", "NO conflict")).alias("loose"), op.string_match("output", arr("Dear counsel"), case_sensitive=True).alias("strict_case"),
        op.string_match(F.concat(F.lit(" "), "vertical"), arr("LEGAL ", "finance"), partial=False).alias("exact"))


CHECK = """SELECT task_id, m + f = 0 AS success, (3 - m - f) / 3.0 AS score, m AS missing, f AS forbidden FROM (SELECT task_id,
 CAST(NOT contains(lower(output), 'the') AS INT) + CAST(NOT contains(lower(output), 'review') AS INT) AS m, CAST(contains(lower(output), 'confidential') AS INT) AS f FROM hv_task)"""


def checks(spark, d):
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    return v.tasks(spark, d).select("task_id", "vertical", op.content_check("output", arr("the", "Review"), arr("CONFIDENTIAL")).alias("c")).select("task_id", "vertical", "c.*")


@query("content_check", "U8", sql("hv_task", f"SELECT task_id, success, round(score::DOUBLE, 6) AS score, missing, forbidden FROM ({CHECK})"))
def _(spark, d):
    return r6(checks(spark, d).drop("vertical"))


@query("html_content_check", "U9", """SELECT page_id, contains(lower(html), '<article>') AND contains(lower(html), '<title>') AND NOT contains(lower(html), 'script') AS success,
 round((3 - CAST(NOT contains(lower(html), '<article>') AS INT) - CAST(NOT contains(lower(html), '<title>') AS INT) - CAST(contains(lower(html), 'script') AS INT)) / 3, 6) AS score FROM pages""")
def _(spark, d):
    inc, exc = F.array(F.lit("<article>"), F.lit("<title>")), F.array(F.lit("script"))
    return r6(v.table(spark, d, "pages").select("page_id", op.content_check("html", inc, exc).alias("c")).select("page_id", "c.success", "c.score"))


@query("url_match", "U10", "SELECT page_id, rtrim(lower(url), '/') = lower(CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN rtrim(url, '/') ELSE url || 'x' END) OR (page_id % 3 = 0) AS hit FROM pages")
def _(spark, d):
    p = F.col("page_id")
    ref = F.when(p % 3 == 0, F.concat(F.upper("url"), F.lit("//"))).when(p % 3 == 1, F.rtrim("url", F.lit("/"))).otherwise(F.concat("url", F.lit("x")))
    return v.table(spark, d, "pages").select("page_id", op.url_match("url", ref).alias("hit"))


RES = f"""SELECT task_id, success, score::DOUBLE AS score FROM ({CHECK}) UNION ALL SELECT task_id, success, score FROM ({ALL}) UNION ALL SELECT task_id, length(output) > 10, 1.0 FROM hv_task"""


@query("combine_evals", "U11", sql("hv_task", "\nUNION ALL ".join(
    f"SELECT task_id, '{how}' AS how, {s} AS success, round({sc}::DOUBLE, 6) AS score FROM ({RES}) GROUP BY 1" for how, s, sc in
    [("all", "bool_and(success)", "min(score)"), ("any", "bool_or(success)", "max(score)"), ("average", "count(*) FILTER (WHERE success) > count(*) / 2", "avg(score)")])))
def _(spark, d):
    t = v.tasks(spark, d)
    res = checks(spark, d).select("task_id", "success", "score").unionByName(op.strict_eval(t).select("task_id", "success", "score")).unionByName(
        t.select("task_id", op.answered("output").alias("success"), F.lit(1.0).alias("score")))
    out = None
    for how in ("all", "any", "average"):
        x = op.combine_evals(res, how).select("task_id", F.lit(how).alias("how"), "success", "score")
        out = x if out is None else out.unionByName(x)
    return r6(out)


@query("task_heuristics", "U12", sql("hv_task", """SELECT task_id, length(output) > 10 AS answered, CASE WHEN contains(output, '[ERROR') OR contains(lower(substring(output, 1, 50)), 'cannot') THEN FALSE WHEN length(output) < 30 THEN FALSE
 WHEN len(regexp_extract_all(lower(output), 'redacted')) > 3 THEN length(output) > 100 ELSE TRUE END AS useful FROM (SELECT task_id, CASE WHEN task_id % 4 = 0 THEN '[ERROR] ' || output WHEN task_id % 4 = 1 THEN 'redacted redacted redacted redacted ' || output
 WHEN task_id % 4 = 2 THEN 'I Cannot. ' || output ELSE output END AS output FROM hv_task)"""))
def _(spark, d):
    k, o = F.col("task_id"), F.col("output")
    x = (F.when(k % 4 == 0, F.concat(F.lit("[ERROR] "), o)).when(k % 4 == 1, F.concat(F.lit("redacted redacted redacted redacted "), o))
         .when(k % 4 == 2, F.concat(F.lit("I Cannot. "), o)).otherwise(o))
    return v.tasks(spark, d).select("task_id", x.alias("output")).select("task_id", op.answered("output").alias("answered"), op.useful("output").alias("useful"))


@query("eval_config", "U13", """SELECT event_id, 'string_match' AS types, 0 AS n_include, 'k' || json_extract_string(props, '$.k') AS url FROM events""")
def _(spark, d):
    js = F.concat(F.lit('{"reference_url": "k'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return v.table(spark, d, "events").select("event_id", op.eval_config(js).alias("c")).select(
        "event_id", F.array_join("c.eval_types", ",").alias("types"), F.size("c.must_include").alias("n_include"), F.col("c.reference_url").alias("url"))
