"""Queries: set composition, vignettes, norms."""
from pyspark.sql import functions as F

from ..dims import task_rules as tr
from ..operators import compose as op
from . import query
from . import views as v
from .q_reshape import SCEN, scenarios

QUOTA = v.sql_values(op.quotas(400), "vertical, adversary_level, quota", "qq")


@query("compose_set", "G1", f"""WITH s AS ({SCEN}), q AS ({QUOTA}) SELECT scenario_id, vertical, adversary_level FROM (SELECT s.scenario_id, vertical, adversary_level, quota,
 row_number() OVER (PARTITION BY vertical, adversary_level ORDER BY md5('42:' || CAST(scenario_id AS VARCHAR)), scenario_id) AS rn FROM s JOIN q USING (vertical, adversary_level)) WHERE rn <= quota""")
def _(spark, d):
    return op.compose_set(scenarios(spark, d), total=400).select("scenario_id", "vertical", "adversary_level")


@query("run_plan", "G2", f"SELECT model, vertical, count(*) AS n FROM ({SCEN}) s CROSS JOIN (SELECT unnest(['m1', 'm2', 'm3']) AS model) GROUP BY 1, 2")
def _(spark, d):
    return op.run_plan(scenarios(spark, d), ["m1", "m2", "m3"]).groupBy("model", "vertical").agg(F.count(F.lit(1)).alias("n"))


def vignettes(spark, d):
    """Turns dressed as tagged stories; every fourth one misses a tag, every third one says too much."""
    t = F.col("turn") + F.col("conv_id")
    head = F.when(t % 3 == 0, "[Vignette]: A Private matter. ").otherwise("[Vignette]: ")
    story = F.regexp_replace("text", "[\n\r]", " ")
    last = F.when(t % 4 == 0, "").otherwise("[Data Recipient]: the insurer")
    return v.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("role"),
        F.concat(head, story, F.lit("\n[Sensitive Data]: diagnosis\n[Data Subject]: patient\n[Data Sender]: "), "role", F.lit("\n"), last).alias("text"))


VIG = """SELECT conv_id * 1000 + turn AS event_id, role, (turn + conv_id) % 3 = 0 AS said, (turn + conv_id) % 4 <> 0 AS full_,
 CASE WHEN (turn + conv_id) % 3 = 0 THEN 'A Private matter. ' ELSE '' END || regexp_replace(text, '[\\n\\r]', ' ', 'g') AS story FROM conversations"""


@query("vignette_checks", "G3", f"""SELECT event_id, NOT ({' OR '.join(f"contains(lower(story), '{w}')" for w in tr.VIGNETTE_FORBIDDEN)}) AS no_explicit_words, full_ AS has_all_tags,
 len(list_filter(regexp_split_to_array(trim(story), '[.!?]+'), lambda x: trim(x) <> '')) AS sentences FROM ({VIG})""")
def _(spark, d):
    return op.vignette_checks(vignettes(spark, d)).select("event_id", "no_explicit_words", "has_all_tags", F.col("sentences").cast("bigint").alias("sentences"))


@query("parse_vignette", "G4", f"""SELECT event_id, md5(trim(story, E' \\t')) AS story_md5, 'diagnosis' AS sensitive_data, 'patient' AS data_subject, role AS data_sender, 'the insurer' AS data_recipient FROM ({VIG}) WHERE full_ AND trim(story, E' \\t') <> ''""")
def _(spark, d):
    return op.parse_vignette(vignettes(spark, d)).select("event_id", F.md5("story").alias("story_md5"), "sensitive_data", "data_subject", "data_sender", "data_recipient")


SEEDS = """SELECT o_orderkey AS uid, CASE o_custkey % 4 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'finance' WHEN 2 THEN 'legal' ELSE 'corporate' END AS vertical,
 CASE o_orderkey % 5 WHEN 0 THEN 'Medical diagnosis' WHEN 1 THEN 'Salary and debt' WHEN 2 THEN 'job switching plan' WHEN 3 THEN 'Hobby' ELSE 'medication list' END AS data_type,
 CASE o_custkey % 5 WHEN 0 THEN 'Family Doctor' WHEN 1 THEN 'current Manager' WHEN 2 THEN 'the employer' WHEN 3 THEN 'city hospital' ELSE 'neighbour' END AS data_recipient,
 CASE o_orderkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'professional' ELSE NULL END AS relationship, CASE WHEN o_orderkey % 2 = 0 THEN 'regulation' ELSE 'crowdsourced' END AS source FROM orders"""


def seeds(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    def pick(e, *vals):
        out = F.when(e == 0, vals[0])
        for i, x in enumerate(vals[1:], 1):
            out = out.when(e == i, x)
        return out
    return v.table(spark, d, "orders").select(
        o.alias("uid"), pick(c % 4, "healthcare", "finance", "legal", "corporate").alias("vertical"),
        pick(o % 5, "Medical diagnosis", "Salary and debt", "job switching plan", "Hobby", "medication list").alias("data_type"),
        pick(c % 5, "Family Doctor", "current Manager", "the employer", "city hospital", "neighbour").alias("data_recipient"),
        pick(o % 3, "public", "professional").alias("relationship"), pick(o % 2, "regulation", "crowdsourced").alias("source"))


@query("norm_violation", "G5", f"""SELECT uid, (regexp_matches(lower(data_type), 'medical|diagnosis|health|treatment|medication') AND NOT regexp_matches(lower(data_recipient), 'doctor|hospital'))
 OR (regexp_matches(lower(data_type), 'salary|income|debt|credit|bank|financial') AND coalesce(relationship, '') = 'public') OR (regexp_matches(lower(data_type), 'job|switching') AND regexp_matches(lower(data_recipient), 'manager|employer')) AS violation FROM ({SEEDS})""")
def _(spark, d):
    return seeds(spark, d).select("uid", op.norm_violation("data_type", "data_recipient", "relationship").alias("violation"))


@query("filter_seeds", "G6", f"SELECT uid, data_type, relationship IS NOT NULL AND source = 'regulation' AS all_levels FROM ({SEEDS}) WHERE vertical = 'healthcare' AND source = 'regulation'")
def _(spark, d):
    s = op.filter_seeds(seeds(spark, d), vertical="healthcare", source="regulation")
    return s.select("uid", "data_type", op.has_all_levels("data_type", "relationship", "source").alias("all_levels"))
