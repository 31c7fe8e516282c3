"""Task-utility evaluation: did the agent do its job?"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import task_rules as tr
from ..functions import text as tx
from ..functions.patterns import any_word_sql, sql_text
from ..functions.stats import count_true
from ..functions.text import col


def _verdict_sql(success, score, mode, met, failed) -> str:
    return (f"named_struct('success', {success}, 'score', CAST({score} AS DOUBLE), 'failure_mode', {mode},"
            f" 'n_met', CAST({met} AS INT), 'n_failed', CAST({failed} AS INT))")


def _states_sql(rules) -> str:
    """Per criterion 'met' or 'failed'; null for an unknown criterion of a short text, which is ignored."""
    whens = []
    for words, needed, min_len, pattern in rules["criteria"]:
        ok = any_word_sql("__low", needed) if needed else "true"
        if pattern:
            ok = f"({ok} OR __low RLIKE {sql_text(pattern)})"
        if min_len:
            ok = f"({ok} AND __n > {min_len})"
        whens.append(f"WHEN {any_word_sql('c', words)} THEN CASE WHEN {ok} THEN 'met' ELSE 'failed' END")
    body = f"CASE {' '.join(whens)} WHEN __n > {rules['fallback_length']} THEN 'met' END"
    return f"transform(__criteria, c -> {body})"


def strict_columns(output="output", criteria="criteria") -> dict[str, Column]:
    """Columns that the rule expressions read."""
    low = F.transform(col(criteria), lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" "))))
    return {"__low": F.lower(col(output)), "__n": F.length(col(output)), "__criteria": low}


def strict_vertical(vertical: str, tools: str | None = None) -> Column:
    """Verdict struct of one vertical's rule table; ``tools`` counts tool calls (null: no trace)."""
    rules = tr.STRICT_RULES[vertical]
    long_enough = f"(__n >= {rules['min_length']})"
    met = f"(size(filter(__states, s -> s = 'met')) + CAST({long_enough} AS INT)"
    failed = f"(size(filter(__states, s -> s = 'failed')) + CAST(NOT {long_enough} AS INT)"
    if vertical == "healthcare" and tools is not None:
        met += f" + CASE WHEN {tools} > 0 THEN 1 ELSE 0 END"
        failed += f" + CASE WHEN {tools} = 0 THEN 1 ELSE 0 END"
    met, failed = met + ")", failed + ")"
    score = f"({met} / ({met} + {failed}))"
    success = f"({score} >= {tr.PASS_SCORE} AND {long_enough})"
    if vertical in ("healthcare", "finance"):
        mode = f"CASE WHEN {success} THEN 'none' WHEN NOT {long_enough} THEN 'incomplete' ELSE 'missing_fields' END"
    else:
        mode = f"CASE WHEN {success} THEN 'none' ELSE 'missing_fields' END"
    refused, privacy = any_word_sql("__low", rules["refusal"]), any_word_sql("__low", rules["privacy"])
    text = (f"CASE WHEN {refused} AND {privacy} THEN {_verdict_sql('true', tr.PRIVACY_REFUSAL_SCORE, sql_text('privacy_refusal'), 1, 0)}"
            f" WHEN {refused} THEN {_verdict_sql('false', 0, sql_text('refused'), 0, 1)}"
            f" ELSE {_verdict_sql(success, score, mode, met, failed)} END")
    return F.expr(text)


def strict_generic() -> Column:
    long_enough, k = f"(__n >= {tr.GENERIC_MIN_LENGTH})", f"CASE WHEN __n > {tr.GENERIC_CRITERION_LENGTH} THEN size(__criteria) ELSE 0 END"
    met = f"(CAST({long_enough} AS INT) + {k})"
    failed = f"(1 + size(__criteria) - {met})"
    score = f"({met} / (1 + size(__criteria)))"
    ok = f"({score} >= {tr.GENERIC_PASS_SCORE})"
    return F.expr(_verdict_sql(ok, score, f"CASE WHEN {ok} THEN 'none' ELSE 'incomplete' END", met, failed))


def strict_eval(tasks: DataFrame, tools: str | None = None) -> DataFrame:
    """Verdict columns for each task by its vertical; unknown verticals get the generic check."""
    states = "CASE vertical " + " ".join(f"WHEN {sql_text(v)} THEN {_states_sql(r)}" for v, r in tr.STRICT_RULES.items()) + " END"
    v = None
    for name in tr.STRICT_RULES:
        cond, e = F.col("vertical") == name, strict_vertical(name, tools)
        v = F.when(cond, e) if v is None else v.when(cond, e)
    return (tasks.withColumns(strict_columns()).withColumn("__states", F.expr(states)).withColumn("__v", v.otherwise(strict_generic()))
            .select(*[c for c in tasks.columns if c not in ("output", "criteria")], "__v.*"))


def strict_summary(verdicts: DataFrame) -> DataFrame:
    """Totals by vertical and overall (null vertical)."""
    return verdicts.rollup("vertical").agg(
        F.count(F.lit(1)).alias("total"), count_true("success").alias("success_count"),
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("score").alias("average_score"))


def failure_modes(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("vertical", "failure_mode").agg(F.count(F.lit(1)).alias("n"))


def string_match(output, references, case_sensitive: bool = False, partial: bool = True) -> Column:
    o, refs = col(output), col(references)
    if not case_sensitive:
        o, refs = F.lower(o), F.transform(refs, F.lower)
    if partial:
        return F.coalesce(F.exists(refs, lambda r: F.contains(o, r)), F.lit(False))
    o = tx.strip(o)
    return F.coalesce(F.exists(refs, lambda r: tx.strip(r) == o), F.lit(False))


def content_check(text, include, exclude) -> Column:
    """struct(success, score, missing, forbidden): required and forbidden strings, case ignored."""
    low = F.lower(col(text))
    inc, exc = (F.coalesce(col(x), F.array().cast("array<string>")) for x in (include, exclude))
    missing = F.size(F.filter(inc, lambda w: ~F.contains(low, F.lower(w))))
    found = F.size(F.filter(exc, lambda w: F.contains(low, F.lower(w))))
    total = F.size(inc) + F.size(exc)
    return F.struct(((missing + found) == 0).alias("success"),
                    F.when(total == 0, 1.0).otherwise((total - missing - found) / total).alias("score"),
                    missing.alias("missing"), found.alias("forbidden"))


def url_match(current, reference) -> Column:
    norm = lambda u: F.lower(F.rtrim(col(u), F.lit("/")))
    return F.coalesce(norm(current) == norm(reference), F.lit(False))


def combine_evals(results: DataFrame, how: str = "all", by=("task_id",)) -> DataFrame:
    """all = every check and the lowest score; any = one check and the highest; average = more than half, mean."""
    if how == "all":
        s, v = F.bool_and("success"), F.min("score")
    elif how == "any":
        s, v = F.bool_or("success"), F.max("score")
    else:
        s, v = F.count_if("success") > F.count(F.lit(1)) / 2, F.avg("score")
    return results.groupBy(*by).agg(s.alias("success"), v.alias("score"))


def answered(output) -> Column:
    """The bare heuristic: more than ten characters."""
    return F.length(col(output)) > 10


def useful(output, head: int = 50) -> Column:
    """No error mark, no early "cannot", 30 characters or more; heavily redacted texts need more than 100."""
    o = col(output)
    low = F.lower(o)
    n_red = F.regexp_count(low, F.lit("redacted"))
    return (F.when(F.contains(o, F.lit("[ERROR")) | F.contains(F.lower(F.substring(o, 1, head)), F.lit("cannot")), False)
            .when(F.length(o) < 30, False).when(n_red > 3, F.length(o) > 100).otherwise(True))


EVAL_CONFIG = ("eval_types array<string>, reference_answers array<string>, must_include array<string>,"
               " must_exclude array<string>, reference_url string, program_html array<string>")


def eval_config(c) -> Column:
    """Evaluation JSON -> struct with defaults for whatever is missing."""
    s = F.from_json(col(c), EVAL_CONFIG)
    none = F.array().cast("array<string>")
    get = lambda n, d: F.coalesce(s[n], d).alias(n)
    return F.struct(get("eval_types", F.array(F.lit("string_match"))), get("reference_answers", none), get("must_include", none),
                    get("must_exclude", none), get("reference_url", F.lit("")))
