"""Sinks and document assembly."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results_projection(results: DataFrame) -> DataFrame:
    """Flat form for CSV: lists joined by commas, nulls as empty text."""
    out = []
    for f in results.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            out.append(F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit("")).alias(f.name))
        elif f.dataType.typeName() == "string":
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            out.append(c)
    return results.select(*out)


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    if fmt == "csv":
        results_projection(results).write.mode(mode).option("header", True).csv(path)
    else:
        results.write.mode(mode).format(fmt).save(path)


def assemble_trace(traces: DataFrame, messages: DataFrame, part_size: int | None = None, order: str = "msg_idx") -> DataFrame:
    """Messages gathered back into one document per trace, in order.

    Only a caller who gives ``part_size`` gets a trace of more messages as
    several documents (``part`` 0, 1, ..).
    """
    rest = [c for c in messages.columns if c not in ("trace_id",)]
    part = F.lit(0) if part_size is None else F.floor(F.col(order) / part_size).cast("int")
    lists = messages.withColumn("part", part).groupBy("trace_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("channel_messages"))
    return traces.join(lists, "trace_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def resume_plan(scenarios: DataFrame, done: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Scenarios that still have to run."""
    return scenarios.join(done.select(key).distinct(), key, "left_anti")


def merge_results(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    return previous.unionByName(fresh, allowMissingColumns=True)


def append_incidents(incidents: DataFrame, path: str) -> None:
    """Incident rows as JSON lines, appended (one commit per call)."""
    incidents.write.mode("append").json(path)


def results_table(stats: DataFrame) -> DataFrame:
    """One row of rates with interval -> (metric, value, ci)."""
    ci = F.format_string("[%.1f, %.1f]", F.col("ci_lower"), F.col("ci_upper"))
    none = F.lit("")
    def row(n, v, c):
        return F.struct(F.lit(n).alias("metric"), F.col(v).alias("value"), c.alias("ci"))
    return stats.select(F.inline(F.array(
        row("C1 leak rate", "c1_rate", none), row("C2 leak rate", "c2_rate", none), row("C5 leak rate", "c5_rate", none),
        row("audit gap", "h1_rate", ci), row("single agent", "single_rate", none), row("multi agent", "multi_rate", none))))
