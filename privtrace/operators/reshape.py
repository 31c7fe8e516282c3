"""Reshaping of scenarios, traces and events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import fields as fl
from ..functions.text import col, normalize_channel
from .scan import running


def explode_messages(traces: DataFrame, keep=("trace_id", "scenario_id")) -> DataFrame:
    """One row per channel message, with its position."""
    return traces.select(*keep, F.posexplode("channel_messages").alias("msg_idx", "m")).select(*keep, "msg_idx", "m.*")


def vault_rows(scenarios: DataFrame) -> DataFrame:
    """Nested vault -> (scenario_id, record_idx, field, value, tier, weight); empty values dropped."""
    rec = scenarios.select("scenario_id", F.posexplode("private_vault.records").alias("record_idx", "r"))
    return rec.select(
        "scenario_id", F.col("record_idx").cast("bigint").alias("record_idx"),
        F.explode("r.fields").alias("field", "value"),
        F.col("r.canary_tier").alias("tier"), F.col("r.sensitivity_weight").alias("weight"),
    ).where(F.length("value") > 0)


def vault_long_indexed(vault: DataFrame) -> DataFrame:
    """Repeated fields of a scenario become ``field``, ``field_1``, ``field_2`` in record order.

    ``name_of_value`` is the field that last used the same value.
    """
    v = vault.where(F.length("value") > 0)
    pos = running(v, ["scenario_id", "field"], "record_idx", {"__pos": ("count", F.col("value"))}, ties=["value"])
    last = v.groupBy("scenario_id", F.lower("value").alias("__lv")).agg(
        F.max_by("field", F.struct("record_idx", "field")).alias("name_of_value")
    )
    key = F.when(F.col("__pos") == 1, F.col("field")).otherwise(F.concat_ws("_", "field", (F.col("__pos") - 1).cast("string")))
    return (
        pos.withColumn("field_key", key).withColumn("__lv", F.lower("value"))
        .join(last, ["scenario_id", "__lv"]).drop("__pos", "__lv")
    )


def vault_long_last_wins(vault: DataFrame) -> DataFrame:
    """One value per (scenario, field): that of the last record."""
    rest = [c for c in vault.columns if c not in ("scenario_id", "field")]
    return (
        vault.groupBy("scenario_id", "field")
        .agg(F.max_by(F.struct(*rest), F.struct("record_idx", "value")).alias("__r"))
        .select("scenario_id", "field", *[F.col(f"__r.{c}").alias(c) for c in rest])
    )


def all_content(events: DataFrame, keep=("event_id",)) -> DataFrame:
    """content, tool arguments, tool output and memory value as text rows."""
    parts = [("content", F.col("content")), ("tool_args", F.col("tool_args")),
             ("tool_output", F.col("tool_output")), ("memory_value", F.col("memory_value"))]
    arr = F.filter(
        F.array(*[F.struct(F.lit(n).alias("part"), c.alias("text")) for n, c in parts]),
        lambda x: x["text"].isNotNull() & (F.length(x["text"]) > 0),
    )
    return events.select(*keep, F.inline(arr))


def filter_events(events: DataFrame, channels=None, types=None) -> DataFrame:
    out = events
    if channels:
        out = out.where(F.col("channel").isin(list(channels)))
    if types:
        out = out.where(F.col("event_type").isin(list(types)))
    return out


def scenario_flags(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumns({
        "is_multiagent": F.size("agents") > 1,
        "is_adversarial": F.col("adversary_level") != "A0",
        "tool_count": F.size("tools"),
    })


def filter_scenarios(scenarios: DataFrame, vertical=None, adversary=None, multi_agent=None) -> DataFrame:
    out = scenario_flags(scenarios)
    if vertical:
        out = out.where(F.col("vertical") == vertical)
    if adversary:
        out = out.where(F.col("adversary_level") == adversary)
    if multi_agent is not None:
        out = out.where(F.col("is_multiagent") == multi_agent)
    return out


def extract_canaries(vault: DataFrame, evaluation: DataFrame | None = None, marker: str = fl.CANARY_PREFIX) -> DataFrame:
    """Distinct (scenario_id, canary): vault values that hold the marker, and listed canaries."""
    out = vault.where(F.contains("value", F.lit(marker))).select("scenario_id", F.col("value").alias("canary"))
    if evaluation is not None:
        out = out.unionByName(evaluation.select("scenario_id", "canary"))
    return out.distinct()


def sensitive_values(vault: DataFrame) -> DataFrame:
    return vault.where(F.col("value").isNotNull()).select("scenario_id", F.col("value").cast("string").alias("value"))


def channel_events(events: DataFrame) -> DataFrame:
    """Text = content, else message, else data; empty rows dropped; channel names normalised."""
    def nz(c):
        return F.nullif(F.col(c), F.lit(""))
    return (
        events.withColumn("text", F.coalesce(nz("content"), nz("message"), nz("data")))
        .withColumn("channel", normalize_channel("channel"))
        .where(F.col("text").isNotNull()).drop("content", "message", "data")
    )


def apply_channel_config(events: DataFrame, config: dict[str, tuple[bool, float | None]], profile: str = "channel") -> DataFrame:
    """Drop events of switched-off channels; attach the weight in force."""
    from ..functions.text import channel_weight
    off = [c for c, (enabled, _) in config.items() if not enabled]
    over = {c: w for c, (_, w) in config.items() if w is not None}
    out = events.where(~F.col("channel").isin(off)) if off else events
    return out.withColumn("weight", channel_weight("channel", profile, over))


def memory_event_text(c, chars: int | None = 300) -> Column:
    """Text written to memory: ``Cache: `` and the head of the content that the agent caches."""
    body = F.substring(col(c), 1, chars) if chars else col(c)
    return F.concat(F.lit("Cache: "), body)


def log_event_text(c, agent="primary_agent", stamp=None) -> Column:
    """Text of the framework log: a header and the whole trace text."""
    stamp = F.lit("") if stamp is None else col(stamp)
    return F.concat(F.lit("INFO [AgentExecutor]: Step Execution\nTimestamp: "), stamp,
                    F.lit(f"\nAgent: {agent}\nExecution Trace:\n"), col(c), F.lit("\n"))


def parse_tags(tags) -> Column:
    """['adversary:A1', ..] -> map."""
    return F.map_from_entries(F.transform(F.filter(col(tags), lambda t: F.contains(t, F.lit(":"))), lambda t: F.struct(
        F.split_part(t, F.lit(":"), F.lit(1)), F.regexp_replace(t, "^[^:]*:", ""))))


def records_with_field(records: DataFrame, field: str) -> DataFrame:
    return records.where(F.map_contains_key("fields", field))


def records_by_sensitivity(records: DataFrame, at_least: float) -> DataFrame:
    return records.where(F.col("sensitivity_weight") >= at_least)


def render_template(template: str, **fields) -> Column:
    """``{name}`` marks in the template are replaced by columns."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(col(fields[m.group(1)]).cast("string"), F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
