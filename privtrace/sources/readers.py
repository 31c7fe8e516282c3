"""Sources: traces, scenarios, event logs, pair traces, annotated texts, claims."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as sc


def read_traces(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One pretty-printed object per file, or (``one_per_file=False``) JSON lines; broken ones are skipped."""
    return (spark.read.schema(sc.TRACE).option("multiLine", one_per_file).option("mode", "DROPMALFORMED")
            .json(path).where(F.col("trace_id").isNotNull()))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.SCENARIO).json(path)


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata lines, events): a line with an event type is an event, any other the header of its file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    parsed = lines.withColumn("e", F.from_json("value", sc.LOG_EVENT))
    events = parsed.where(F.col("e.event_type").isNotNull()).select("file", "e.*")
    meta = parsed.where(F.col("e.event_type").isNull() & (F.length(F.trim("value")) > 0)).select(
        "file", F.from_json("value", "map<string,string>").alias("metadata"))
    return meta, events


def read_pair_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario with a message and a memory write -> two event rows."""
    t = spark.read.schema(sc.PAIR_TRACE).json(path)
    def row(channel, source, target, text, exposed):
        return F.struct(F.lit(channel).alias("channel"), F.col(source).alias("source"), F.col(target).alias("target"),
                        F.col(text).alias("text"), F.col(exposed).alias("pii_exposed"))
    rows = F.array(
        row("C2", "channel_c2.from", "channel_c2.to", "channel_c2.message", "channel_c2.pii_exposed"),
        row("C5", "channel_c5.agent", "channel_c5.memory_key", "channel_c5.memory_value", "channel_c5.pii_exposed"))
    return t.select("scenario_id", "framework", F.inline(rows)).where(F.col("text").isNotNull())


def read_annotated(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    return spark.read.schema(sc.ANNOTATED).option("multiLine", array_file).json(path)


def collect_claims(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """Claims files, one folder per model -> (model, c3, c6)."""
    j = spark.read.schema(sc.CLAIMS).option("multiLine", multi_line).json(paths)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return j.select(F.element_at(parts, -2).alias("model"), F.col("C3_tool_input.rate").alias("c3"), F.col("C6_logs.rate").alias("c6"))
