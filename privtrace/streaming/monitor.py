"""Live monitoring with Structured Streaming."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contain import ValueIndex
from ..operators.detect import leak_check
from ..operators.redact import sanitize
from ..session import new_work_path


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream; NTZ timestamps become event times."""
    from pyspark.sql import types as T
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path.rstrip("/") + "*")
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def run_to_table(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream (availableNow) into a parquet table in the work folder and read it back.

    Append goes through the exactly-once file sink. Complete and update results
    are written per batch; of a complete result only the last batch counts.
    """
    spark = df.sparkSession
    out, ck = new_work_path(spark, label), new_work_path(spark, label + "-state")
    w = df.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).outputMode("append").start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    last = {"id": None}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last["id"] = batch_id

    w.outputMode(mode).foreachBatch(write).start().awaitTermination()
    if last["id"] is None:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{out}/batch={last['id']}")


# --- live checks --------------------------------------------------------------

def monitor_batches(stream: DataFrame, vault: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                    on=("scenario_id",), min_len: int = 4, case_sensitive: bool = False, **kw):
    """Check of every micro-batch against a vault of any size, the results going into ``sink``.

    The vault's index is built once, before the stream starts.
    """
    index = ValueIndex(vault.where(F.length("value") >= max(1, min_len)), on, case_sensitive=case_sensitive)

    def step(batch: DataFrame, batch_id: int) -> None:
        sink(leak_check(batch, vault, on=on, min_len=max(1, min_len), case_sensitive=case_sensitive, index=index, **kw), batch_id)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def monitor_stream(stream: DataFrame, vault: DataFrame, on=("scenario_id",), min_len: int = 0, label: str = "monitor") -> DataFrame:
    """The stream's messages checked and drained into a table: one row per (message, value) found.

    A batch is written under its number, so a batch that runs again replaces itself.
    """
    spark = stream.sparkSession
    out, ck = new_work_path(spark, label), new_work_path(spark, label + "-state")
    kept: dict = {}

    def sink(df: DataFrame, batch_id: int) -> None:
        kept["schema"] = df.schema
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    monitor_batches(stream, vault, sink, ck, on=on, min_len=min_len).awaitTermination()
    if not kept:
        return spark.createDataFrame([], stream.drop("text").join(vault, list(on)).schema)
    return spark.read.schema(kept["schema"]).parquet(f"{out}/batch=*")


def alerts(hits: DataFrame, threshold: float = 0.7, redact: bool = False, block: bool = False) -> DataFrame:
    """Severity, preview and what to do; works on streams and tables alike."""
    out = hits.withColumn("severity", F.when(F.col("confidence") >= threshold, "HIGH").otherwise("LOW"))
    action = F.lit("block" if block else "redact" if redact else "log")
    out = out.withColumn("action", F.when(F.col("severity") == "HIGH", action).otherwise("log"))
    if "text" in out.columns:
        out = out.withColumn("safe_text", F.when(F.col("action") == "block", "[BLOCKED]").when(
            F.col("action") == "redact", sanitize("text")).otherwise(F.col("text")))
    return out


def running_stats(checks: DataFrame, by=("framework", "channel"), alert: float = 0.7) -> DataFrame:
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("leaked").alias("leaks"),
        F.count_if(F.col("leaked") & (F.col("confidence") >= alert)).alias("high_confidence"))


# --- event-time windows ----------------------------------------------------------

def leak_rate(stream: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes",
              by=("channel",), ts: str = "ts") -> DataFrame:
    """Leak rate per channel in tumbling or sliding windows."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, delay).groupBy(w.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("checks"), F.count_if("leaked").alias("leaks"))
            .select(F.unix_timestamp("w.start").alias("window_start"), *by, "checks", "leaks",
                    (F.col("leaks") / F.col("checks")).alias("leak_rate")))


def agent_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", by=("agent_id",), ts: str = "ts") -> DataFrame:
    return (stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("events"), F.count_if("leaked").alias("leaks"))
            .select(*by, F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "events", "leaks"))


def leak_then_output(internal: DataFrame, output: DataFrame, within: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """An internal leak followed by an output of the same scenario within a time limit (interval join).

    Time is cut into buckets as long as the limit. A leak enters its own bucket
    and the next one, which is all its window touches; an output stands in one.
    So a pair meets once, and a busy scenario is spread over its buckets.
    """
    us = int(pd.Timedelta(within).total_seconds() * 1_000_000)
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(us))
    a = internal.withWatermark("ts", delay).select(
        F.col("scenario_id").alias("a_scenario"), F.col("event_id").alias("leak_id"), F.col("ts").alias("leak_ts"))
    a = a.withColumn("a_bucket", F.explode(F.array(bucket("leak_ts"), bucket("leak_ts") + 1)))
    b = output.withWatermark("ts", delay).select("scenario_id", F.col("event_id").alias("output_id"), F.col("ts").alias("output_ts"),
                                                 bucket("ts").alias("bucket"))
    cond = F.expr(f"a_scenario = scenario_id AND a_bucket = bucket AND output_ts > leak_ts AND output_ts <= leak_ts + interval {within}")
    return a.join(b, cond).select("scenario_id", "leak_id", "output_id",
                                  (F.unix_micros("output_ts") - F.unix_micros("leak_ts")).alias("lag_us"))


def dedup_stream(stream: DataFrame, keys=("scenario_id", "field", "channel"), delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The same signature once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def audit_gap_state(stream: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Per scenario: which channels have leaked; one row when the scenario has been silent for ``timeout``.

    The state of a scenario is a session with four aggregates, so the built-in
    session window keeps it: no row is held, and messages are folded before
    they are kept (``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    folds them before the shuffle too, for scenarios with very much traffic).
    """
    hit = lambda c: F.coalesce(F.bool_or(F.col("leaked") & (F.col("channel") == c)), F.lit(False))
    g = (stream.withWatermark(ts, delay).groupBy(F.session_window(ts, timeout).alias("w"), "scenario_id")
         .agg(hit("C1").alias("c1"), hit("C2").alias("c2"), hit("C5").alias("c5"), F.count(F.lit(1)).alias("events")))
    return g.select("scenario_id", F.unix_micros("w.end").alias("closed_at"), "c1", "c2", "c5",
                    (~F.col("c1") & (F.col("c2") | F.col("c5"))).alias("audit_gap"), "events")


def late_events(stream: DataFrame, label: str = "late", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(batch, rows, late): rows older than the newest event of all earlier batches minus the delay.

    One small row per batch is written, with the newest event so far; the next
    batch reads it back, so a restarted job goes on where it stopped.
    """
    spark = stream.sparkSession
    out, ck = new_work_path(spark, label), new_work_path(spark, label + "-state")
    us = int(pd.Timedelta(delay).total_seconds() * 1_000_000)
    schema = "batch bigint, n bigint, late bigint, newest bigint"

    def step(batch: DataFrame, batch_id: int) -> None:
        # the row before holds the newest event so far
        seen = spark.read.schema(schema).parquet(f"{out}/b={batch_id - 1}").first()["newest"] if batch_id > 0 else None
        bound = F.lit(None).cast("bigint") if seen is None else F.lit(seen - us)
        t = F.unix_micros(ts)
        batch.agg(F.lit(batch_id).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("n"),
                  F.count_if(F.coalesce(t < bound, F.lit(False))).alias("late"),
                  F.greatest(F.max(t), F.lit(seen).cast("bigint")).alias("newest")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.option("checkpointLocation", ck).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/b=*").select("batch", "n", "late")


def incident_sink(incidents: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Exactly-once incident files."""
    return (incidents.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
