"""Aggregates with hand numbers; sources; streams."""
import json

from pyspark.sql import functions as F

from privtrace.operators import flows, metrics, reshape
from privtrace.sources import readers, sinks
from privtrace.streaming import monitor

LEAK = "channel string, confidence double, sensitivity_weight double, canary_tier string"


def leaks(spark):
    return spark.createDataFrame([("C1", 1.0, 1.0, "obvious"), ("C3", 0.9, 0.6, "realistic"), ("C1", 0.85, 1.0, None)], LEAK)


def test_leakage(spark):
    r = metrics.leakage(leaks(spark), 10).first()
    assert abs(r.elr - 0.3) < 1e-9 and abs(r.wls - 2.282) < 1e-9
    assert metrics.leakage(leaks(spark), 2).first().elr == 1.0
    assert {(x.tier, x.leaks) for x in metrics.tier_breakdown(leaks(spark)).collect()} == {("obvious", 1), ("realistic", 1), ("unknown", 1)}
    assert {(x.channel, round(x.leak_rate, 6)) for x in metrics.clr(leaks(spark)).collect()} == {("C1", 0.666667), ("C3", 0.333333)}


def test_asr_and_tsr(spark):
    rows = [("direct_prompt_injection", "F1", True, True, True, "legal"), ("direct_prompt_injection", "F1", False, True, True, "legal"),
            ("log_leakage", "F3", True, False, False, "finance")]
    df = spark.createDataFrame(rows, "attack_class string, family string, leaked boolean, attack_success boolean, task_success boolean, vertical string")
    out = {(r.scope, r.name): r.asr for r in metrics.asr(df).collect()}
    assert abs(out[("overall", "all")] - 1 / 3) < 1e-9 and out[("class", "direct_prompt_injection")] == 1.0 and out[("family", "F3")] == 0.0
    assert abs({r.vertical: r.tsr for r in metrics.tsr(df).collect()}[None] - 2 / 3) < 1e-9


def test_mean_ci(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (0.6,)], "v double")
    r = metrics.mean_ci(df, "v").first()
    assert abs(r["mean"] - 0.4) < 1e-9 and abs(r["std"] - 0.2) < 1e-9 and abs(r["ci_lower"] - (0.4 - 1.96 * 0.2 / 3 ** 0.5)) < 1e-9
    one = metrics.mean_ci(df.where("v = 0.2"), "v").first()
    assert (one["mean"], one["std"], one["ci_lower"], one["ci_upper"]) == (0.2, 0.0, 0.2, 0.2)
    none = metrics.mean_ci(df.where("v > 9"), "v").first()
    assert (none["mean"], none["n"]) == (0.0, 0)


def test_wilson_published(spark):
    lo, hi = metrics.wilson_ci(F.lit(2077), F.lit(4979))
    r = spark.range(1).select(F.round(lo * 100, 1), F.round(hi * 100, 1)).first()
    assert tuple(r) == (40.4, 43.1)
    lo, hi = metrics.wilson_ci(F.lit(854), F.lit(1240))
    assert tuple(spark.range(1).select(F.round(lo * 100, 1), F.round(hi * 100, 1)).first()) == (66.2, 71.4)


def test_vault_forms(spark):
    rows = [("s", 0, "name", "Ann"), ("s", 1, "name", "Bob"), ("s", 2, "name", "Cid"), ("s", 2, "ssn", "1"), ("s", 3, "ssn", "")]
    v = spark.createDataFrame(rows, "scenario_id string, record_idx long, field string, value string")
    assert {(r.field_key, r.value) for r in reshape.vault_long_indexed(v).collect()} == {("name", "Ann"), ("name_1", "Bob"), ("name_2", "Cid"), ("ssn", "1")}
    assert {(r.field, r.value) for r in reshape.vault_long_last_wins(v.where("value <> ''")).collect()} == {("name", "Cid"), ("ssn", "1")}


def test_greedy_calls(spark):
    e = spark.createDataFrame([("s", "a", "t", 1, {"x": "1"}, []), ("s", "a", "t", 2, {"x": "1", "y": "?"}, ["y"]), ("s", "a", "t", 3, {"x": "1"}, []), ("s", "a", "u", 1, {}, [])],
                              "scenario_id string, agent_id string, tool string, call_no long, args map<string,string>, dynamic array<string>")
    a = spark.createDataFrame([("s", "a", "t", 1, {"x": "1", "y": "9"}), ("s", "a", "t", 2, {"x": "1", "y": "8"}), ("s", "a", "t", 3, {"x": "2"})],
                              "scenario_id string, agent_id string, tool string, call_no long, args map<string,string>")
    got = {(r.tool, r.call_no): r.found for r in flows.match_tool_calls_greedy(e, a).collect()}
    assert got == {("t", 1): True, ("t", 2): True, ("t", 3): False, ("u", 1): False}


def test_forbidden_flows(spark):
    s = spark.createDataFrame([("s", [("a", "secret"), ("b", "public"), ("c", "restricted")])], "scenario_id string, agents array<struct<agent_id:string,clearance:string>>")
    assert {(r.source, r.target) for r in flows.forbidden_flows(s).collect()} == {("a", "b"), ("a", "c")}


def test_traces_one_per_file(spark, tmp_path):
    doc = {"trace_id": "t1", "scenario_id": "s", "input": {"vault": {"ssn": "1"}, "request": "r"}, "channel_messages": [{"channel": "C1", "content": "x"}], "results": {"c1_leaked": True}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text("{ broken")
    t = readers.read_traces(spark, str(tmp_path))
    assert [r.trace_id for r in t.collect()] == ["t1"]
    assert reshape.explode_messages(t).first().content == "x"


def test_assemble_keeps_long_traces_whole(spark):
    t = spark.createDataFrame([("t",), ("u",)], "trace_id string")
    m = spark.createDataFrame([("t", i, f"m{i}") for i in range(25)], "trace_id string, msg_idx int, content string")
    docs = sinks.assemble_trace(t, m, part_size=10).collect()
    assert sorted((d.trace_id, d.part, len(d.channel_messages or [])) for d in docs) == [("t", 0, 10), ("t", 1, 10), ("t", 2, 5), ("u", 0, 0)]


def test_dedup_stream(spark, tmp_path):
    rows = [(1, "s", "f", "C1", "2024-01-01 00:00:00"), (2, "s", "f", "C1", "2024-01-01 00:10:00"), (3, "s", "g", "C1", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "event_id long, scenario_id string, field string, channel string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    out = monitor.run_to_table(monitor.dedup_stream(monitor.stream_parquet(spark, path)), "dedup-test")
    assert sorted(r.field for r in out.collect()) == ["f", "g"]


def test_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    for ts in ("2024-01-01 05:00:00", "2024-01-01 01:00:00"):
        spark.createDataFrame([(ts,)], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    got = sorted((r.batch, r.n, r.late) for r in monitor.late_events(monitor.stream_parquet(spark, path, 1)).collect())
    assert got == [(0, 1, 0), (1, 1, 1)]
