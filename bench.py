"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

BENCH_ALL=1 runs every registered query.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "leak_check", "audit_gap_from_text", "vault_match_filter", "dedup_leaks", "elr_wls_distinct", "channel_results",
    "find_spans", "recognizer_catalogue", "sanitize", "redact_spans", "decide_action", "check_acl",
    "data_flows", "calr_cvr", "match_tool_calls", "agent_activity",
    "benchmark_metrics", "audit_gap", "verify_claims", "model_stats", "asr",
    "pareto_frontier", "pareto_layers", "event_order", "strict_summary", "compose_set", "assemble_trace",
    "leak_rate_tumbling",
]


def main() -> None:
    from privtrace.plans import load
    from privtrace.session import local_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    reg = load()
    names = list(reg) if os.environ.get("BENCH_ALL") else HEADLINE
    # two queries first, so that the start of the JVM and of the Python workers is not counted
    for n in ("filter_events", "redact_scan"):
        reg[n].run(spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.time()
        reg[n].run(spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(n, times[n], file=sys.stderr, flush=True)
    sf = os.path.basename(d.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf else None}))


if __name__ == "__main__":
    main()
