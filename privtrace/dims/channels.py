"""Channel dimension and the three weight profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import local_table

# --- fixed values -----------------------------------------------------------
# id, long name, display name, visibility, side, risk
CHANNELS = [
    ("C1", "C1_final_output", "Final Output", "user", "external", "high"),
    ("C2", "C2_inter_agent", "Inter-Agent Messages", "internal", "internal", "high"),
    ("C3", "C3_tool_input", "Tool Inputs", "tool_provider", "external", "medium"),
    ("C4", "C4_tool_output", "Tool Outputs", "internal", "external", "medium"),
    ("C5", "C5_memory_write", "Memory Writes", "persistent", "internal", "high"),
    ("C6", "C6_log", "Logs & Telemetry", "admin", "external", "medium"),
    ("C7", "C7_artifact", "Persisted Artifacts", "user", "external", "high"),
]
CHANNEL_IDS = ["C1", "C2", "C3", "C4", "C5", "C6", "C7"]
INTERNAL = ["C2", "C5"]
EXTERNAL = ["C1", "C3", "C4", "C6", "C7"]
LOG_CHANNEL = "C6"

# "channel": weights of the channel catalogue; "detect": weights of the span
# detector; "metric": weights of the metrics module.
WEIGHT_PROFILES = {
    "channel": {"C1": 1.0, "C2": 0.9, "C3": 0.8, "C4": 0.6, "C5": 0.7, "C6": 0.5, "C7": 1.0},
    "detect": {"C1": 1.0, "C2": 0.9, "C3": 0.8, "C4": 0.7, "C5": 0.85, "C6": 0.5, "C7": 1.0},
    "metric": {"C1": 1.0, "C2": 1.0, "C3": 0.8, "C4": 0.7, "C5": 1.0, "C6": 0.5, "C7": 0.9},
}
DEFAULT_WEIGHT = {"channel": 1.0, "detect": 0.5, "metric": 1.0}

SENSITIVITY_WEIGHTS = {
    "ssn": 1.0,
    "diagnosis": 1.0,
    "case_id": 0.9,
    "account_number": 0.9,
    "credit_card": 0.95,
    "phone": 0.6,
    "email": 0.5,
    "address": 0.7,
    "dob": 0.7,
    "salary": 0.8,
    "name": 0.4,
}

CLEARANCE = {"public": 0, "restricted": 1, "confidential": 2, "secret": 3}
# ---------------------------------------------------------------------------


def dim_channel(spark: SparkSession, profile: str = "channel") -> DataFrame:
    weights = WEIGHT_PROFILES[profile]
    rows = [(*c, weights[c[0]]) for c in CHANNELS]
    return local_table(spark, rows, "channel string, long_name string, display_name string, visibility string, side string, risk string, weight double"
    )
