"""Attack taxonomy: class, family, target channels, least adversary level."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import local_table

# --- fixed values -----------------------------------------------------------
ATTACKS = [
    ("direct_prompt_injection", "F1", ["C1", "C3"], "A1"),
    ("role_confusion", "F1", ["C1"], "A1"),
    ("context_override", "F1", ["C1"], "A1"),
    ("format_coercion", "F1", ["C1"], "A1"),
    ("crescendo_escalation", "F1", ["C1"], "A1"),
    ("academic_framing_bypass", "F1", ["C1"], "A1"),
    ("indirect_prompt_injection", "F2", ["C3", "C4"], "A1"),
    ("tool_output_poisoning", "F2", ["C4", "C5"], "A2"),
    ("retrieval_trap", "F2", ["C4"], "A2"),
    ("link_following_exfiltration", "F2", ["C3"], "A1"),
    ("api_parameter_injection", "F2", ["C3"], "A1"),
    ("hallucination_exploitation", "F2", ["C1"], "A1"),
    ("memory_write_exfiltration", "F3", ["C5"], "A0"),
    ("vector_store_leakage", "F3", ["C5"], "A0"),
    ("log_leakage", "F3", ["C6"], "A0"),
    ("artifact_leakage", "F3", ["C7"], "A0"),
    ("session_state_poisoning", "F3", ["C5"], "A1"),
    ("cross_agent_collusion", "F4", ["C2"], "A2"),
    ("role_boundary_violation", "F4", ["C2"], "A1"),
    ("delegation_exploit", "F4", ["C2"], "A2"),
    ("shared_memory_poisoning", "F4", ["C5", "C2"], "A2"),
    ("actor_network_manipulation", "F4", ["C2"], "A1"),
    ("consensus_manipulation", "F4", ["C2"], "A1"),
    ("orchestrator_hijacking", "F4", ["C2"], "A1"),
    ("agent_identity_spoofing", "F4", ["C2"], "A1"),
    ("logic_puzzle_jailbreak", "F5", ["C1"], "A1"),
    ("cot_forging", "F5", ["C1"], "A1"),
    ("special_token_injection", "F5", ["C1"], "A2"),
    ("reasoning_hijack", "F5", ["C1"], "A1"),
    ("word_game_obfuscation", "F5", ["C1"], "A1"),
    ("unicode_tag_smuggling", "F6", ["C1"], "A1"),
    ("text_shuffle_attack", "F6", ["C1"], "A1"),
]
FAMILY_NAMES = {
    "F1": "Prompt & Instruction Attacks",
    "F2": "Tool Surface Attacks",
    "F3": "Memory & Persistence Attacks",
    "F4": "Multi-Agent Attacks",
    "F5": "Reasoning/CoT Attacks",
    "F6": "Evasion & Obfuscation Attacks",
}
LEVELS = ["A0", "A1", "A2"]
# classes the run-metrics map knows; every other class falls back to F1 there
METRIC_CLASSES = [
    "direct_prompt_injection", "role_confusion", "context_override", "format_coercion",
    "indirect_prompt_injection", "tool_output_poisoning", "retrieval_trap", "link_following_exfiltration",
    "memory_write_exfiltration", "vector_store_leakage", "log_leakage", "artifact_leakage",
    "cross_agent_collusion", "role_boundary_violation", "delegation_exploit",
]
# what an unknown or missing class becomes, by module
FAMILY_DEFAULT = {"catalogue": "F1", "trace": "A0", "metric": "F1"}
# ---------------------------------------------------------------------------


def dim_attack(spark: SparkSession) -> DataFrame:
    rows = [(i, c, f, ch, lv, c in METRIC_CLASSES) for i, (c, f, ch, lv) in enumerate(ATTACKS)]
    return local_table(spark, rows,
        "class_idx int, attack_class string, family string, target_channels array<string>, level string, in_metric_map boolean",
    )
