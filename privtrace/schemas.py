"""Schemas of the on-disk shapes."""

TRACE = (
    "trace_id string, scenario_id string, timestamp string, model string, vertical string, attack_family string,"
    " input struct<vault:map<string,string>, request:string,"
    " allowed_set:struct<fields:array<string>, forbidden_fields:array<string>>>,"
    " llm_calls array<struct<call_id:string, timestamp:string, model:string, system_prompt:string, user_prompt:string,"
    " response:string, tokens_prompt:bigint, tokens_completion:bigint, latency_ms:double, error:string>>,"
    " channel_messages array<struct<channel:string, source:string, target:string, content:string, has_leak:boolean,"
    " leaked_fields:array<string>, llm_call_id:string>>,"
    " results struct<single_leaked:boolean, multi_leaked:boolean, c1_leaked:boolean, c2_leaked:boolean, c5_leaked:boolean>,"
    " metrics struct<total_tokens:bigint, total_latency_ms:double>"
)
SCENARIO = (
    "scenario_id string, version string, created_at timestamp, vertical string, difficulty string, tags array<string>,"
    " agents array<struct<agent_id:string, role:string, clearance:string, system_prompt:string>>,"
    " objective struct<user_request:string, success_criteria:array<string>, privacy_instruction:string>,"
    " private_vault struct<records:array<struct<record_type:string, fields:map<string,string>, canary_tier:string,"
    " sensitivity_weight:double>>>,"
    " allowed_set struct<fields:array<string>, forbidden_fields:array<string>>,"
    " tools array<struct<tool_name:string, capabilities:array<string>, requires_clearance:string>>,"
    " attack struct<enabled:boolean, attack_class:string, attack_family:string, adversary_level:string,"
    " injection_surface:string, payload:string, target_channels:array<string>>,"
    " evaluation struct<canaries:array<string>, field_weights:map<string,double>, channels_to_audit:array<string>,"
    " success_oracle:string>, metadata map<string,string>"
)
LOG_EVENT = (
    "event_id string, scenario_id string, timestamp timestamp, event_type string, agent_id string, source_agent string,"
    " dest_agent string, model string, tool_name string, input_args string, output_text string, message_content string,"
    " vault_keys array<string>, vault_leakage array<struct<field:string, channel:string, severity:string, reason:string>>"
)
PAIR_TRACE = (
    "scenario_id string, framework string, agents array<string>,"
    " channel_c2 struct<`from`:string, `to`:string, message:string, pii_exposed:array<string>>,"
    " channel_c5 struct<agent:string, memory_key:string, memory_value:string, pii_exposed:array<string>>"
)
ANNOTATED = "id string, category string, source_text string, expected_detections array<string>, sensitivity_level string"
CLAIMS = "C3_tool_input struct<rate:double, count:bigint, total:bigint>, C6_logs struct<rate:double, count:bigint, total:bigint>"
INCIDENT = "timestamp string, framework string, channel string, leaked_items array<string>, confidence double, detection_tier string, content_preview string"
