"""Schemas of trajectory records and their parts, and the rules their rows must meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "official": "reward double, db_applicable boolean, db_score double, communicate_applicable boolean, communicate_partial double, communicate_all boolean",
    "event": "event_id string, sequence int, turn_id int, name string, arguments string, success boolean, db_effect boolean, error_kind string, execution_status string, unchanged_retry boolean, no_progress boolean, result string, state_before string, db_hash_before string, db_hash_after string, query_state_before string, query_state_after string, query_state_scope string, query_state_version string, duplicate_query boolean, duplicate_of_event_id string",
    "message": "role string, content string, name string, tool_calls array<struct<id:string,name:string,arguments:string>>, error boolean",
    "check": "criterion_id string, passed boolean, applicable boolean, evidence_turn_ids array<int>, violation_assistant_turn_ids array<int>, short_reason string",
    "token_turn": "assistant_turn_index int, prompt_token_ids array<int>, output_token_ids array<int>, output_old_log_probs array<double>",
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _nested(name: str) -> str:
    return "struct<" + ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in _split(_DDL[name])) + ">"


def _split(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


#: One row for each trajectory; free-form parts stay JSON strings.
TRAJECTORY_DDL = (
    "trajectory_id string, task_id string, split string, policy_version bigint, schema_version string, annotation_version string, reward_version string, environment_seed bigint, termination_reason string, assistant_turns int, trajectory_tokens int, "
    f"official {_nested('official')}, custom_reward struct<branch:string, reward_mode:string, train_reward:double, strict_success:double, progress:double, policy_gate:boolean, task_safety_gate:boolean, process_penalty:double, components:map<string,struct<applicable:boolean,value:double>>, details:string>, "
    f"tool_events array<{_nested('event')}>, messages array<{_nested('message')}>, judge_checks array<{_nested('check')}>, token_turns array<{_nested('token_turn')}>, metadata string, scoring_inputs string"
)
CREDIT_ROW_DDL = "uid string, session int, trajectory_id string, task_id string, policy_version bigint, checkset_fingerprint string, initial_state_fingerprint string, score double, terminal_success double, final_progress double, multiplier double, valid boolean, phi array<double>, response_turn_ids array<int>, turn_costs array<double>, labels array<struct<turn_index:int,bad_turn:boolean,eligible_correct_refusal:boolean>>"
SFT_ROW_DDL = "sample_id string, source_dialog_id string, turn_index int, messages array<struct<role:string,content:string,name:string,tool_calls:array<struct<name:string,arguments:string>>>>, tools_json string"

# Enumerations of records.
TERMINATIONS = (
    "agent_stop", "user_stop", "human_transfer", "environment_terminated", "budget_exhausted", "generation_truncated", "hard_turn_limit", "infrastructure_failure",
    "max_steps", "timeout", "too_many_errors", "agent_error", "user_error", "infrastructure_error", "context_window_exceeded", "unexpected_error",
)


def trajectory_rules() -> dict[str, Column]:
    """Rules of a trajectory row, for ``checked``."""
    return {
        "identity": F.col("trajectory_id").isNotNull() & F.col("task_id").isNotNull(),
        "termination": F.col("termination_reason").isin(*TERMINATIONS),
        "token_lengths": F.forall("token_turns", lambda t: F.size(t["output_token_ids"]) == F.size(t["output_old_log_probs"])),
        "inapplicable_checks_pass": F.forall("judge_checks", lambda c: c["applicable"] | (c["passed"] & (F.coalesce(F.size(c["violation_assistant_turn_ids"]), F.lit(0)) == 0))),
        "components": F.forall(F.map_values("custom_reward.components"), lambda c: c["applicable"] == c["value"].isNotNull()),
        "turn_order": F.transform("token_turns", lambda t: t["assistant_turn_index"]) == F.array_sort(F.array_distinct(F.transform("token_turns", lambda t: t["assistant_turn_index"]))),
    }


def credit_rules() -> dict[str, Column]:
    """Rules of a credit row: phi from 0 within [0, 1], one more value than turns, a mapping onto those turns that owns a token."""
    turns = F.size("phi") - 1
    return {
        "phi_start": F.try_element_at("phi", F.lit(1)) == 0,
        "phi_range": F.forall("phi", lambda x: x.between(0.0, 1.0)),
        "costs": F.size("turn_costs") == turns,
        "mapping": F.forall("response_turn_ids", lambda t: (t >= -1) & (t < turns)),
        "owns_tokens": F.exists("response_turn_ids", lambda t: t >= 0),
        "multiplier": F.col("multiplier").isin(0.0, 0.75, 1.0),
    }


def mask_rules(mask: str, log_probs: str, n_policy: str) -> dict[str, Column]:
    """A binary mask with as many ones as policy tokens, and no log probability where it is 0."""
    return {
        "binary": F.forall(mask, lambda m: m.isin(0, 1)),
        "sum": F.aggregate(mask, F.lit(0), lambda a, m: a + m) == F.col(n_policy),
        "aligned": F.size(mask) == F.size(log_probs),
        "masked_zero": F.forall(F.arrays_zip(mask, log_probs), lambda z: (z[mask] == 1) | (z[log_probs] == 0)),
    }
