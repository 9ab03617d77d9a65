"""Reward scoring: renormalised means, strict success, gates, and the three reward modes, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import scalars

# Weights and coefficients of the legacy mode.
NORMAL_WEIGHTS = {"db": 0.30, "official_communicate": 0.15, "required_action": 0.30, "judge_semantic": 0.25}
TRANSFER_WEIGHTS = {"transfer_call": 0.30, "pre_transfer_actions": 0.25, "transfer_communication": 0.20, "transfer_semantic": 0.25}
PROGRESS_COEFFICIENT, STRICT_COEFFICIENT, TRUNCATION_FACTOR, PROGRESS_SCALE = 0.75, 0.25, 0.75, 0.5


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the components that apply (are not null), with weights renormalised; 0 where none applies."""
    total = reduce(Column.__add__, [F.when(v.isNotNull(), v * weights[k]).otherwise(0.0) for k, v in values.items()])
    weight = reduce(Column.__add__, [F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items()])
    return F.when(weight > 0, total / weight).otherwise(0.0)


def strict_success(values: dict[str, Column]) -> Column:
    """1 if some component applies and all that apply are 1, else 0."""
    ok = reduce(Column.__and__, [v.isNull() | (v == 1.0) for v in values.values()])
    some = reduce(Column.__or__, [v.isNotNull() for v in values.values()])
    return (ok & some).cast("double")


def component_mean(components: DataFrame, weights: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """The weighted mean and strict success from long rows (component, value; null: does not apply)."""
    rows = components.join(weights, "component").where(F.col("value").isNotNull())
    return rows.groupBy(by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("progress"), F.every(F.col("value") == 1.0).cast("double").alias("strict"))


def judge_component(checks: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Share of passed checks; no row without checks."""
    return checks.groupBy(by).agg(F.avg(F.col("passed").cast("double")).alias("value"))


def policy_gate(checks: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """True where every applicable check passes."""
    return checks.groupBy(by).agg(F.every(F.col("passed") | ~F.col("applicable")).alias("policy_gate"))


def legacy(progress: Column, strict: Column, penalty: Column, reason: Column, gate: Column) -> Column:
    raw = scalars.clip(PROGRESS_COEFFICIENT * progress + STRICT_COEFFICIENT * strict - penalty)
    return F.when(gate, raw).otherwise(0.0) * scalars.truncation_multiplier(reason, TRUNCATION_FACTOR)


def strict_progress(strict: Column, phi_end: Column, penalty: Column, reason: Column, gate: Column) -> Column:
    raw = scalars.truncation_multiplier(reason, TRUNCATION_FACTOR) * (strict + PROGRESS_SCALE * phi_end) - penalty
    return F.when(gate, F.greatest(F.lit(0.0), raw)).otherwise(0.0)


def turn_local(completion: Column, progress: Column, reason: Column, zero: Column | None = None) -> Column:
    """No gate and no scalar penalty; ``zero``: whether the zero-truncation policy applies, which goes before all."""
    raw = F.greatest(F.lit(0.0), scalars.truncation_multiplier(reason, TRUNCATION_FACTOR) * (completion + PROGRESS_SCALE * progress))
    return raw if zero is None else F.when(zero, F.lit(0.0)).otherwise(raw)


def transfer_valid(transferred: Column, allowed: Column, judged: Column, judge_valid: Column) -> Column:
    """Rules of the first version: executed, allowed, and not rejected by a judge that looked."""
    return transferred & allowed & F.when(judged, judge_valid).otherwise(True)


def transfer_valid_v2(transferred: Column, required: Column, forbidden: Column, judged: Column, judge_valid: Column) -> Column:
    return transferred & ~(forbidden & ~required) & judged & judge_valid


def transfer_scores(values: dict[str, Column], valid: Column, self_caused: Column, dynamic: bool) -> tuple[Column, Column]:
    """(progress, strict) of the transfer branch; under the dynamic rules an invalid or self-caused transfer earns nothing."""
    progress, strict = weighted_mean(values, TRANSFER_WEIGHTS), strict_success(values)
    if not dynamic:
        return progress, strict
    void = ~valid | self_caused
    return F.when(void, 0.0).otherwise(progress), F.when(void, 0.0).otherwise(strict)


def uses_transfer_branch(by_annotation: bool, required: Column, executed: Column) -> Column:
    """By what the annotation requires in the later rules, by what happened in the first ones."""
    return F.coalesce(required if by_annotation else executed, F.lit(False))
