"""Checks of saved runs: group audits, batch membership, traces, replays, optimizer metrics, screens and validation coverage.

Each check is a frame of what is wrong, empty for sound data, or a set of rules for ``checked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions.scalars import MUTATING_TOOLS, SIGNAL_TOLERANCE
from rollmill.operators.querystate import UNEXECUTED_ERRORS

CLOSE = 1e-12
SUBGOAL_BUDGET = BONUS_CAP = 0.5


def near(a: Column, b: Column, tolerance: float = CLOSE) -> Column:
    return F.abs(a - b) <= tolerance


def validation_coverage(groups: DataFrame) -> DataFrame:
    """Requested, completed and failed slots and failed groups, of groups (rollout_n, completed, failed); one row."""
    requested, completed = F.coalesce(F.sum("rollout_n"), F.lit(0)), F.coalesce(F.sum("completed"), F.lit(0))
    return groups.agg(
        requested.alias("requested_slots"),
        completed.alias("completed_slots"),
        (requested - completed).alias("failed_slots"),
        F.count_if("failed").alias("failed_groups"),
        F.coalesce(F.try_divide(completed, requested), F.lit(0.0)).alias("completion_rate"),
        (completed == 0).cast("int").alias("empty"),
    )


def changed_audits(saved: DataFrame, new: DataFrame, key: str = "uid", report: str = "report") -> DataFrame:
    """Keys whose saved report is another one; a write-once audit demands that there are none."""
    both = new.alias("n").join(saved.alias("s"), F.col(f"n.{key}") == F.col(f"s.{key}"))
    return both.where(~F.col(f"n.{report}").eqNullSafe(F.col(f"s.{report}"))).select(F.col(f"n.{key}").alias(key))


def group_faults(groups: DataFrame, credited: DataFrame, size: int, tolerance: float = 1e-9) -> DataFrame:
    """(uid, fault) of saved groups (uid, members: queue keys, failed: sessions, decision) against credit computed anew.

    credited: uid, trajectory_id, saved and advantage (the arrays of the saved and of the new token
    advantages; saved is null where the group's audit lacks the trajectory).
    """
    sessions = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.coalesce("failed", F.array().cast("array<int>")))
    expected = F.transform(sessions, lambda i: F.concat_ws("_", F.col("uid"), i.cast("string"), F.lit("0")))
    off = lambda a, b: (F.size(a) != F.size(b)) | F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce(F.abs(z["a"] - z["b"]) > tolerance, F.lit(True)))
    credit = credited.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("trajectory_id").alias("n_distinct"),
        F.bool_or(F.col("saved").isNull() | off(F.col("saved"), F.col("advantage"))).alias("off"),
        F.bool_or(F.exists("advantage", lambda x: F.abs(x) > SIGNAL_TOLERANCE)).alias("signal"),
    )
    joined = groups.join(credit, "uid", "left")
    decision = F.when(F.coalesce("signal", F.lit(False)), "has_signal").otherwise("all_zero_advantage")
    faults = F.array_compact(
        F.array(
            F.when(F.col("members") != expected, F.lit("members")),
            F.when(F.coalesce("n", F.lit(0)) != F.size(expected), F.lit("inputs")),
            F.when(F.coalesce(F.col("n") != F.col("n_distinct"), F.lit(False)), F.lit("repeated_trajectory")),
            F.when(F.coalesce("off", F.lit(False)), F.lit("advantages")),
            F.when(~F.col("decision").eqNullSafe(decision), F.lit("decision")),
        )
    )
    return joined.select("uid", F.explode(faults).alias("fault"))


def fingerprint_differences(rows: DataFrame, columns: dict[str, Column], key: str) -> DataFrame:
    """(key, column) of stored fingerprints that are not those computed anew (columns: stored name -> fingerprint)."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(name).eqNullSafe(new), F.lit(name)) for name, new in columns.items()]))
    return rows.select(key, F.explode(wrong).alias("column"))


def optimizer_metric_rules(iterations: int) -> dict[str, Column]:
    """loss and grad_norm, arrays of doubles: one finite value for each iteration."""
    out = {}
    for name in ("grad_norm", "loss"):
        finite = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        out[f"{name}_count"], out[f"{name}_finite"] = F.size(name) == iterations, finite
    return out


def progress_trace_rules(turns: str = "turns", dedup: str = "progress-v2") -> dict[str, Column]:
    """Rules of progress traces (version, checks: check_id, initial, included; check_values; phi)."""
    checks, values, phi, n = F.col("checks"), F.col("check_values"), F.col("phi"), F.col(turns)
    ids = F.transform(checks, lambda c: c["check_id"])
    has_db = F.array_contains(ids, "db")
    included = lambda c: ~c["initial"] & ~((F.col("version") == dedup) & has_db & c["check_id"].startswith("req:"))
    share = lambda state: F.aggregate(F.zip_with(checks, state, lambda c, v: (c["included"] & v).cast("int")), F.lit(0), lambda a, x: a + x) / F.greatest(F.size(F.filter(checks, lambda c: c["included"])), F.lit(1))
    return {
        "check_ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "included": F.forall(checks, lambda c: c["included"] == included(c)),
        "states": (F.size(values) == n + 1) & F.forall(values, lambda s: (F.size(s) == F.size(checks)) & F.forall(s, lambda v: v.isNotNull())),
        "initial": F.try_element_at(values, F.lit(1)) == F.transform(checks, lambda c: c["initial"]),
        "phi": (F.size(phi) == n + 1) & (F.try_element_at(phi, F.lit(1)) == 0) & F.forall(phi, lambda p: p.between(0.0, 1.0)),
        "fractions": F.forall(F.zip_with(phi, values, lambda p, s: near(p, share(s))), lambda ok: ok),
    }


def subgoal_trace_rules(turns: str = "turns") -> dict[str, Column]:
    """Rules of subgoal traces (goal_ids, initial, check_values, phi, positive, negative, turn_credits, violating, wrong_writes; turns from 0)."""
    ids, initial, values, n = F.col("goal_ids"), F.col("initial"), F.col("check_values"), F.col(turns)
    weight = F.coalesce(F.try_divide(F.lit(SUBGOAL_BUDGET), F.size(ids)), F.lit(0.0))
    flat = lambda c: F.flatten(F.col(c))
    once = lambda c: F.size(F.array_distinct(flat(c))) == F.size(flat(c))
    blocked = F.array_union("violating", "wrong_writes")
    at = lambda goal: F.array_position(ids, goal).cast("int")
    true_after = lambda goals, t: F.forall(goals, lambda g: ~F.try_element_at(initial, at(g)) & F.try_element_at(F.try_element_at(values, t + 2), at(g)))
    met = lambda state: F.size(F.filter(state, lambda v: v)) / F.greatest(F.size(ids), F.lit(1))
    return {
        "goals": F.size(F.array_distinct(ids)) == F.size(ids),
        "states": (F.size(values) == n + 1) & F.forall(values, lambda s: F.size(s) == F.size(ids)) & (F.try_element_at(values, F.lit(1)) == initial),
        "phi": (F.size("phi") == n + 1) & F.forall(F.zip_with(F.col("phi"), values, lambda p, s: near(p, met(s))), lambda ok: ok),
        "lengths": (F.size("positive") == n) & (F.size("negative") == n) & (F.size("turn_credits") == n),
        "known_goals": F.size(F.array_except(F.concat(flat("positive"), flat("negative")), ids)) == 0,
        "once": once("positive") & once("negative"),
        "blocked": F.forall(F.transform("positive", lambda p, t: (F.size(p) == 0) | ~F.array_contains(blocked, t)), lambda ok: ok),
        "came_true": F.forall(F.transform("positive", true_after), lambda ok: ok),
        "credits": F.forall(F.transform("turn_credits", lambda c, t: near(c, weight * (F.size(F.try_element_at("positive", t + 1)) - F.size(F.try_element_at("negative", t + 1))))), lambda ok: ok),
    }


def completion_trace_rules(turns: str = "turns") -> dict[str, Column]:
    """Rules of completion traces (official, db: by prefix; regressions, first_success: turns from 1; first_safe, floor_turn, bonus, db_positive, violating: turns from 0)."""
    done, db, n, bonus = F.col("official"), F.col("db"), F.col(turns), F.col("bonus")
    after = F.slice(done, F.lit(2), n)
    first = F.when(~F.try_element_at(done, F.lit(1)) & F.exists(after, lambda v: v), F.array_position(after, True).cast("int"))
    ran = lambda t: F.try_element_at(db, t) & ~F.try_element_at(db, t + 1) & F.exists(F.slice(done, F.lit(1), t), lambda v: v)
    safe = F.coalesce("first_safe", F.lit(False))
    expected_floor = F.when((F.size("regressions") > 0) & safe, F.col("first_success"))
    paid = F.aggregate(bonus, F.lit(0.0), lambda a, x: a + x)
    return {
        "lengths": (F.size(done) == n + 1) & (F.size(db) == n + 1) & (F.size(bonus) == n),
        "db_of_success": F.forall(F.zip_with(done, db, lambda a, b: ~a | b), lambda ok: ok),
        "first_success": F.col("first_success").eqNullSafe(first),
        "safe": ~safe | (F.col("first_success").isNotNull() & ~F.array_contains("violating", F.col("first_success") - 1)),
        "floor": F.col("floor_turn").eqNullSafe(expected_floor),
        "regressions": (F.col("regressions") == F.array_sort(F.array_distinct("regressions"))) & F.forall("regressions", lambda t: t.between(F.lit(1), n) & ran(t)),
        "bonus": F.forall(F.transform(bonus, lambda v, i: v.between(0.0, BONUS_CAP) & ((v == 0) | ((F.col("floor_turn") == i + 1) & ~F.array_contains("violating", i)))), lambda ok: F.coalesce(ok, F.lit(False))),
        "budget": F.col("db_positive") + paid <= BONUS_CAP + CLOSE,
    }


def credit_row_rules(scale: float = 0.5) -> dict[str, Column]:
    """Cross-checks of what a credit row is built from.

    Columns: local_only, gates (policy and safety), terminal, progress, phi_last, multiplier,
    process_penalty, train_reward, checkset and saved_checkset, violating (turns), attributed
    (complete), policy_rewards, mapping (token turns), turns, process_total, turn_costs, and the
    strict and official success that the reward names.
    """
    col = F.col
    gained = col("multiplier") * (col("terminal") + scale * col("progress"))
    local = col("local_only")
    expected = F.when(local, F.greatest(F.lit(0.0), gained)).when(col("gates"), F.greatest(F.lit(0.0), gained - col("process_penalty"))).otherwise(0.0)
    rewards = F.when(col("turns") > 0, F.transform(F.sequence(F.lit(0), col("turns") - 1), lambda t: F.when(F.array_contains("violating", t), -1.0).otherwise(0.0)))
    total = F.aggregate("turn_costs", F.lit(0.0), lambda a, x: a + x)
    return {
        "checkset": col("checkset") == col("saved_checkset"),
        "progress": near(col("progress"), col("phi_last")),
        "train_reward": near(col("train_reward"), expected),
        "attribution": ~local | col("attributed"),
        "policy_rewards": ~local | (col("policy_rewards") == rewards),
        "violations_own_tokens": ~local | (F.size(F.array_except("violating", "mapping")) == 0),
        "mapping": F.forall("mapping", lambda t: t.between(F.lit(-1), col("turns") - 1)),
        "turn_costs": F.size("turn_costs") == col("turns"),
        "process_total": near(col("process_total"), total) & near(col("process_penalty"), F.when(local, F.lit(0.0)).otherwise(col("process_total"))),
    }


def credit_rows(members: DataFrame, progress: DataFrame, policy: DataFrame, costs: DataFrame, mapping: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """The credit row of each trajectory, joined from its parts, each with one row for each trajectory.

    members: by, task_id, policy_version, score, valid, terminal, multiplier; progress: by, phi (an
    array by prefix), checkset; policy: by, violating, attributed; costs: by, turn_costs; mapping: by,
    response_turn_ids. A missing policy or cost row stands for no violation and no cost.
    """
    rows = members.join(progress, by).join(mapping, by).join(policy, by, "left").join(costs, by, "left")
    turns = F.size("phi") - 1
    zeros = F.when(turns > 0, F.array_repeat(F.lit(0.0), turns)).otherwise(F.array().cast("array<double>"))
    return rows.withColumns(
        {
            "turns": turns,
            "violating": F.coalesce("violating", F.array().cast("array<int>")),
            "attributed": F.coalesce("attributed", F.lit(True)),
            "turn_costs": F.coalesce("turn_costs", zeros),
            "phi_last": F.try_element_at("phi", F.lit(-1)),
        }
    )


def credit_metrics(groups: DataFrame, tokens: DataFrame, size: int = 8) -> DataFrame:
    """One row: partial groups, groups of constant scores that still have a signal, tokens and the share of them with an advantage.

    groups: members, score_std, has_signal; tokens: advantages (an array for each trajectory), mask.
    """
    per = tokens.select(F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("active"), F.size(F.filter(F.arrays_zip(F.col("advantages").alias("a"), F.col("mask").alias("m")), lambda z: (z["m"] == 1) & (z["a"] != 0))).alias("moved"))
    sums = per.agg(F.coalesce(F.sum("active"), F.lit(0)).alias("active_tokens"), F.coalesce(F.try_divide(F.sum("moved"), F.sum("active")), F.lit(0.0)).alias("nonzero_token_fraction"))
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("members") < size).alias("partial_groups"), F.count_if((F.col("score_std") == 0) & F.col("has_signal")).alias("constant_score_with_turn_signal")
    ).crossJoin(sums)


def completion_summary(traces: DataFrame) -> DataFrame:
    """Counts over completion traces (official, regressions, bonus, floor_turn, db_positive, final_reward); one row, with the trajectories paid twice."""
    paid = F.aggregate("bonus", F.lit(0.0), lambda a, x: a + x)
    undone = F.size("regressions") > 0
    return traces.agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.coalesce(F.sum(F.size("regressions")), F.lit(0)).alias("regression_turns"),
        F.count_if(undone).alias("regression_trajectories"),
        F.count_if(undone & F.try_element_at("official", F.lit(1))).alias("initially_complete_regression_trajectories"),
        F.count_if(paid > 0).alias("completion_bonus_trajectories"),
        F.count_if(F.col("floor_turn").isNotNull()).alias("completion_floor_trajectories"),
        F.count_if(undone & (F.col("final_reward") == 1)).alias("recovered_final_success_trajectories"),
        F.count_if(F.col("db_positive") + paid > BONUS_CAP + CLOSE).alias("double_reward_trajectories"),
    )


def prefix_differences(saved: DataFrame, replayed: DataFrame, by: str = "trajectory_id", turn: str = "prefix") -> DataFrame:
    """Prefixes whose saved check (value) is not the replay's, those of one side alone included."""
    s, r = saved.select(by, turn, F.col("value").alias("saved")), replayed.select(by, turn, F.col("value").alias("replayed"))
    return s.join(r, [by, turn], "full").where(~F.col("saved").eqNullSafe(F.col("replayed")))


def replay_differences(events: DataFrame, replayed: DataFrame) -> DataFrame:
    """(event_id, fault) of effective calls against their replay (event_id, ok, result, changed): success, result and effect must agree."""
    ran = F.col("name").isin(*MUTATING_TOOLS) & F.col("execution_status").isNull() & ~F.coalesce(F.col("error_kind").isin(*UNEXECUTED_ERRORS), F.lit(False))
    r = replayed.select("event_id", F.col("ok").alias("__ok"), F.col("result").alias("__result"), F.col("changed").alias("__changed"))
    rows = events.where(ran).join(r, "event_id", "left")
    faults = F.array_compact(
        F.array(
            F.when(F.col("__ok").isNull(), F.lit("not_replayed")),
            F.when(F.col("success") != F.col("__ok"), F.lit("success")),
            F.when(F.col("success") & F.col("__ok") & ~F.col("result").eqNullSafe(F.col("__result")), F.lit("result")),
            F.when(F.col("__ok").isNotNull() & ~F.col("db_effect").eqNullSafe(F.col("__changed")), F.lit("db_effect")),
        )
    )
    return rows.select("event_id", F.explode(faults).alias("fault"))


def broken_states(events: DataFrame, by: str = "trajectory_id", order: str = "sequence") -> DataFrame:
    """Events whose state before is not the state that the event before them left, or whose effect their own states deny."""
    left = F.lag("db_hash_after").over(W.partitionBy(by).orderBy(order))
    torn = left.isNotNull() & ~F.col("db_hash_before").eqNullSafe(left)
    denied = ~F.coalesce(F.col("db_effect"), F.lit(False)).eqNullSafe(~F.col("db_hash_before").eqNullSafe(F.col("db_hash_after")))
    rows = events.withColumn("torn", torn).withColumn("denied", denied)
    return rows.where("torn or denied").select(by, "event_id", "torn", "denied")


def screen_faults(rows: DataFrame, projected: Column, version: str, key: str = "trajectory_id") -> DataFrame:
    """(key, fault) of saved screens: inputs (JSON) with their hash, filter_version; ``projected`` is the JSON projected anew from the saved transcript."""
    faults = F.array_compact(
        F.array(
            F.when(~F.sha2("inputs", 256).eqNullSafe(F.col("inputs_sha256")), F.lit("hash")),
            F.when(~F.col("inputs").eqNullSafe(projected), F.lit("conversation")),
            F.when(~F.col("filter_version").eqNullSafe(F.lit(version)), F.lit("version")),
        )
    )
    return rows.select(key, F.explode(faults).alias("fault"))


def verdict_rules() -> dict[str, Column]:
    """Rules of a simulation's verdict (user_sim_valid, violations with a reply index and evidence, n_replies)."""
    return {
        "consistent": F.col("user_sim_valid") == (F.size("violations") == 0),
        "replies": F.forall("violations", lambda v: v["reply_index"].between(F.lit(0), F.col("n_replies") - 1)),
        "evidence": F.forall("violations", lambda v: F.length(F.trim(v["evidence"])) > 0),
    }


def overlapping(splits: DataFrame, key: str = "task_id", split: str = "split") -> DataFrame:
    """Keys that stand in more than one split, with the splits; splits demand that there are none."""
    return splits.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
