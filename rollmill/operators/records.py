"""Record-level projections and checks: official scores, transcripts, evidence, policy attribution, saved responses, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions.scalars import MUTATING_TOOLS

USER_SIM_FIELDS = ("role", "content", "tool_calls")


def official_scores(reward: Column, info: Column) -> Column:
    """A struct of DB and COMMUNICATE applicability and scores from a reward-info JSON string (null or malformed: an empty one)."""
    v = F.coalesce(F.try_parse_json(info), F.parse_json(F.lit("{}")))
    number = lambda path: F.try_variant_get(v, path, "double")
    basis = F.transform(F.coalesce(F.try_variant_get(v, "$.reward_basis", "array<string>"), F.array().cast("array<string>")), F.upper)
    db = F.coalesce(number("$.db_check.db_reward"), number("$.reward_breakdown.DB"), number("$.reward_breakdown.db"))
    met = F.transform(F.coalesce(F.try_variant_get(v, "$.communicate_checks", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>")), lambda c: F.coalesce(F.try_variant_get(c["met"], "$", "boolean"), F.lit(False)))
    n, passed = F.size(met), F.size(F.filter(met, lambda m: m))
    db_applies = F.array_contains(basis, "DB") | F.try_variant_get(v, "$.db_check", "map<string,variant>").isNotNull() | db.isNotNull()
    says = (n > 0) | F.array_contains(basis, "COMMUNICATE")
    alone = F.coalesce(number("$.reward_breakdown.COMMUNICATE"), number("$.reward_breakdown.communicate"), F.lit(1.0))
    partial = F.when(n > 0, passed / n).when(says, alone)
    return F.struct(reward.cast("double").alias("reward"), db_applies.alias("db_applicable"), F.when(db_applies, db).alias("db_score"), says.alias("communicate_applicable"), partial.alias("communicate_partial"), (partial == 1.0).alias("communicate_all"))


def transcript(messages: DataFrame, by: str = "trajectory_id", array: str = "messages") -> DataFrame:
    """One row for each message, with its place as turn_idx."""
    return messages.select(by, F.posexplode(array).alias("turn_idx", "m")).select(by, "turn_idx", "m.*")


def judge_view(messages: DataFrame) -> DataFrame:
    """Messages without the ids whose bases conflict."""
    return messages.drop("turn_idx", "assistant_turn_id")


def compacted(native: DataFrame, visible: DataFrame, by: str = "trajectory_id", order: str = "message_index") -> DataFrame:
    """Native messages with the place of the first unused visible message of equal content; content goes where there is one.

    The n-th native message of a signature takes the n-th visible one, as each is used once.
    """
    sign = F.sha2(F.to_json(F.struct("role", "content", "tool_calls")), 256)
    place = F.row_number().over(W.partitionBy(by, "__s").orderBy(order))
    left = native.withColumn("__s", sign).withColumn("__n", place)
    right = visible.withColumn("__s", sign).withColumn("__n", place).select(by, "__s", "__n", F.col(order).alias("visible_message_index"))
    out = left.join(right, [by, "__s", "__n"], "left").drop("__s", "__n")
    seen = F.col("visible_message_index").isNotNull()
    return out.withColumn("content", F.when(~seen, F.col("content"))).withColumn("tool_calls", F.when(~seen, F.col("tool_calls")))


def user_sim_inputs(messages: Column) -> Column:
    """The allowed fields of user, assistant and tool messages, and the user's replies among them."""
    kept = F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant", "tool")), lambda m: F.struct(*[m[f].alias(f) for f in USER_SIM_FIELDS]))
    return F.struct(kept.alias("conversation"), F.filter(kept, lambda m: m["role"] == "user").alias("user_replies"))


def baggage_pre_image(events: DataFrame, state: DataFrame) -> DataFrame:
    """state_before of baggage updates: the reservation and its count of paid bags (state: reservation_id, nonfree_baggages), if known and not negative."""
    known = state.where("nonfree_baggages >= 0").select("reservation_id", F.struct("reservation_id", "nonfree_baggages").alias("state_before"))
    out = events.join(known, "reservation_id", "left")
    return out.withColumn("state_before", F.when(F.col("name") == "update_reservation_baggages", F.col("state_before")))


def write_scope_of(name: Column, arguments: Column) -> Column:
    """(tool, target) of a write: the user for bookings and certificates, else the reservation; null without one."""
    by_user = name.isin("book_reservation", "send_certificate")
    target = F.when(by_user, F.get_json_object(arguments, "$.user_id")).otherwise(F.get_json_object(arguments, "$.reservation_id"))
    return F.when(name.isin(*MUTATING_TOOLS) & (F.length(target) > 0), F.struct(name.alias("name"), target.alias("target")))


def unknown_evidence(checks: DataFrame, known: DataFrame, actors: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Cited turn ids that are in neither view, and blamed turns that are no actor's (known, actors: by, turn)."""
    cited = checks.select(by, "criterion_id", F.lit("evidence").alias("kind"), F.explode("evidence_turn_ids").alias("turn")).join(known, [by, "turn"], "left_anti")
    blamed = checks.select(by, "criterion_id", F.lit("blame").alias("kind"), F.explode("violation_assistant_turn_ids").alias("turn")).join(actors, [by, "turn"], "left_anti")
    return cited.unionByName(blamed)


def criterion_gaps(verdicts: DataFrame, rubric: DataFrame, by: list[str]) -> DataFrame:
    """Criteria that only the judge or only the rubric names, and active rules that the judge called inapplicable."""
    v, r = verdicts.alias("v"), rubric.alias("r")
    on = [F.col(f"v.{c}") == F.col(f"r.{c}") for c in by]
    why = F.when(F.col(f"r.{by[-1]}").isNull(), "not_asked").when(F.col(f"v.{by[-1]}").isNull(), "not_answered").when(F.col("r.active") & ~F.col("v.applicable"), "active_but_inapplicable")
    return v.join(r, on, "full").select(*[F.coalesce(f"v.{c}", f"r.{c}").alias(c) for c in by], why.alias("gap")).where("gap is not null")


def policy_attribution(failed: DataFrame, events: DataFrame, invalid_transfers: DataFrame, by: str = "trajectory_id") -> tuple[DataFrame, DataFrame]:
    """(blamed: by, rule_id, turn from 0, source; unresolved: by, rule_id).

    failed: by, rule_id, blamed_turns (1-based), event_ids. A rule's turns come from explicit
    blame, else from its events, else, for the transfer rule, from an invalid transfer that ran;
    a rule with none of them is unresolved. An invalid transfer blames its own turns besides.
    """
    moved = invalid_transfers.select(by, "turn_id")
    explicit = failed.where(F.size("blamed_turns") > 0).select(by, "rule_id", F.explode("blamed_turns").alias("turn_id"), F.lit("judge_explicit_blame").alias("source"))
    rest = failed.where(F.coalesce(F.size("blamed_turns"), F.lit(0)) <= 0)
    by_event = rest.select(by, "rule_id", F.explode("event_ids").alias("event_id")).join(events.select(by, "event_id", "turn_id"), [by, "event_id"]).select(by, "rule_id", "turn_id", F.lit("tool_event_id").alias("source"))
    scope = rest.where((F.coalesce(F.size("event_ids"), F.lit(0)) <= 0) & F.col("rule_id").endswith(":policy:transfer_scope_and_message")).select(by, "rule_id")
    executed = scope.join(moved, by).select(by, "rule_id", "turn_id", F.lit("executed_tool").alias("source"))
    own = moved.select(by, F.lit("invalid_transfer").alias("rule_id"), "turn_id", F.lit("executed_tool").alias("source"))
    blamed = explicit.unionByName(by_event).unionByName(executed).unionByName(own).distinct()
    unresolved = failed.select(by, "rule_id").join(blamed.select(by, "rule_id").distinct(), [by, "rule_id"], "left_anti")
    return blamed.select(by, "rule_id", (F.col("turn_id") - 1).alias("turn"), "source"), unresolved


#: Rules that an attempted tool call makes apply (fixed values).
RULES_BY_TOOL = {
    "book_reservation": ("booking_cabin", "booking_passengers", "booking_payment_limits"),
    "update_reservation_passengers": ("passenger_count",),
    "cancel_reservation": ("cancellation_reason", "cancellation_eligibility"),
    "send_certificate": ("compensation_request_and_facts", "compensation_eligibility", "compensation_reason_amount"),
    "transfer_to_human_agents": ("transfer_scope_and_message",),
}


def active_rules(events: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """The least set of rules that apply (by, rule_id), from events with name, success, db_effect, error_kind and arguments.

    A call counts as attempted if it succeeded, took effect or failed in execution; the refund
    rule needs a cancellation that ran.
    """
    ran = F.col("success") | F.col("db_effect").eqNullSafe(F.lit(True))
    tried = ran | F.col("error_kind").eqNullSafe(F.lit("model_caused_execution_error"))
    name = F.col("name")
    bags = F.greatest(*[F.coalesce(F.get_json_object("arguments", f"$.{k}").try_cast("int"), F.lit(0)) for k in ("total_baggages", "nonfree_baggages")])
    rules = [
        F.lit("information_grounding"),
        F.lit("single_action_turn"),
        F.when(tried & name.isin(*MUTATING_TOOLS), F.lit("database_write_confirmation")),
        F.when(tried & name.isin(*MUTATING_TOOLS) & (name != "send_certificate"), F.lit("user_identity")),
        F.when(ran & (name == "cancel_reservation"), F.lit("refund_destination")),
        F.when(tried & (name == "book_reservation") & (bags > 0), F.lit("baggage_pricing")),
        F.when(tried & (name == "book_reservation") & (F.get_json_object("arguments", "$.insurance") == "yes"), F.lit("insurance_timing")),
        *[F.when(tried & (name == tool), F.lit(rule)) for tool, names in RULES_BY_TOOL.items() for rule in names],
    ]
    return events.select(by, F.explode(F.array_compact(F.array(*rules))).alias("rule_id")).distinct()


def baggage_changes(events: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Rules that a baggage update's counts make apply, against the reservation's latest successful read or receipt before it.

    A write without a receipt clears what is known of its reservation.
    """
    w = W.partitionBy(by, "reservation_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.get_json_object(c, "$.total_baggages").try_cast("int")
    known = F.when(F.col("success"), F.struct(total("result").alias("n"))).when(F.col("db_effect").eqNullSafe(F.lit(True)), F.struct(F.lit(None).cast("int").alias("n")))
    before = F.coalesce(F.get_json_object("state_before", "$.total_baggages").try_cast("int"), F.last(known, ignorenulls=True).over(w)["n"])
    rows = events.withColumn("__delta", total("arguments") - before).where("name = 'update_reservation_baggages'")
    return rows.where("__delta <> 0").select(by, F.when(F.col("__delta") > 0, "baggage_pricing").otherwise("baggage_removal").alias("rule_id")).distinct()


# Patterns of a reason that calls its turn bad.
QUOTED = r"\"[^\"\n]*\"|`[^`\n]*`|(?<!\w)'[^'\n]+'(?!\w)"
VERDICT = r"(?i)(?:^|[.!?;\n])\s*(?:(?:therefore|thus|so|verdict)[:,]?\s*)?(?:this is a bad turn|i(?:'ll| will) mark bad_turn true|bad_turn\s*[:=]\s*true)\s*(?:[.!;]|$)"
CONCLUSION = r"(?i),\s*making it a bad turn\s*$"
HEDGE = r"(?i)\b(?:if|unless|whether|uncertain|cannot conclude)\b"


def contradicts(reason: Column, bad: Column, refusal: Column) -> Column:
    """A label that its own reason, quotes aside, contradicts."""
    text = F.regexp_replace(reason, QUOTED, "")
    concludes = F.exists(F.split(text, r"[.!?;\n]"), lambda s: s.rlike(CONCLUSION) & ~s.rlike(HEDGE))
    return F.when(bad, refusal).otherwise(F.coalesce(text.rlike(VERDICT) | concludes, F.lit(False)))


def decision_rules(target: str = "target_message_index", evidence: str = "evidence_message_indices") -> dict[str, Column]:
    """Rules of a turn decision, for ``checked``: evidence is distinct, causal and has the target; refusals have distinct keys and agree with their flag; a revocation needs a bad turn."""
    e, t = F.col(evidence), F.col(target)
    return {
        "evidence_distinct": F.size(F.array_distinct(e)) == F.size(e),
        "evidence_causal": F.forall(e, lambda i: (i >= 0) & (i <= t)),
        "evidence_target": F.array_contains(e, t),
        "refusal_keys": F.size(F.array_distinct("refusal_keys")) == F.size("refusal_keys"),
        "refusal_flag": (F.size("refusal_keys") > 0) == F.col("correct_refusal"),
        "revocation": (F.size("revoked_turns") == 0) | (F.col("bad_turn") & F.forall("revoked_turns", lambda i: i < F.col("turn_index"))),
    }


def restored(record: DataFrame) -> DataFrame:
    """Responses rebuilt from token turns: response_ids, mask, old_log_probs, advantages (cut to what was saved), padding, and aligned.

    record: token_turns, response_turn_ids, token_advantages. aligned says that every turn's
    prompt and output stand in the final sequence and that the mapping is the one they imply.
    """
    turns = F.col("token_turns")
    first, last = F.element_at(turns, 1), F.element_at(turns, -1)
    whole = F.concat(last["prompt_token_ids"], last["output_token_ids"])
    start = F.size(first["prompt_token_ids"])
    size = F.size(whole) - start
    mapping = F.col("response_turn_ids")
    place = lambda t: F.size(t["prompt_token_ids"]) - start
    implied = F.aggregate(
        turns,
        F.array_repeat(F.lit(-1), F.size(mapping)),
        lambda a, t: F.concat(F.slice(a, F.lit(1), place(t)), F.array_repeat(t["assistant_turn_index"], F.size(t["output_token_ids"])), F.slice(a, place(t) + F.size(t["output_token_ids"]) + 1, F.size(a))),
    )
    old = F.aggregate(turns, F.array_repeat(F.lit(0.0), size), lambda a, t: F.concat(F.slice(a, F.lit(1), place(t)), t["output_old_log_probs"], F.slice(a, place(t) + F.size(t["output_token_ids"]) + 1, F.size(a))))
    stands = F.forall(turns, lambda t: (F.slice(whole, F.lit(1), F.size(t["prompt_token_ids"])) == t["prompt_token_ids"]) & (F.slice(whole, F.size(t["prompt_token_ids"]) + 1, F.size(t["output_token_ids"])) == t["output_token_ids"]))
    return record.select(
        "*",
        F.slice(whole, start + 1, size).alias("response_ids"),
        F.transform(F.slice(mapping, F.lit(1), size), lambda t: (t >= 0).cast("int")).alias("mask"),
        old.alias("old_log_probs"),
        F.slice("token_advantages", F.lit(1), size).alias("advantages"),
        (F.size(mapping) - size).alias("padding"),
        (stands & (implied == mapping) & F.forall(F.arrays_zip(mapping.alias("m"), F.col("token_advantages").alias("a")), lambda z: (z["m"] >= 0) | (z["a"] == 0))).alias("aligned"),
    )


def batch_padding(rows: DataFrame, minibatch: int) -> DataFrame:
    """``rows`` and as many padding rows (real false, nulls elsewhere) as fill the last minibatch."""
    n = rows.count()
    missing = -n % minibatch
    blank = rows.sparkSession.range(missing).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(False).alias("real"))
    return rows.withColumn("real", F.lit(True)).unionByName(blank)


def semantic_rows(tasks: DataFrame) -> DataFrame:
    """{task}:nl:{i} for each natural-language assertion."""
    return tasks.select("task_id", F.posexplode("nl_assertions").alias("i", "description")).select("task_id", F.concat_ws(":", F.col("task_id").cast("string"), F.lit("nl"), F.col("i").cast("string")).alias("criterion_id"), "description")


def policy_rows(tasks: DataFrame, rules: list[str]) -> DataFrame:
    """{task}:policy:{rule} for each rule of a stated list."""
    return tasks.select("task_id", F.explode(F.array(*map(F.lit, rules))).alias("rule")).select("task_id", F.concat_ws(":", F.col("task_id").cast("string"), F.lit("policy"), "rule").alias("criterion_id"))


def training_selection(rows: DataFrame, checks: DataFrame, mode: str = "verified_progress") -> DataFrame:
    """Adds included and reason: a task trains if an included check is unmet at the start, or in the mode that credits tasks and turns anyway."""
    unmet = checks.where("included and not initial").select("task_id").distinct().withColumn("__p", F.lit(True))
    out = rows.join(unmet, "task_id", "left")
    progress = F.coalesce("__p", F.lit(False))
    local = mode == "task_or_local_credit"
    reason = F.when(progress, "verified_unmet_progress").otherwise("task_or_local_credit" if local else "no_unmet_progress")
    return out.withColumn("included", progress | F.lit(local)).withColumn("reason", reason).drop("__p")


def annotation_gaps(actions: DataFrame, official: DataFrame, dependencies: DataFrame, splits: DataFrame) -> DataFrame:
    """(kind, task_id, what) of actions that are no official ones, dependencies between unknown or equal actions, and tasks in two splits."""
    keys = ["task_id", "name", "args_key"]
    strange = actions.join(official.select(*keys), keys, "left_anti").select(F.lit("action").alias("kind"), "task_id", F.col("action_id").alias("what"))
    ends = dependencies.select("task_id", F.explode(F.array("before", "after")).alias("action_id"))
    loose = ends.join(actions.select("task_id", "action_id"), ["task_id", "action_id"], "left_anti").select(F.lit("dependency").alias("kind"), "task_id", F.col("action_id").alias("what"))
    itself = dependencies.where("before = after").select(F.lit("dependency").alias("kind"), "task_id", F.col("before").alias("what"))
    double = splits.groupBy("task_id").agg(F.countDistinct("split").alias("n"), F.min("split").alias("what")).where("n > 1").select(F.lit("split").alias("kind"), "task_id", "what")
    return strange.unionByName(loose).unionByName(itself).unionByName(double)


def whole_observations(turns: DataFrame, budget: Column, by: str = "trajectory_id", order: str = "turn") -> DataFrame:
    """Adds fits: an observation is kept whole if it and all before it are within the budget; it is never cut."""
    used = F.sum("length").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("fits", used <= budget)


def canonical_bookings(bookings: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """New bookings with their payments in order and an id that does not depend on the order they were made in."""
    tidy = bookings.withColumn("payments", F.array_sort("payments"))
    content = F.sha2(F.to_json(F.struct(*[c for c in tidy.columns if c not in (by, "reservation_id")])), 256)
    place = F.row_number().over(W.partitionBy(by).orderBy("__c", "reservation_id")) - 1
    return tidy.withColumn("__c", content).withColumn("canonical_id", F.concat(F.lit("new-booking:"), place.cast("string"))).drop("__c")
