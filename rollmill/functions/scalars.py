"""Column functions: the scalar rules of rollouts, rewards and curation. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and constants that results must agree on.
TRUNCATION_REASONS = ("budget_exhausted", "generation_truncated", "hard_turn_limit", "max_steps", "context_window_exceeded")
EXTERNAL_STOPS = ("budget_exhausted", "hard_turn_limit", "generation_truncated")
NORMAL_STOPS = ("user_stop", "agent_stop")
MUTATING_TOOLS = ("book_reservation", "cancel_reservation", "send_certificate", "update_reservation_baggages", "update_reservation_flights", "update_reservation_passengers")
READ_ONLY_TOOLS = ("get_user_details", "get_reservation_details", "get_flight_status", "search_direct_flight", "search_onestop_flight", "list_all_airports", "calculate")
TURN_LABEL_ERRORS = ("parse_error", "unknown_tool", "schema_invalid", "model_caused_execution_error", "mixed_content_and_tool_call")
STD_EPSILON, SIGNAL_TOLERANCE, MIXED_EPSILON, SUCCESS_TOLERANCE = 1e-6, 1e-8, 1e-12, 1e-6
NEXT_DAY_MARK, NEXT_DAY_MONTH = "+1", "2024-05-"
THINK_TAG = r"(?i)</?think(?:\s[^>]*)?>"
GENERATION_END = r"(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$"
EMPHASIS = r"\*\*([^*\n]+)\*\*|__([^_\n]+)__"
JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'
TURN_END = "<|im_end|>"
#: Replies that confirm.
AFFIRMATIVES = (
    "yes",
    "yes please",
    "yes proceed",
    "yes proceed please",
    "yes please proceed",
    "yes please proceed please",
    "yes go ahead",
    "yes go ahead please",
    "yes please go ahead",
    "yes please go ahead please",
    "yes cancel it",
    "yes cancel it please",
    "yes please cancel it",
    "yes please cancel it please",
    "yes book it",
    "yes book it please",
    "yes please book it",
    "yes please book it please",
    "yes do it",
    "yes do it please",
    "yes please do it",
    "yes please do it please",
)
#: Reasons that the environment gives and a record keeps; it has one for all others.
NATIVE_TERMINATIONS = ("user_stop", "agent_stop", "max_steps", "timeout", "too_many_errors", "agent_error", "user_error", "infrastructure_error", "context_window_exceeded", "unexpected_error")
OTHER_TERMINATION, TRANSFER_TERMINATION = "environment_terminated", "human_transfer"


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """C(c,k)/C(n,k): the chance that k draws without replacement from n all succeed; null if n < k or c is outside [0, n]."""
    product = F.lit(1.0)
    for i in range(k):
        product = product * (F.greatest(c - i, F.lit(0)).cast("double") / F.when(n > i, n - i).cast("double"))
    return F.when((n >= k) & c.between(F.lit(0), n), product)


def official_success(reward: Column) -> Column:
    """Inclusive band around 1; null and NaN are no success."""
    return F.coalesce(~F.isnan(reward) & reward.between(1 - SUCCESS_TOLERANCE, 1 + SUCCESS_TOLERANCE), F.lit(False))


def exact_success(reward: Column) -> Column:
    return F.coalesce(reward == F.lit(1.0), F.lit(False))


def is_unit_score(x: Column) -> Column:
    """Finite and in [0, 1]; the column must come from a strict parse, so that booleans are null."""
    return F.coalesce(~F.isnan(x) & x.between(0.0, 1.0), F.lit(False))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def truncated(reason: Column) -> Column:
    return F.coalesce(reason.isin(*TRUNCATION_REASONS), F.lit(False))


def zero_truncated(policy: Column, reason: Column) -> Column:
    """Whether the zero-truncation policy applies to a termination reason."""
    return F.coalesce(policy == "zero", F.lit(False)) & truncated(reason)


def audited_reward(reason: Column, reward: Column) -> Column:
    """The official reward, forced to zero by an external stop."""
    return F.when(reason.isin(*EXTERNAL_STOPS), F.lit(0.0)).otherwise(reward)


def effective_reward(reason: Column, train: Column, official: Column) -> Column:
    return F.when(truncated(reason), F.lit(0.0)).otherwise(F.coalesce(train, official))


def truncation_multiplier(reason: Column, factor: float = 0.75) -> Column:
    return F.when(truncated(reason), F.lit(factor)).otherwise(F.lit(1.0))


def transform_advantage(a0: Column, bad: Column, refusal: Column) -> Column:
    """A bad turn ends at -1 or below, a correct refusal at 1 or above after a bonus of 1."""
    return F.when(bad, F.least(a0, F.lit(-1.0))).when(refusal, F.greatest(a0 + 1.0, F.lit(1.0))).otherwise(a0)


def replacement_seed(seed: Column, attempt: Column) -> Column:
    return F.pmod(seed.cast("long") + attempt.cast("long") * F.lit(10_000_019), F.lit(2**31 - 1))


def turn_seed(seed: Column, turn: Column) -> Column:
    return seed.cast("long") + turn.cast("long") * F.lit(100_003)


def slot_seed(seed: Column, task: Column, n: int, slot: Column) -> Column:
    return seed.cast("long") + task.cast("long") * F.lit(n) + slot.cast("long")


def request_key(target: Column, operation: Column) -> Column:
    return F.struct(F.lower(F.trim(target)).alias("target"), operation.alias("operation"))


def task_order(task: Column, trial: Column, row_id: Column) -> list[Column]:
    """Sort columns: integer task, integer trial (a thousand million if no integer), then id."""
    far = F.lit(1_000_000_000)
    return [F.coalesce(task.try_cast("long"), far), F.coalesce(trial.try_cast("long"), far), row_id]


def trailing_int(name: Column) -> Column:
    return F.substring_index(name, "_", -1).try_cast("long")


def queue_key(key: Column) -> Column:
    """uid, session and index of ``uid_session_index``; null if malformed."""
    parts = F.split(key, "_")
    return F.when(key.rlike(r"^[^_]+_\d+_\d+$"), F.struct(parts[0].alias("uid"), parts[1].cast("int").alias("session"), parts[2].cast("int").alias("index")))


def version_bounds(low: Column, high: Column, step: Column) -> Column:
    low, high = F.coalesce(low, step), F.coalesce(high, step)
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def has_think_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(THINK_TAG), F.lit(False))


def is_affirmative(reply: Column) -> Column:
    """Whether a reply, but for case, commas, stops and white space, is one that confirms and says nothing else."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(reply), "[,.!]", " "), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.coalesce(plain.isin(*AFFIRMATIVES), F.lit(False))


def communicates(messages: Column, info: Column) -> Column:
    """Whether the joined texts contain a piece of information, in any case."""
    return F.contains(F.lower(F.concat_ws("\n", messages)), F.lower(info))


def plain_prose(text: Column) -> Column:
    """``**Emphasis**``, ``__emphasis__`` and repeated white space away; other marks stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, EMPHASIS, "$1$2"), r"(?U)[\s\x1c-\x1f]+", " "))


def without_end(text: Column) -> Column:
    """A generation without the end tokens and the white space at its end."""
    return F.regexp_replace(text, GENERATION_END, "")


def json_tokens(text: Column) -> Column:
    """Strings, brackets, colons, commas and bare values of a text that shows JSON."""
    return F.regexp_extract_all(text, F.lit(f"({JSON_TOKEN})"), 1)


def termination(native: Column, transferred: Column) -> Column:
    """A record's termination: the environment's reason if it is a known one, else a general one; a transfer that ran replaces a stop."""
    known = F.when(native.isin(*NATIVE_TERMINATIONS), native).otherwise(OTHER_TERMINATION)
    return F.when(known.isin(*NORMAL_STOPS, OTHER_TERMINATION) & F.coalesce(transferred, F.lit(False)), F.lit(TRANSFER_TERMINATION)).otherwise(known)


def truncation_state(reason: Column, used: Column, limit: Column, train: Column, policy: Column) -> Column:
    """Whether a rollout was cut off, and whether its slot is sampled anew; only training slots are (train: of the training split, and no evaluation)."""
    occurred, cap = truncated(reason), F.when(train, limit).otherwise(0)
    return F.struct(
        occurred.alias("occurred"),
        F.when(occurred, reason).alias("reason"),
        policy.alias("policy"),
        used.alias("resamples_used"),
        cap.alias("resample_limit"),
        (occurred & train & (used < limit)).alias("will_resample"),
        (occurred & train & (limit > 0) & (used >= limit)).alias("resamples_exhausted"),
    )


def tool_turn_error(text: Column, parsed: Column, open_tag: str = "<tool_call>", close_tag: str = "</tool_call>", allow_many: bool = True) -> Column:
    """parse_error, multiple_tool_calls, mixed_content_and_tool_call or null, from tags and the number of parsed calls."""
    opened, closed = F.regexp_count(text, F.lit(open_tag)), F.regexp_count(text, F.lit(close_tag))
    blocks = F.regexp_count(text, F.lit(rf"(?s){open_tag}.*?{close_tag}"))
    outside = F.trim(F.regexp_replace(text, rf"(?s){open_tag}.*?{close_tag}", ""))
    # one end token closes a turn; others are text
    outside = F.trim(F.when(outside.endswith(TURN_END), F.left(outside, F.length(outside) - len(TURN_END))).otherwise(outside))
    return (
        F.when((opened != closed) | (opened != parsed) | (opened != blocks), F.lit("parse_error"))
        .when((opened > 1) & F.lit(not allow_many), F.lit("multiple_tool_calls"))
        .when((opened > 0) & (F.length(outside) > 0), F.lit("mixed_content_and_tool_call"))
    )


def cites_known(cited: Column, known: Column) -> Column:
    """Every cited id is a known one."""
    return F.size(F.array_except(cited, known)) == 0


def padding_rows(n: Column, minibatch: int) -> Column:
    return F.pmod(-n, F.lit(minibatch))


def leg_day(arrival: Column, date: Column) -> Column:
    """The day of the second leg: the literal next-day string if the arrival says so, else the same day."""
    return F.when(F.contains(arrival, F.lit(NEXT_DAY_MARK)), F.concat(F.lit(NEXT_DAY_MONTH), (F.substring(date, -2, 2).cast("int") + 1).cast("string"))).otherwise(date)


def loss_mask(length: Column, prompt: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: (i >= prompt).cast("int"))


def context_decision(maximum: Column, current: Column) -> Column:
    remaining = maximum - current
    return F.struct(remaining.alias("remaining"), (remaining > 0).alias("can_generate"))
