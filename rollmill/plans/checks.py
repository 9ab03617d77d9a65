"""Queries over the scalar rules, validators and record checks, each with its DuckDB equivalent.

The generic tables have no saved runs, so a bridge builds the fields that a rule reads, with rows
that break it. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill import schemas
from rollmill.functions import canon, scalars
from rollmill.operators import curation, evaluation, events, failures, groups, integrity, judging, progress, prompts, querystate, records, replay, scans
from rollmill.operators.common import checked, unique
from rollmill.plans import bridges as b
from rollmill.plans.catalogue import longs, query, r6

# Scalars


@query(
    b.with_(b.ROLLOUTS)
    + """, s AS NOT MATERIALIZED (SELECT *, termination IN ('hard_turn_limit') AS cut, CASE trajectory_id % 3 WHEN 0 THEN 'user_stop' WHEN 1 THEN 'max_steps' ELSE 'odd' END AS native FROM b_rollouts)
SELECT trajectory_id, CASE WHEN termination = 'hard_turn_limit' THEN 0.0::DOUBLE ELSE reward END AS audited, CASE WHEN cut THEN 0.0::DOUBLE WHEN reward = 0.5 THEN reward ELSE 0.25::DOUBLE END AS effective,
  CASE WHEN native = 'max_steps' THEN native WHEN trajectory_id % 2 = 0 THEN 'human_transfer' WHEN native = 'odd' THEN 'environment_terminated' ELSE native END AS termination,
  cut AS occurred, CASE WHEN cut THEN 'hard_turn_limit' END AS reason, CASE WHEN slot % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS resample_limit, cut AND slot % 2 = 0 AND slot < 2 AS will_resample, cut AND slot % 2 = 0 AND slot >= 2 AS exhausted,
  greatest(0, least(1, reward * 1.5 - 0.25))::DOUBLE AS clipped, reward = 1 AS exact, 24576 - floor(tokens)::BIGINT AS remaining, (-slot - 1 + 80) % 8 AS padding,
  least(policy_version, 1995)::BIGINT AS low, task_id || '_' || slot AS parsed, task_id % 5 <> 0 AS cites FROM s"""
)
def rollout_scalars(spark, sf_dir):
    """Rewards under stops, terminations, truncation, budgets, padding, version bounds and queue keys of each rollout."""
    rows = b.rollouts(spark, sf_dir)
    t, slot, stop = F.col("trajectory_id"), F.col("slot"), F.col("termination")
    native = F.when(t % 3 == 0, "user_stop").when(t % 3 == 1, "max_steps").otherwise("odd")
    cut = scalars.truncation_state(stop, slot, F.lit(2), slot % 2 == 0, F.lit("zero"))
    key = scalars.queue_key(F.concat_ws("_", F.col("task_id"), slot, F.lit(0)))
    bounds = scalars.version_bounds(F.least(F.col("policy_version"), F.lit(1995)), F.lit(None).cast("int"), F.lit(2100))
    out = rows.select(
        "trajectory_id",
        scalars.audited_reward(stop, F.col("reward")).alias("audited"),
        scalars.effective_reward(stop, F.when(F.col("reward") == 0.5, F.col("reward")), F.lit(0.25)).alias("effective"),
        scalars.termination(native, t % 2 == 0).alias("termination"),
        cut.alias("__c"),
        scalars.clip(F.col("reward") * 1.5 - 0.25).alias("clipped"),
        scalars.exact_success(F.col("reward")).alias("exact"),
        scalars.context_decision(F.lit(24576), F.floor("tokens"))["remaining"].alias("remaining"),
        scalars.padding_rows(slot + 1, 8).alias("padding"),
        bounds["low"].alias("low"),
        F.concat_ws("_", key["uid"], key["session"]).alias("parsed"),
        scalars.cites_known(F.array(F.col("task_id") % 5), F.array(*[F.lit(i).cast("long") for i in range(1, 5)])).alias("cites"),
    )
    named = {"occurred": "occurred", "reason": "reason", "resample_limit": "resample_limit", "will_resample": "will_resample", "resamples_exhausted": "exhausted"}
    return longs(out.select("*", *[F.col(f"__c.{k}").alias(v) for k, v in named.items()]).drop("__c"), "resample_limit", "remaining", "padding", "low")


@query(
    r"""WITH m AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'Yes, please  book it.' WHEN 1 THEN '**' || role || '** said __' || turn || '__ > a_b  *c*' || chr(10) || 'end' WHEN 2 THEN '<tool_call>{"name": "x", "n": ' || turn || '}</tool_call><|im_end|>' ELSE 'before <tool_call>{}</tool_call>' END AS t FROM conversations)
SELECT conv_id, turn, t = 'Yes, please  book it.' AS affirms, trim(regexp_replace(regexp_replace(t, '\*\*([^*\n]+)\*\*|__([^_\n]+)__', '\1\2', 'g'), '\s+', ' ', 'g')) AS prose, regexp_replace(t, '(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$', '') AS ended,
  CASE turn % 4 WHEN 2 THEN NULL WHEN 3 THEN 'mixed_content_and_tool_call' END AS error, len(regexp_extract_all(t, '"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'))::BIGINT AS n_tokens,
  lower(role) || ':' || turn AS request, contains(lower(text), lower(role)) AS communicates FROM m"""
)
def reply_scalars(spark, sf_dir):
    """Affirmatives, prose, generation ends, tool turns, JSON tokens and request keys of texts built on each message."""
    rows = b.table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    text = (
        F.when(turn % 4 == 0, "Yes, please  book it.")
        .when(turn % 4 == 1, F.concat(F.lit("**"), "role", F.lit("** said __"), turn, F.lit("__ > a_b  *c*\nend")))
        .when(turn % 4 == 2, F.concat(F.lit('<tool_call>{"name": "x", "n": '), turn, F.lit("}</tool_call><|im_end|>")))
        .otherwise("before <tool_call>{}</tool_call>")
    )
    calls = F.when(turn % 4 >= 2, 1).otherwise(0)
    key = scalars.request_key(F.concat(F.lit(" "), F.upper("role"), F.lit(" ")), turn.cast("string"))
    t = F.col("t")
    return rows.withColumn("t", text).select(
        "conv_id", "turn", scalars.is_affirmative(t).alias("affirms"), scalars.plain_prose(t).alias("prose"), scalars.without_end(t).alias("ended"), scalars.tool_turn_error(t, calls).alias("error"),
        F.size(scalars.json_tokens(t)).cast("long").alias("n_tokens"), F.concat_ws(":", key["target"], key["operation"]).alias("request"), scalars.communicates(F.array("text"), F.col("role")).alias("communicates"),
    )


@query("SELECT doc_id, source, row_number() OVER (ORDER BY coalesce(try_cast(source AS BIGINT), 1000000000), coalesce(try_cast(regexp_extract(source, '([^_]*)$', 1) AS BIGINT), 1000000000), doc_id) AS place, try_cast(regexp_extract('s_' || source, '([^_]*)$', 1) AS BIGINT) AS tail FROM (SELECT doc_id, CAST(doc_id % 40 AS VARCHAR) || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS source FROM documents)")
def task_orders(spark, sf_dir):
    """Places in the order of integer tasks, and trailing integers; texts that are no integers come last."""
    name = F.concat((F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))
    rows = b.table(spark, sf_dir, "documents").select("doc_id", name.alias("source"))
    order = scalars.task_order(F.col("source"), F.substring_index("source", "_", -1), F.col("doc_id"))
    keyed = rows.select("doc_id", "source", *(c.alias(f"key{k}") for k, c in enumerate(order)))
    return scans.numbered(keyed, ["key0", "key1", "key2"]).select("doc_id", "source", "place", scalars.trailing_int(F.concat(F.lit("s_"), F.col("source"))).alias("tail"))


# JSON rules

_SCHEMAS = {name: {"type": "object", "properties": {"k": {"type": "integer", "maximum": 80}}, "required": ["k"], "additionalProperties": False} for name in ("click", "view", "purchase", "signup")}


@query(
    """WITH e AS (SELECT event_id, event_type AS name, CASE WHEN event_id % 11 = 0 THEN '[1]' WHEN event_id % 13 = 0 THEN '{"x": 1}' ELSE props END AS props, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'schema_invalid' WHEN name = 'error' THEN 'unknown_tool' WHEN event_id % 13 = 0 OR k > 80 THEN 'schema_invalid' END AS error_kind,
  CASE WHEN event_id % 11 = 0 THEN 'arguments must be an object' WHEN name = 'error' THEN 'unknown tool: error' WHEN event_id % 13 = 0 THEN 'arguments: ''k'' is a required property' WHEN k > 80 THEN 'k: ' || k || ' is greater than the maximum 80' END AS detail FROM e"""
)
def tool_call_errors(spark, sf_dir):
    """What is wrong with each event's call, by the schemas of four tools."""
    i = F.col("event_id")
    rows = b.table(spark, sf_dir, "events").withColumn("props", F.when(i % 11 == 0, "[1]").when(i % 13 == 0, '{"x": 1}').otherwise(F.col("props")))
    return rows.select("event_id", canon.call_error(_SCHEMAS)("event_type", "props").alias("e")).select("event_id", "e.*")


@query(
    """WITH e AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
SELECT event_id, k = 7 AS whole, k % 10 = 3 AS deep, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"amount":["n","' || CASE WHEN k = 0 THEN '0e0' WHEN k % 10 = 0 THEN (k // 10) || 'e1' ELSE k || 'e0' END || '"],"b":["l",[["int",1],["str","x"]]]}' END AS key,
  k >= 10 AS quoted FROM e"""
)
def argument_rules(spark, sf_dir):
    """Argument patterns, canonical arguments and quotes on JSON built from each event's number."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    rows = b.table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    n = F.col("k").cast("string")
    args = F.concat(F.lit('{"b": [1, "x"], "amount": '), F.when(F.col("event_id") % 3 == 0, F.lit("null")).when(F.col("event_id") % 3 == 1, n).otherwise(F.concat(F.lit('"'), n, F.lit('.0"'))), F.lit("}"))
    nested = F.concat(F.lit('{"p": {"q": ['), (F.col("k") % 10).cast("string"), F.lit(', true]}, "r": 1}'))
    return rows.select(
        "event_id",
        canon.argument_pattern_matches(F.lit('{"k": {"eq": 7}}'), F.concat(F.lit('{"k": '), n, F.lit(', "more": 1}'))).alias("whole"),
        canon.argument_pattern_matches(F.lit('{"p": {"q": [3, {"eq": true}]}}'), nested).alias("deep"),
        canon.arguments_key()(F.lit("tool"), args).alias("key"),
        # a quote that ends in the first digit of a number stands for that number alone
        (~canon.quote_in_generation(F.concat(F.lit('{"total_baggages": '), F.substring(n, 1, 1)), F.concat(F.lit('[{"total_baggages": '), n, F.lit("}]")), F.lit(True))).alias("quoted"),
    )


@query(
    b.with_(b.TOOL_EVENTS)
    + """, r AS NOT MATERIALIZED (SELECT event_id, sequence % 4 AS kind, sequence % 3 = 0 AS phase_ok, CAST(floor(random_k) AS BIGINT) % 2 = 0 AS ok FROM (SELECT *, event_id AS random_k FROM b_tool_events))
SELECT event_id, phase_ok AND CASE kind WHEN 0 THEN true WHEN 1 THEN ok WHEN 2 THEN true ELSE false END AS interaction, CASE kind WHEN 0 THEN true WHEN 1 THEN ok WHEN 2 THEN true ELSE ok END AS scoring FROM r"""
)
def retry_rules(spark, sf_dir):
    """Whether an interaction, and a judgement, may be tried again, on chains of errors built on each event."""
    kind, ok = F.col("sequence") % 4, F.col("event_id") % 2 == 0
    node = lambda name, status=None, retryable=None: F.struct(F.lit(name).alias("kind"), (F.lit(None) if status is None else status).cast("int").alias("status"), F.lit(None).cast("string").alias("errno"), F.lit(None).cast("string").alias("phase"), (F.lit(None) if retryable is None else retryable).cast("boolean").alias("retryable"))
    chain = (
        F.when(kind == 0, F.array(node("RuntimeError"), node("ConnectError")))
        .when(kind == 1, F.array(node("HTTPStatusError", F.when(ok, 503).otherwise(404))))
        .when(kind == 2, F.array(node("ReadError"), node("EndOfStream")))
        .otherwise(F.array(node("JudgeServiceFailure", retryable=ok)))
    )
    rows = b.tool_events(spark, sf_dir).withColumn("chain", chain)
    phase = F.when(F.col("sequence") % 3 == 0, "model_generation").otherwise("token_alignment")
    return rows.select("event_id", failures.interaction_retryable(phase, F.col("chain")).alias("interaction"), failures.scoring_retryable(F.lit("judge"), F.col("chain")).alias("scoring"))


# Prompts and requests


@query("SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 2000 THEN 'initial_prompt_limit_exceeded' END, CASE WHEN n_chars + 1 > 4000 THEN 'total_context_reserve_exceeded' END) AS violations, CASE WHEN n_chars > 2000 THEN 'rejected' ELSE 'ok' END AS status FROM documents")
def prompt_inspection(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("initial_prompt_tokens"))
    return prompts.inspected(rows, 2000, 4000).select("doc_id", F.array_join("violations", ",").alias("violations"), "status")


@query("SELECT count(n_chars) AS measured_samples, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS greatest, (SELECT count(DISTINCT source) FROM documents WHERE n_chars IS NULL AND source NOT IN (SELECT source FROM documents WHERE n_chars IS NOT NULL)) AS missing_tasks, count(*) FILTER (WHERE n_chars IS NULL OR n_chars > 2000) AS failed_samples, count(*) FILTER (WHERE n_chars IS NULL OR n_chars > 2000) = 0 AS all_requested_samples_passed FROM documents")
def prompt_report(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select(F.col("source").alias("task_id"), F.col("n_chars").alias("initial_prompt_tokens"))
    return prompts.report(prompts.inspected(docs, 2000, 4000), docs.select("task_id")).select("measured_samples", "least", "p50", "p95", "greatest", "missing_tasks", "failed_samples", "all_requested_samples_passed")


_CALL = """'[{"arguments":{"n":' || turn || '},"name":"lookup"}]'"""
_MESSAGE = """'{"content":' || CAST(to_json(content) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || CASE WHEN calls IS NULL THEN '' ELSE ',"tool_calls":' || calls END || '}'"""
_SPACED = """'{"content": ' || CAST(to_json(@) AS VARCHAR) || ', "role": ' || CAST(to_json(role) AS VARCHAR) || CASE WHEN calls IS NULL THEN '' ELSE ', "tool_calls": ' || spaced END || '}'"""


@query(
    f"""WITH p AS (SELECT conv_id, coalesce(min(text) FILTER (role = 'system'), 'none') AS policy FROM conversations GROUP BY 1),
raw AS (SELECT c.conv_id, c.turn, role, CASE WHEN c.turn % 5 = 3 THEN '' ELSE c.text END AS content, CASE WHEN c.turn % 4 = 1 THEN {_CALL} END AS calls, CASE WHEN c.turn % 4 = 1 THEN '[{{"arguments": {{"n": ' || turn || '}}, "name": "lookup"}}]' END AS spaced, policy, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS pos FROM conversations c JOIN p USING (conv_id)),
m AS MATERIALIZED (SELECT *, {_MESSAGE} AS tight, {_SPACED.replace("@", "content")} AS loose, {_SPACED.replace("@", "CASE WHEN role = 'system' THEN replace(content, policy, '[See request.policy for the bound policy.]') ELSE content END")} AS seen FROM raw),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, CASE WHEN trim(content) = '' THEN coalesce(spaced, loose) ELSE content || coalesce(chr(10) || spaced, '') END AS target,
  sha256('{{"current_generation":{{"message":' || tight || ',"message_index":' || pos || '}},"judge_version":"simple-turn-target-v2"}}') AS digest FROM m WHERE role = 'assistant'),
h AS (SELECT t.conv_id, t.pos, string_agg('{{"message": ' || m.seen || ', "message_index": ' || m.pos || '}}', ', ' ORDER BY m.pos) AS history FROM t JOIN m ON m.conv_id = t.conv_id AND m.pos < t.pos GROUP BY ALL)
SELECT t.conv_id AS trajectory_id, turn_index, t.pos AS target_message_index, sha256(target) AS target, digest, t.pos AS n_history,
  sha256('{{"request_version": "simple-turn-target-v2", "policy": ' || CAST(to_json(policy) AS VARCHAR) || ', "history": [' || coalesce(history, '') || '], "current_generation": {{"message": ' || loose || ', "message_index": ' || t.pos || '}}, "final_turn_rule": "simple-turn-v2", "previous_refusals": [], "target_generation_sha256": "' || digest
    || '", "target_generation_text": ' || CAST(to_json(target) AS VARCHAR) || ', "target_message_index": ' || t.pos || ', "turn_index": ' || turn_index || '}}') AS request FROM t LEFT JOIN h ON t.conv_id = h.conv_id AND t.pos = h.pos"""
)
def judge_requests(spark, sf_dir):
    """Targets and requests about every assistant's turn, byte by byte; the policy is the dialogue's own system message, some turns call a tool, some say nothing."""
    turn = F.col("turn")
    calls = F.when(turn % 4 == 1, F.array(F.struct(F.lit("lookup").alias("name"), F.struct(turn.alias("n")).alias("arguments"))))
    message = F.struct("role", F.when(turn % 5 == 3, "").otherwise(F.col("text")).alias("content"), F.lit(None).cast("string").alias("raw_generated_text"), calls.alias("tool_calls"))
    talk = b.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trajectory_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"), F.coalesce(F.min(F.when(F.col("role") == "system", F.col("text"))), F.lit("none")).alias("policy")
    )
    out = judging.request_json(judging.turn_requests(talk.withColumn("task_guidance", F.lit(None).cast("string"))))
    out = out.select("trajectory_id", "turn_index", "target_message_index", F.sha2("target_text", 256).alias("target"), F.col("target_sha256").alias("digest"), F.size("history").alias("n_history"), F.sha2("request", 256).alias("request"))
    return longs(out, "turn_index", "target_message_index", "n_history")


# Records


@query(
    """WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag AS flag, l_quantity AS q FROM lineitem)
SELECT id, n, flag IN ('A', 'N') AS db_applicable, CASE flag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.0::DOUBLE END AS db_score, q % 3 <> 0 AS communicate_applicable, CASE WHEN q % 3 = 1 THEN 0.5::DOUBLE WHEN q % 3 = 2 THEN 1.0::DOUBLE END AS communicate_partial, CASE WHEN q % 3 = 1 THEN false WHEN q % 3 = 2 THEN true END AS communicate_all FROM t"""
)
def official_scores(spark, sf_dir):
    """Official scores from reward JSON built on each line: database checks, breakdowns and communication checks."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    db = F.when(flag == "A", '"db_check": {"db_reward": 1.0},').when(flag == "N", '"reward_breakdown": {"DB": 0.0},').otherwise("")
    says = F.when(q % 3 == 1, '"communicate_checks": [{"met": true}, {"met": false}],').when(q % 3 == 2, '"reward_basis": ["communicate"],').otherwise("")
    info = F.concat(F.lit("{"), db, says, F.lit('"x": 1}'))
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), records.official_scores(F.lit(1.0), info).alias("s"))
    return rows.select("id", "n", "s.db_applicable", "s.db_score", "s.communicate_applicable", "s.communicate_partial", "s.communicate_all")


@query(
    b.with_(b.TOOL_EVENTS)
    + """, e AS NOT MATERIALIZED (SELECT trajectory_id, event_id, sequence, name, success, db_effect, CASE name WHEN 'view' THEN 'information' WHEN 'click' THEN 'cancel_reservation' WHEN 'purchase' THEN 'book_reservation' WHEN 'signup' THEN 'send_certificate' ELSE 'transfer_to_human_agents' END AS tool FROM b_tool_events),
a AS NOT MATERIALIZED (SELECT *, success OR db_effect AS ran, success OR db_effect OR NOT success AS tried FROM e),
r AS NOT MATERIALIZED (SELECT trajectory_id, unnest(['information_grounding', 'single_action_turn']) AS rule_id FROM a
UNION SELECT trajectory_id, 'database_write_confirmation' FROM a WHERE tool IN ('cancel_reservation', 'book_reservation', 'send_certificate')
UNION SELECT trajectory_id, 'user_identity' FROM a WHERE tool IN ('cancel_reservation', 'book_reservation')
UNION SELECT trajectory_id, 'refund_destination' FROM a WHERE tool = 'cancel_reservation' AND ran
UNION SELECT trajectory_id, 'baggage_pricing' FROM a WHERE tool = 'book_reservation' AND sequence % 2 = 1
UNION SELECT trajectory_id, 'insurance_timing' FROM a WHERE tool = 'book_reservation' AND sequence % 3 = 1
UNION SELECT trajectory_id, unnest(['booking_cabin', 'booking_passengers', 'booking_payment_limits']) FROM a WHERE tool = 'book_reservation'
UNION SELECT trajectory_id, unnest(['cancellation_reason', 'cancellation_eligibility']) FROM a WHERE tool = 'cancel_reservation'
UNION SELECT trajectory_id, unnest(['compensation_request_and_facts', 'compensation_eligibility', 'compensation_reason_amount']) FROM a WHERE tool = 'send_certificate'
UNION SELECT trajectory_id, 'transfer_scope_and_message' FROM a WHERE tool = 'transfer_to_human_agents')
SELECT DISTINCT trajectory_id, rule_id FROM r"""
)
def active_rules(spark, sf_dir):
    """The rules that apply to each user, with the five kinds of events read as tools."""
    name = F.col("name")
    tool = F.when(name == "view", "information").when(name == "click", "cancel_reservation").when(name == "purchase", "book_reservation").when(name == "signup", "send_certificate").otherwise("transfer_to_human_agents")
    args = F.to_json(F.struct((F.col("sequence") % 2).alias("total_baggages"), F.when(F.col("sequence") % 3 == 1, "yes").otherwise("no").alias("insurance")))
    return records.active_rules(b.tool_events(spark, sf_dir).withColumn("arguments", args).withColumn("name", tool))


@query(
    b.with_(b.TOOL_EVENTS)
    + """, s AS NOT MATERIALIZED (SELECT trajectory_id, event_id, sequence, CAST(sequence - (sequence % 7 = 3)::INT AS VARCHAR) AS before, CAST(sequence + 1 AS VARCHAR) AS after, event_id % 17 <> 0 AS effect FROM b_tool_events)
SELECT trajectory_id, event_id, torn, denied FROM (SELECT *, coalesce(before <> lag(after) OVER w, false) AS torn, effect <> (before <> after) AS denied FROM s WINDOW w AS (PARTITION BY trajectory_id ORDER BY sequence)) WHERE torn OR denied"""
)
def broken_states(spark, sf_dir):
    """Events whose state before is not what the event before them left, or whose effect their states deny."""
    n = F.col("sequence")
    rows = b.tool_events(spark, sf_dir).withColumns({"db_hash_before": (n - (n % 7 == 3).cast("int")).cast("string"), "db_hash_after": (n + 1).cast("string"), "db_effect": F.col("event_id") % 17 != 0})
    return integrity.broken_states(rows)


@query(
    b.with_(b.TOOL_EVENTS)
    + """SELECT event_id, unnest(list_filter([CASE WHEN event_id % 5 = 0 THEN 'not_replayed' END, CASE WHEN event_id % 5 <> 0 AND event_id % 7 = 0 AND success THEN 'success' END, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND success AND event_id % 11 = 0 THEN 'result' END, CASE WHEN event_id % 5 <> 0 AND event_id % 13 = 0 THEN 'db_effect' END], lambda x: x IS NOT NULL)) AS fault FROM b_tool_events WHERE name = 'purchase'"""
)
def replay_faults(spark, sf_dir):
    """Effective calls that a replay, built with faults, does not confirm."""
    i = F.col("event_id")
    rows = b.tool_events(spark, sf_dir).withColumn("name", F.when(F.col("name") == "purchase", "book_reservation").otherwise(F.col("name"))).withColumn("execution_status", F.lit(None).cast("string"))
    replayed = rows.where(i % 5 != 0).select("event_id", (F.col("success") & (i % 7 != 0)).alias("ok"), F.when(i % 11 == 0, "other").otherwise(F.col("result")).alias("result"), (F.col("db_effect") != (i % 13 == 0)).alias("changed"))
    return integrity.replay_differences(rows, replayed)


@query(
    b.with_(b.ROLLOUTS)
    + """, g AS NOT MATERIALIZED (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE termination <> 'infrastructure_error') AS done FROM b_rollouts GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS requested_slots, CAST(sum(done) AS BIGINT) AS completed_slots, CAST(sum(n) - sum(done) AS BIGINT) AS failed_slots, count(*) FILTER (WHERE done < n) AS failed_groups, round(sum(done)::DOUBLE / sum(n), 6) AS completion_rate, (sum(done) = 0)::BIGINT AS empty FROM g"""
)
def validation_coverage(spark, sf_dir):
    per = b.rollouts(spark, sf_dir).groupBy("task_id").agg(F.count(F.lit(1)).alias("rollout_n"), F.count_if(F.col("termination") != "infrastructure_error").alias("completed")).withColumn("failed", F.col("completed") < F.col("rollout_n"))
    return longs(integrity.validation_coverage(per), "empty").withColumn("completion_rate", r6("completion_rate"))


@query(
    b.with_(b.TURNS)
    + """, s AS NOT MATERIALIZED (SELECT trajectory_id, list(satisfied ORDER BY turn) AS db FROM b_turns GROUP BY 1),
x AS NOT MATERIALIZED (SELECT trajectory_id, db, list_filter(range(2, len(db) + 1), lambda t: db[t - 1] AND NOT db[t]) AS reg FROM s)
SELECT count(*) AS trajectories, CAST(sum(len(reg)) AS BIGINT) AS regression_turns, count(*) FILTER (WHERE len(reg) > 0) AS regression_trajectories, count(*) FILTER (WHERE len(reg) > 0 AND db[1]) AS initially_complete_regression_trajectories, count(*) FILTER (WHERE len(reg) > 0) AS completion_bonus_trajectories, count(*) FILTER (WHERE len(reg) > 1) AS completion_floor_trajectories, count(*) FILTER (WHERE len(reg) > 0 AND trajectory_id % 2 = 1) AS recovered_final_success_trajectories, count(*) FILTER (WHERE len(reg) > 0 AND trajectory_id % 4 = 0) AS double_reward_trajectories FROM x"""
)
def completion_summary(spark, sf_dir):
    """Regressions, bonuses and floors over traces built on each order's lines."""
    states = b.turns(spark, sf_dir).groupBy("trajectory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "satisfied"))), lambda s: s["satisfied"]).alias("official"))
    falls = F.filter(F.transform("official", lambda v, i: F.when((i > 0) & ~v & F.get("official", i - 1), i)), lambda i: i.isNotNull())
    rows = states.withColumn("regressions", falls)
    undone = F.size("regressions") > 0
    t = F.col("trajectory_id")
    traces = rows.select("official", "regressions", F.array(F.when(undone, 0.25).otherwise(0.0)).alias("bonus"), F.when(F.size("regressions") > 1, 1).alias("floor_turn"), F.when(undone & (t % 4 == 0), 0.5).otherwise(0.0).alias("db_positive"), (t % 2).cast("double").alias("final_reward"))
    return longs(integrity.completion_summary(traces), "regression_turns")


@query(
    b.with_(b.TURNS, b.ROLLOUTS)
    + """, p AS NOT MATERIALIZED (SELECT trajectory_id, count(*) AS turns, list(satisfied ORDER BY turn) AS v FROM b_turns GROUP BY 1)
SELECT trajectory_id, CASE WHEN trajectory_id % 9 = 0 THEN 'initial' WHEN trajectory_id % 9 = 1 THEN 'fractions' WHEN trajectory_id % 9 = 2 THEN 'phi' ELSE '' END AS broken FROM p"""
)
def progress_traces(spark, sf_dir):
    """The rule that each trace of one check breaks; some are built with a changed start, share or length."""
    t = F.col("trajectory_id")
    rows = b.turns(spark, sf_dir).groupBy("trajectory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "satisfied"))), lambda s: s["satisfied"]).alias("v"))
    start = F.array(F.lit(False))
    values = F.transform(F.concat(start, F.col("v")), lambda x: F.array(x))
    phi = F.concat(F.array(F.lit(0.0)), F.transform("v", lambda x: x.cast("double")))
    # a changed start is a check that was met from the first and so is left out, with no share of it
    checks = F.array(F.struct(F.lit("c").alias("check_id"), (t % 9 == 0).alias("initial"), (t % 9 != 0).alias("included")))
    phi = F.when(t % 9 == 0, F.transform(phi, lambda _: F.lit(0.0))).when(t % 9 == 1, F.transform(phi, lambda x, i: F.when(i == 1, 1 - x).otherwise(x))).when(t % 9 == 2, F.transform(phi, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))).otherwise(phi)
    traces = rows.select("trajectory_id", F.lit("progress-v3").alias("version"), checks.alias("checks"), values.alias("check_values"), phi.alias("phi"), F.size("v").alias("turns"))
    # a wrong length: one state and one share more than turns allow
    longer = F.when(t % 9 == 2, F.concat("phi", F.array(F.element_at("phi", -1)))).otherwise(F.col("phi"))
    same = F.when(t % 9 == 2, F.concat("check_values", F.array(F.element_at("check_values", -1)))).otherwise(F.col("check_values"))
    traces = traces.withColumns({"phi": longer, "check_values": same})
    return checked(traces, {k: v for k, v in integrity.progress_trace_rules().items() if k != "states"}, "flag").select("trajectory_id", F.array_join("violations", ",").alias("broken"))


# Joins and sets


@query(
    """WITH a AS (SELECT CAST(s_suppkey % 40 AS VARCHAR) AS task_id, s_suppkey AS action_id, CAST(s_nationkey AS VARCHAR) AS args_key FROM supplier)
SELECT DISTINCT 'action' AS kind, task_id, CAST(action_id AS VARCHAR) AS what FROM a WHERE action_id % 3 = 0
UNION ALL SELECT 'dependency', CAST(s_suppkey % 40 AS VARCHAR), CAST(s_suppkey + 1000000 AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'dependency', CAST(s_suppkey % 40 AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 1
UNION ALL SELECT 'split', CAST(s_suppkey % 40 AS VARCHAR), 'test' FROM supplier GROUP BY s_suppkey % 40 HAVING count(DISTINCT s_suppkey % 80 < 40) > 1"""
)
def annotation_gaps(spark, sf_dir):
    """Actions that no official one matches, dependencies that lead nowhere or to themselves, and tasks of two splits, in annotations built on suppliers."""
    key = F.col("s_suppkey")
    rows = b.table(spark, sf_dir, "supplier").select((key % 40).cast("string").alias("task_id"), key.cast("string").alias("action_id"), F.concat(F.lit("t"), key).alias("name"), F.col("s_nationkey").cast("string").alias("args_key"), key.alias("k"))
    official = rows.where("k % 3 <> 0").select("task_id", "name", "args_key")
    order = rows.where("k % 5 < 2").select("task_id", F.col("action_id").alias("before"), F.when(F.col("k") % 5 == 0, F.col("k") + 1_000_000).otherwise(F.col("k")).cast("string").alias("after"))
    splits = rows.select("task_id", F.when(F.col("k") % 80 < 40, "train").otherwise("test").alias("split"))
    return records.annotation_gaps(rows, official, order, splits)


@query(
    b.with_(b.ROLLOUTS)
    + """SELECT trajectory_id, trajectory_id % 10 = 0 AS missing, concat_ws(',', CASE WHEN trajectory_id % 10 = 0 OR trajectory_id % 6 = 1 THEN 'reward' END, CASE WHEN trajectory_id % 10 = 0 THEN 'task_id' END) AS differs FROM b_rollouts WHERE trajectory_id % 10 = 0 OR trajectory_id % 6 = 1"""
)
def saved_membership(spark, sf_dir):
    """Members of groups whose saved record is missing, or differs, in records built with both."""
    rows = b.rollouts(spark, sf_dir).select("trajectory_id", "reward", "task_id")
    saved = rows.where("trajectory_id % 10 <> 0").withColumn("reward", F.when(F.col("trajectory_id") % 6 == 1, F.col("reward") + 1).otherwise(F.col("reward")))
    return replay.membership(rows, saved, ["reward", "task_id"]).select("trajectory_id", "missing", F.array_join("differs", ",").alias("differs"))


@query(b.with_(b.ROLLOUTS) + ", a AS NOT MATERIALIZED (SELECT trajectory_id, reward, reward + CASE WHEN trajectory_id % 8 = 0 THEN 0.5 ELSE 0 END AS expected FROM b_rollouts WHERE trajectory_id % 4 = 0) SELECT trajectory_id, expected, reward AS actual FROM a WHERE expected <> reward")
def hand_audit(spark, sf_dir):
    """Rows of a hand audit that the rewards miss."""
    rows = b.rollouts(spark, sf_dir).select("trajectory_id", "reward")
    hand = rows.where("trajectory_id % 4 = 0").withColumn("reward", F.col("reward") + F.when(F.col("trajectory_id") % 8 == 0, 0.5).otherwise(0.0))
    return replay.audit(rows, hand, "trajectory_id", "reward").select("trajectory_id", "expected", "actual")


@query(b.with_(b.ROLLOUTS) + "SELECT r.trajectory_id, c_nationkey AS nation, c_acctbal AS balance FROM b_rollouts r LEFT JOIN customer ON r.task_id = c_custkey AND c_custkey % 3 <> 0")
def rescored_records(spark, sf_dir):
    """Rollouts with their task's annotations; tasks without one keep their rows."""
    notes = b.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("task_id"), "c_nationkey", "c_acctbal")
    out = replay.rescored(b.rollouts(spark, sf_dir), {"note": notes})
    return out.select("trajectory_id", F.col("note.c_nationkey").alias("nation"), F.col("note.c_acctbal").alias("balance"))


@query(
    """WITH w AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id AS trajectory_id, i AS message_index, i // 2 + 1 AS assistant_turn_id FROM w WHERE role = 'assistant'"""
)
def policy_turns(spark, sf_dir):
    """The actor turn of each assistant message, whose half-open range of two messages holds it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    messages = b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trajectory_id"), (F.row_number().over(w) - 1).alias("message_index"), "role")
    sizes = messages.groupBy("trajectory_id").agg(F.max("message_index").alias("n"))
    prefixes = sizes.select("trajectory_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("k")).select("trajectory_id", (F.col("k") + 1).alias("turn"), (F.col("k") * 2).alias("start"), (F.col("k") * 2 + 2).alias("stop"))
    return longs(events.policy_turn(messages, prefixes).select("trajectory_id", "message_index", "assistant_turn_id"), "message_index", "assistant_turn_id")


@query(
    b.with_(b.TOOL_EVENTS)
    + """, m AS NOT MATERIALIZED (SELECT *, coalesce(NOT success AND NOT lag(success) OVER w, false) AS retry FROM b_tool_events WINDOW w AS (PARTITION BY trajectory_id, name, args ORDER BY sequence))
SELECT event_id, unnest(list_filter([error_kind, CASE WHEN retry THEN 'unchanged_retry' END], lambda x: x IS NOT NULL)) AS kind FROM m"""
)
def penalty_signals(spark, sf_dir):
    rows = events.mark_repetition(b.tool_events(spark, sf_dir), ["trajectory_id", "name", "args"]).withColumn("no_progress", F.lit(False))
    return events.penalty_signals(rows).select("event_id", "kind")


@query(b.with_(b.TURNS) + "SELECT trajectory_id, turn, sum(tokens) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 90 AS fits FROM b_turns")
def whole_observations(spark, sf_dir):
    rows = b.turns(spark, sf_dir).withColumn("length", F.col("tokens"))
    return longs(records.whole_observations(rows, F.lit(90)).select("trajectory_id", "turn", "fits"), "turn")


@query(
    """WITH c AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS task, CAST(s_suppkey % 6 AS VARCHAR) AS criterion FROM supplier), v AS (SELECT * FROM c WHERE criterion <> '1'), r AS (SELECT * FROM c WHERE criterion <> '2')
SELECT coalesce(v.task, r.task) AS task, coalesce(v.criterion, r.criterion) AS criterion, CASE WHEN r.task IS NULL THEN 'not_asked' WHEN v.task IS NULL THEN 'not_answered' ELSE 'active_but_inapplicable' END AS gap FROM v FULL JOIN r ON v.task = r.task AND v.criterion = r.criterion WHERE r.task IS NULL OR v.task IS NULL OR v.criterion = '3'"""
)
def criterion_gaps(spark, sf_dir):
    """Criteria that only the judge or only the rubric names, and active ones called inapplicable."""
    pairs = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("task"), (F.col("s_suppkey") % 6).cast("string").alias("criterion")).distinct()
    verdicts = pairs.where("criterion <> '1'").withColumn("applicable", F.col("criterion") != "3")
    return records.criterion_gaps(verdicts, pairs.where("criterion <> '2'").withColumn("active", F.lit(True)), ["task", "criterion"])


@query(
    b.with_(b.TOOL_EVENTS)
    + """, e AS NOT MATERIALIZED (SELECT trajectory_id, event_id, sequence, name, CAST(regexp_extract(args, '[0-9]+') AS BIGINT) AS k FROM b_tool_events)
SELECT event_id, CASE name WHEN 'view' THEN 'airline:users:' || k WHEN 'click' THEN 'airline:reservations:' || k WHEN 'signup' THEN 'airline:flight-status:' || k || ':2024-05-10' WHEN 'purchase' THEN 'airline:search_direct_flight:' || k % 5 || ':' || (k // 5) % 5 || ':2024-05-10' ELSE 'airline:static:calculate' END AS scope,
  CASE name WHEN 'view' THEN coalesce((SELECT '{"balance":' || c_nationkey || '}' FROM customer WHERE c_custkey = k), 'null') WHEN 'click' THEN 'null' WHEN 'signup' THEN coalesce((SELECT '{"status":"' || CASE WHEN s_suppkey % 4 = 0 THEN 'delayed' ELSE 'available' END || '"}' FROM supplier WHERE s_suppkey = k), 'null')
    WHEN 'purchase' THEN (SELECT CAST(count(*) AS VARCHAR) FROM supplier WHERE s_nationkey % 5 = k % 5 AND s_suppkey % 5 = (k // 5) % 5 AND s_suppkey % 4 <> 0) ELSE '{"native_semantics":"duplicate-query-v1"}' END AS seen FROM e"""
)
def query_states(spark, sf_dir):
    """What each event's read sees, with users from customers and flights from suppliers; of searches, how many flights."""
    k = F.regexp_extract("args", "[0-9]+", 0)
    name = F.col("name")
    tool = F.when(name == "view", "get_user_details").when(name == "click", "get_reservation_details").when(name == "signup", "get_flight_status").when(name == "purchase", "search_direct_flight").otherwise("calculate")
    n = k.cast("long")
    args = F.to_json(F.struct(k.alias("user_id"), k.alias("reservation_id"), k.alias("flight_number"), F.lit("2024-05-10").alias("date"), (n % 5).cast("string").alias("origin"), F.pmod(F.floor(n / 5), F.lit(5)).cast("string").alias("destination")))
    calls = b.tool_events(spark, sf_dir).select("event_id", tool.alias("name"), args.alias("arguments"), F.lit("s").alias("state"))
    users = b.table(spark, sf_dir, "customer").select(F.lit("s").alias("state"), F.col("c_custkey").cast("string").alias("user_id"), F.concat(F.lit('{"balance":'), F.col("c_nationkey"), F.lit("}")).alias("value"))
    key = F.col("s_suppkey")
    flights = b.table(spark, sf_dir, "supplier").select(
        F.lit("s").alias("state"), key.cast("int").alias("place"), key.cast("string").alias("number"), (F.col("s_nationkey") % 5).cast("string").alias("origin"), (key % 5).cast("string").alias("destination"),
        F.lit("08:00").alias("departs"), F.lit("09:00").alias("arrives"), F.lit("2024-05-10").alias("date"), F.when(key % 4 == 0, "delayed").otherwise("available").alias("status"), F.lit("{}").alias("instance"),
    )
    none = users.select("state", F.col("user_id").alias("reservation_id"), "value").limit(0)
    counted = lambda seen: F.when(F.col("scope").startswith("airline:search"), F.json_array_length(seen).cast("string")).otherwise(seen)
    return querystate.projected(calls, users, none, flights, shown=counted).select("event_id", "scope", "seen")


@query(
    "SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'last_role' WHEN c_custkey % 4 = 1 THEN 'messages_empty,last_role' WHEN c_custkey % 4 = 2 THEN 'answer_empty,tools_empty' ELSE '' END AS broken FROM customer"
)
def sft_row_rules(spark, sf_dir):
    """The rules of training rows that rows built on customers break."""
    k = F.col("c_custkey")
    message = lambda role, content="x": F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"), F.array().cast("array<string>").alias("tool_calls"))
    messages = F.when(k % 4 == 0, F.array(message("user"), message("assistant"))).when(k % 4 == 1, F.array(message("user")).cast("array<struct<role:string,content:string,tool_calls:array<string>>>")).otherwise(F.array(message("user")))
    messages = F.when(k % 4 == 1, F.slice(messages, F.lit(1), F.lit(0))).otherwise(messages)
    answer = F.when(k % 4 == 2, message("assistant", "")).otherwise(message("assistant"))
    tools = F.when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("t")))
    rows = b.table(spark, sf_dir, "customer").select(k.alias("key"), messages.alias("m"), answer.alias("a"), tools.alias("t"))
    flagged = checked(rows, curation.valid_sft_rows(F.col("m"), F.col("a"), F.col("t")), "flag")
    return flagged.select("key", F.array_join("violations", ",").alias("broken"))


@query(b.with_(b.ROLLOUTS) + "SELECT task_id, count(*) AS n FROM b_rollouts GROUP BY 1 HAVING count(*) > 1")
def repeated_tasks(spark, sf_dir):
    return unique(b.rollouts(spark, sf_dir), ["task_id"])


@query("SELECT CAST(o_custkey % 50 AS VARCHAR) AS task_id, concat_ws(',', 'F', 'O') AS splits FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_overlaps(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").select((F.col("o_custkey") % 50).cast("string").alias("task_id"), F.col("o_orderstatus").alias("split"))
    return integrity.overlapping(rows).select("task_id", F.array_join("splits", ",").alias("splits"))


@query(b.with_(b.ROLLOUTS) + ", t AS NOT MATERIALIZED (SELECT task_id, count(*) AS n FROM b_rollouts WHERE slot < 4 GROUP BY 1) SELECT count(*) FILTER (WHERE n = 4) AS complete, count(*) FILTER (WHERE n < 4) AS incomplete FROM t")
def slot_coverage(spark, sf_dir):
    """Tasks that have all of four slots, and those that lack some."""
    rows = b.rollouts(spark, sf_dir)
    gaps = evaluation.missing_slots(rows, rows, 4).select("task_id").distinct().withColumn("gap", F.lit(1))
    return rows.select("task_id").distinct().join(gaps, "task_id", "left").agg(F.count_if(F.col("gap").isNull()).alias("complete"), F.count_if(F.col("gap").isNotNull()).alias("incomplete"))


@query(b.with_(b.TURNS) + "SELECT trajectory_id, round(avg(v), 6) + 0.0 AS progress FROM (SELECT trajectory_id, satisfied::INT::DOUBLE AS v FROM b_turns UNION ALL SELECT trajectory_id, (NOT bad)::INT::DOUBLE FROM b_turns WHERE turn = 0) GROUP BY 1")
def terminal_progress(spark, sf_dir):
    """Final checks and judged criteria together; the first line of each order stands for a judged criterion."""
    turns = b.turns(spark, sf_dir)
    out = progress.terminal_progress(turns.select("trajectory_id", F.col("satisfied").alias("value")), turns.where("turn = 0").select("trajectory_id", (~F.col("bad")).alias("passed")))
    return out.withColumn("progress", r6("progress"))


@query("SELECT wave, kept_groups, greatest(12 - sum(kept_groups) OVER (ORDER BY wave), 0)::BIGINT AS deficit, CASE WHEN wave < 2 THEN least(greatest(12 - sum(kept_groups) OVER (ORDER BY wave), 0), 24) ELSE 0 END::BIGINT AS next_groups FROM (SELECT r_regionkey AS wave, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS kept_groups FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY 1)")
def refill_waves(spark, sf_dir):
    """What is missing after each wave of sampling, and how many groups the next one samples; regions stand for waves."""
    kept = b.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("wave")).agg(F.count_if(F.col("n_nationkey") % 2 == 0).alias("kept_groups"))
    return longs(groups.refill_plan(kept, 12, 3, 96, 4), "wave", "deficit", "next_groups").select(F.col("wave").cast("int").alias("wave"), "kept_groups", "deficit", "next_groups")


@query(
    "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 5 = 0 THEN 'binary,sum' WHEN l_linenumber % 5 = 1 THEN 'masked_zero' WHEN l_linenumber % 5 = 2 THEN 'sum' ELSE '' END AS broken FROM lineitem"
)
def mask_rules(spark, sf_dir):
    """The rules of response masks that masks built on lines break."""
    n = F.col("l_linenumber") % 5
    mask = F.when(n == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(0)))
    logs = F.when(n == 1, F.array(F.lit(-0.5), F.lit(-0.5))).otherwise(F.array(F.lit(-0.5), F.lit(0.0)))
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), mask.alias("mask"), logs.alias("logs"), F.when(n == 2, 2).otherwise(1).alias("policy"))
    return checked(rows, schemas.mask_rules("mask", "logs", "policy"), "flag").select("id", "n", F.array_join("violations", ",").alias("broken"))
