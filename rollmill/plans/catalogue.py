"""The registry of queries over the reference's operators, each with its DuckDB equivalent where SQL can say it.

Doubles are rounded to six digits (and freed of negative zeros), counts are longs. Every query
runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions import canon, scalars
from rollmill.operators import credit as credits
from rollmill.operators import curation, evaluation, events, groups, matching, profiling, progress, records, replay, reward, subgoals
from rollmill.plans import bridges as b
from rollmill.sources.shared import shared_path
from rollmill.streaming import barrier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Rewards and credits are often exact ties of the sixth digit, which sums in another order would round either way.
TIE = 1e-9


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Groups and evaluation


@query(b.with_(b.ROLLOUTS) + "SELECT task_id, trajectory_id, round((reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6), 6) + 0.0 AS advantage FROM b_rollouts WINDOW g AS (PARTITION BY task_id)")
def grpo_advantage(spark, sf_dir):
    return groups.group_advantages(b.rollouts(spark, sf_dir)).select("task_id", "trajectory_id", r6("advantage").alias("advantage"))


@query(b.with_(b.ROLLOUTS) + "SELECT task_id, count(*) AS n, min(reward) AS min_reward, max(reward) AS max_reward FROM b_rollouts GROUP BY 1 HAVING max(reward) - min(reward) > 1e-12")
def mixed_groups(spark, sf_dir):
    return groups.mixed_groups(b.rollouts(spark, sf_dir))


_SELECT = """placed AS NOT MATERIALIZED (SELECT task_id, trajectory_id, reward, slot, min(trajectory_id) OVER (PARTITION BY task_id) AS first_arrival FROM b_rollouts),
good AS NOT MATERIALIZED (SELECT task_id, first_arrival FROM placed WHERE slot < 8 GROUP BY 1, 2 HAVING count(*) = 8 AND max(reward) - min(reward) > 1e-12 ORDER BY 2, 1 LIMIT 4)
SELECT p.task_id, p.trajectory_id, p.slot + 1 AS place, p.first_arrival FROM placed p JOIN good g ON p.task_id = g.task_id WHERE p.slot < 8 AND (SELECT count(*) FROM good) = 4"""


@query(b.with_(b.ROLLOUTS, _SELECT))
def select_valid_groups(spark, sf_dir):
    return longs(groups.select_valid_groups(b.rollouts(spark, sf_dir), 8, 4), "place").select("task_id", "trajectory_id", "place", "first_arrival")


_SUCCESS = "reward BETWEEN 1 - 1e-6 AND 1 + 1e-6"
_CUT = "termination IN ('budget_exhausted', 'generation_truncated', 'hard_turn_limit', 'max_steps', 'context_window_exceeded')"
_COUNTS = f"""counts AS NOT MATERIALIZED (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE {_SUCCESS} AND NOT {_CUT}) AS c, count(*) FILTER (WHERE {_SUCCESS}) AS raw_c FROM b_rollouts GROUP BY 1)"""
_P1 = "CASE WHEN n >= 1 THEN c::DOUBLE / n END"
_P4 = "CASE WHEN n >= 4 THEN (greatest(c, 0)::DOUBLE / n) * (greatest(c - 1, 0)::DOUBLE / (n - 1)) * (greatest(c - 2, 0)::DOUBLE / (n - 2)) * (greatest(c - 3, 0)::DOUBLE / (n - 3)) END"


@query(b.with_(b.ROLLOUTS, _COUNTS) + f"SELECT task_id, n, c, raw_c, round({_P1}, 6) + 0.0 AS pass_1, round({_P4}, 6) + 0.0 AS pass_4 FROM counts")
def pass_hat_k(spark, sf_dir):
    return evaluation.pass_hat(b.rollouts(spark, sf_dir)).select("task_id", "n", "c", "raw_c", r6("pass_1").alias("pass_1"), r6("pass_4").alias("pass_4"))


@query(b.with_(b.ROLLOUTS, _COUNTS) + f"SELECT count(*) AS tasks, round(avg({_P1}), 6) + 0.0 AS pass_1, round(avg({_P4}), 6) + 0.0 AS pass_4 FROM counts")
def pass_hat_k_macro(spark, sf_dir):
    return evaluation.pass_hat_macro(b.rollouts(spark, sf_dir)).select("tasks", r6("pass_1").alias("pass_1"), r6("pass_4").alias("pass_4"))


@query(b.with_(b.ROLLOUTS) + "SELECT t.task_id, s.slot FROM (SELECT DISTINCT task_id FROM b_rollouts) t CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS slot) s WHERE NOT EXISTS (SELECT 1 FROM b_rollouts r WHERE r.task_id = t.task_id AND r.slot = s.slot)")
def eval_coverage_missing(spark, sf_dir):
    records = b.rollouts(spark, sf_dir)
    return longs(evaluation.missing_slots(records, records, 4), "slot")


@query(
    b.with_(b.ROLLOUTS)
    + "SELECT CASE WHEN slot >= 20 THEN 'error' WHEN policy_version = 1992 THEN 'rejected' WHEN policy_version = 1993 THEN 'pending' WHEN reward > 1 THEN 'error' WHEN reward = 0.5 AND termination = 'human_transfer' THEN 'scoring_pending' WHEN termination = 'infrastructure_error' THEN 'infrastructure' ELSE 'valid' END AS state, count(*) AS n FROM b_rollouts GROUP BY 1"
)
def eval_triage_counts(spark, sf_dir):
    no = F.lit(False)
    year, stop = F.col("policy_version"), F.col("termination")
    state = evaluation.triage(no, F.col("slot") >= 20, no, no, year == 1992, year == 1993, ~scalars.is_unit_score(F.col("reward")), (F.col("reward") == 0.5) & (stop == "human_transfer"), stop == "infrastructure_error")
    return profiling.histogram(b.rollouts(spark, sf_dir).withColumn("state", state), "state")


@query(b.with_(b.ROLLOUTS) + f"SELECT count(*) AS rollouts, round(avg((reward = 1.0)::INT), 6) + 0.0 AS success_rate, round(avg(({_CUT})::INT), 6) + 0.0 AS truncated_rate, round(avg(reward), 6) + 0.0 AS mean_reward, round(quantile_cont(tokens, 0.5), 6) + 0.0 AS p50, round(quantile_cont(tokens, 0.9), 6) + 0.0 AS p90, round(quantile_cont(tokens, 0.99), 6) + 0.0 AS p99 FROM b_rollouts")
def profile_rollouts(spark, sf_dir):
    return profiling.profile_rollouts(b.rollouts(spark, sf_dir)).select("rollouts", *[r6(c).alias(c) for c in ("success_rate", "truncated_rate", "mean_reward", "p50", "p90", "p99")])


@query("SELECT count(n_chars) AS n, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS greatest FROM documents")
def profile_prompt_nearest_rank(spark, sf_dir):
    return profiling.nearest_rank(b.table(spark, sf_dir, "documents").select("n_chars"), "n_chars")


_CHUNKS = """chunks AS NOT MATERIALIZED (SELECT task_id, slot // 4 AS chunk, min(reward) AS lo, max(reward) AS hi FROM b_rollouts GROUP BY 1, 2 HAVING count(*) = 4)"""


@query(b.with_(b.ROLLOUTS, _CHUNKS) + "SELECT count(*) AS groups, round(avg((hi - lo <= 1e-12)::INT), 6) + 0.0 AS same_rate, round(avg((hi = 0)::INT), 6) + 0.0 AS zero_rate, round(avg((lo = 1)::INT), 6) + 0.0 AS one_rate, round(avg((hi - lo > 1e-12)::INT), 6) + 0.0 AS mixed_rate FROM chunks")
def chunked_group_rates(spark, sf_dir):
    out = groups.group_rates(groups.chunked_groups(b.rollouts(spark, sf_dir), 4))
    return out.select("groups", *[r6(c).alias(c) for c in ("same_rate", "zero_rate", "one_rate", "mixed_rate")])


@query(b.with_(b.ROLLOUTS) + "SELECT termination, count(*) AS n FROM b_rollouts GROUP BY 1")
def termination_histogram(spark, sf_dir):
    return profiling.histogram(b.rollouts(spark, sf_dir), "termination")


@query(b.with_(b.TOOL_EVENTS) + "SELECT error_kind, count(*) AS n FROM b_tool_events WHERE error_kind IS NOT NULL GROUP BY 1")
def tool_error_histogram(spark, sf_dir):
    return events.error_histogram(b.tool_events(spark, sf_dir))


@query(b.with_(b.ROLLOUTS) + "SELECT task_id, bool_and(slot < n) AND count(*) = n AS complete FROM (SELECT task_id, slot, 8 AS n FROM b_rollouts) GROUP BY task_id, n")
def group_slots(spark, sf_dir):
    rows = b.rollouts(spark, sf_dir)
    return groups.slots_complete(rows, 8, "task_id", "slot").select("task_id", "complete")


@query(b.with_(b.ROLLOUTS) + "SELECT task_id, count(DISTINCT policy_version) AS policy_version FROM b_rollouts GROUP BY 1 HAVING count(DISTINCT policy_version) > 1")
def group_identity(spark, sf_dir):
    return groups.single_policy(b.rollouts(spark, sf_dir), "task_id", ["policy_version"])


@query(b.with_(b.ROLLOUTS) + "SELECT count(*) AS groups, round(avg((hi - lo > 1e-12)::INT), 6) + 0.0 AS keep_rate, count(*) FILTER (WHERE hi = 0) AS all_zero, count(*) FILTER (WHERE lo = 1) AS all_one FROM (SELECT min(reward) AS lo, max(reward) AS hi FROM b_rollouts GROUP BY task_id)")
def sampling_metrics(spark, sf_dir):
    rows = b.rollouts(spark, sf_dir).groupBy("task_id").agg(F.min("reward").alias("lo"), F.max("reward").alias("hi"))
    return groups.sampling_metrics(rows.withColumn("kept", F.col("hi") - F.col("lo") > 1e-12)).withColumn("keep_rate", r6("keep_rate"))


@query(b.with_(b.ROLLOUTS) + "SELECT trajectory_id, slot, (task_id + slot * 10000019) % 2147483647 AS seed, 7 + task_id * 4 + slot AS slot_seed FROM b_rollouts")
def refill_seed(spark, sf_dir):
    return b.rollouts(spark, sf_dir).select("trajectory_id", F.col("slot").cast("long").alias("slot"), scalars.replacement_seed(F.col("task_id"), F.col("slot")).alias("seed"), scalars.slot_seed(F.lit(7), F.col("task_id"), 4, F.col("slot")).alias("slot_seed"))


# Curation

_LEAKED = "leaked AS NOT MATERIALIZED (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark i ON contains(d.text, i.text))"


def _leaked(spark, sf_dir):
    return curation.leaking(b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "benchmark"), "doc_id")


@query(b.with_(_LEAKED) + "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM leaked WHERE leaked.doc_id = documents.doc_id)")
def leak_anti_join(spark, sf_dir):
    return curation.leak_filter(b.table(spark, sf_dir, "documents").select("doc_id", "source"), _leaked(spark, sf_dir), "doc_id")


@query(b.with_(_LEAKED) + "SELECT source, count(*) AS n_removed FROM documents WHERE doc_id IN (SELECT doc_id FROM leaked) GROUP BY 1")
def leak_removed_by_source(spark, sf_dir):
    hit = curation.residual(b.table(spark, sf_dir, "documents").select("doc_id", "source"), _leaked(spark, sf_dir), "doc_id")
    return hit.groupBy("source").agg(F.count(F.lit(1)).alias("n_removed"))


@query(
    b.with_(_LEAKED, "kept AS NOT MATERIALIZED (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaked))")
    + "SELECT (SELECT count(*) FROM kept JOIN leaked USING (doc_id)) AS residual, (SELECT count(*) FROM leaked WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unmatched"
)
def leak_verify(spark, sf_dir):
    docs, manifest = b.table(spark, sf_dir, "documents").select("doc_id", "source"), _leaked(spark, sf_dir)
    kept = curation.leak_filter(docs, manifest, "doc_id")
    left = curation.residual(kept, manifest, "doc_id").agg(F.count(F.lit(1)).alias("residual"))
    return left.withColumn("unmatched", curation.unmatched_manifest(docs, manifest, "doc_id").agg(F.count(F.lit(1))).scalar())


_TAG = "regexp_matches(text, '(?i)</?think(?:\\s[^>]*)?>')"


@query(b.with_(b.SFT_DOCS) + f"SELECT CASE WHEN quality = 0 THEN 'not_successful' WHEN toxic = 1 THEN 'termination' WHEN {_TAG} THEN 'reasoning' WHEN n_chars > 16384 THEN 'token_budget' ELSE 'accepted' END AS reason, count(*) AS n FROM b_sft_docs GROUP BY 1")
def sft_reject_reasons(spark, sf_dir):
    rules = [("not_successful", F.col("quality") == 0), ("termination", F.col("toxic") == 1), ("reasoning", scalars.has_think_tag(F.col("text"))), ("token_budget", F.col("n_chars") > 16_384)]
    return profiling.histogram(b.sft_docs(spark, sf_dir).withColumn("reason", F.coalesce(curation.first_reason(rules), F.lit("accepted"))), "reason")


@query(f"SELECT doc_id, {_TAG} AS has_think FROM documents")
def think_filter(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", scalars.has_think_tag(F.col("text")).alias("has_think"))


@query(
    b.with_(b.MESSAGES)
    + """SELECT dialog_id, message_index, n_history, sha256(history) AS history_sha256, sha256(content) AS answer_sha256 FROM (
  SELECT dialog_id, message_index, role, content, lag(role) OVER w AS before,
    count(*) OVER (PARTITION BY dialog_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_history,
    string_agg(role || ':' || content, chr(10)) OVER (PARTITION BY dialog_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history
  FROM b_messages WINDOW w AS (PARTITION BY dialog_id ORDER BY message_index)) WHERE role = 'assistant' AND before IN ('user', 'tool')"""
)
def sft_prefix_targets(spark, sf_dir):
    return curation.prefix_targets(b.messages(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def sft_fingerprint_dedup(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return curation.first_by_fingerprint(docs, F.col("fingerprint"), ["doc_id"])


@query("SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 4")
def sft_task_cap(spark, sf_dir):
    good = b.sft_docs(spark, sf_dir).where("quality = 1").select("source", "doc_id")
    return curation.capped(good, ["source"], ["doc_id"], 4)


@query(
    b.with_(b.MESSAGES, "d AS NOT MATERIALIZED (SELECT DISTINCT dialog_id FROM b_messages)")
    + "SELECT dialog_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || dialog_id), dialog_id) <= least(greatest(1, round_even((SELECT count(*) FROM d) * 0.05, 0)), (SELECT count(*) FROM d) - 1) THEN 'validation' ELSE 'train' END AS split FROM d"
)
def sft_dialog_split(spark, sf_dir):
    dialogs = b.messages(spark, sf_dir).select("dialog_id").distinct()
    return curation.group_split(dialogs, "dialog_id", 0.05, 42).select("dialog_id", "split")


@query("SELECT sha256(content) AS prompt_sha256, count(*) AS n_dialogs, max(n) AS most_in_a_dialog FROM (SELECT conv_id, count(*) AS n, min_by(text, turn) AS content FROM conversations WHERE role = 'system' GROUP BY 1) GROUP BY 1")
def system_prompts(spark, sf_dir):
    return curation.system_prompts(b.messages(spark, sf_dir))


@query("SELECT conv_id AS dialog_id, sha256(string_agg(role || ':' || sha256(text), ',' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def dialog_digest(spark, sf_dir):
    return profiling.ordered_digest(b.messages(spark, sf_dir), "dialog_id", "message_index", F.concat(F.col("role"), F.lit(":"), F.sha2("content", 256)))


# Tool events

_MARKED = """marked AS NOT MATERIALIZED (SELECT *, coalesce(NOT success AND NOT lag(success) OVER w, false) AS unchanged_retry,
  coalesce(success AND lag(success) OVER w AND NOT db_effect AND NOT lag(db_effect) OVER w AND result = lag(result) OVER w, false) AS no_progress
  FROM b_tool_events WINDOW w AS (PARTITION BY trajectory_id, name, args ORDER BY sequence))"""


def _marked(spark, sf_dir):
    return events.mark_repetition(b.tool_events(spark, sf_dir), ["trajectory_id", "name", "args"])


@query(b.with_(b.TOOL_EVENTS, _MARKED) + "SELECT event_id, unchanged_retry, no_progress FROM marked")
def event_repetition(spark, sf_dir):
    return _marked(spark, sf_dir).select("event_id", "unchanged_retry", "no_progress")


_READS = "name IN ('click', 'view')"


@query(
    b.with_(b.TOOL_EVENTS)
    + f"SELECT event_id, CASE WHEN NOT {_READS} THEN 'excluded' WHEN NOT success THEN 'failed_read' WHEN rn = 1 THEN 'first_success' ELSE 'duplicate' END AS query_status, CASE WHEN {_READS} AND success AND rn > 1 THEN first_id END AS duplicate_of FROM (SELECT *, row_number() OVER w AS rn, first_value(event_id) OVER w AS first_id FROM b_tool_events WINDOW w AS (PARTITION BY {_READS} AND success, trajectory_id, name, args ORDER BY sequence))"
)
def event_duplicate_query(spark, sf_dir):
    out = events.duplicate_queries(b.tool_events(spark, sf_dir), ["trajectory_id", "name", "args"], F.col("name").isin("click", "view"))
    return out.select("event_id", "query_status", "duplicate_of")


_COST = "CASE WHEN error_kind = 'model_caused_execution_error' THEN 0.08 ELSE 0.0 END::DOUBLE + CASE WHEN unchanged_retry THEN 0.06 ELSE 0.0 END::DOUBLE + CASE WHEN no_progress THEN 0.03 ELSE 0.0 END::DOUBLE"


def _turn_counts(rows):
    return rows.groupBy("trajectory_id").agg(F.max("turn_id").alias("turns"))


@query(b.with_(b.TOOL_EVENTS, _MARKED) + f"SELECT trajectory_id, max(turn_id) AS turns, round(least(sum({_COST}) + least(greatest(max(turn_id) - 15, 0) * 0.02::DOUBLE, 0.08::DOUBLE), 0.2::DOUBLE), 6) + 0.0 AS penalty FROM marked GROUP BY 1")
def process_penalty(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    return longs(events.process_penalty(rows, _turn_counts(rows)), "turns").withColumn("penalty", r6("penalty"))


@query(
    b.with_(b.TOOL_EVENTS, _MARKED)
    + f""", own AS NOT MATERIALIZED (SELECT trajectory_id, turn_id - 1 AS turn, {_COST} AS c FROM marked),
extra AS NOT MATERIALIZED (SELECT trajectory_id, turn_id - 1 AS turn, greatest(0, least(0.02::DOUBLE, 0.08::DOUBLE - (turn_id - 1 - 15) * 0.02::DOUBLE)) AS c FROM b_tool_events WHERE turn_id > 15),
by_turn AS NOT MATERIALIZED (SELECT trajectory_id, turn, sum(c) AS cost FROM (SELECT * FROM own UNION ALL SELECT * FROM extra) GROUP BY 1, 2)
SELECT trajectory_id, turn, round(cost, 6) + 0.0 AS cost FROM (SELECT trajectory_id, turn, CASE WHEN total > 0.2 THEN cost * 0.2 / total ELSE cost END AS cost FROM (SELECT *, sum(cost) OVER (PARTITION BY trajectory_id) AS total FROM by_turn)) WHERE round(cost, 6) > 0"""
)
def process_turn_cost(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    out = events.turn_costs(rows, _turn_counts(rows))
    return out.select("trajectory_id", F.col("turn").cast("long").alias("turn"), r6("cost").alias("cost")).where("cost > 0")


_SCOPES = "SELECT n_name AS scope, n_regionkey FROM nation"


@query(
    b.with_(b.TOOL_EVENTS)
    + """, writes AS NOT MATERIALIZED (SELECT trajectory_id, event_id, sequence, name, args FROM b_tool_events WHERE db_effect),
budget AS NOT MATERIALIZED (SELECT 'purchase' AS name, '{"k": ' || s_nationkey || '}' AS args, count(*) AS n FROM supplier GROUP BY 1, 2)
SELECT event_id, running, coalesce(n, 0) AS budget, n IS NOT NULL AND running <= n AS allowed FROM (SELECT *, count(*) OVER (PARTITION BY trajectory_id, name, args ORDER BY sequence) AS running FROM writes) w LEFT JOIN budget USING (name, args)"""
)
def write_scope_budget(spark, sf_dir):
    writes = b.tool_events(spark, sf_dir).where("db_effect")
    annotated = b.table(spark, sf_dir, "supplier").select(F.lit("purchase").alias("name"), F.concat(F.lit('{"k": '), F.col("s_nationkey").cast("string"), F.lit("}")).alias("args"))
    return events.write_scope(writes, annotated, ["name", "args"], F.lit(True)).select("event_id", "running", "budget", "allowed")


@query(
    b.with_(b.TOOL_EVENTS)
    + "SELECT event_id, last_value(CASE WHEN db_effect THEN struct_pack(r := NULL::VARCHAR) WHEN success THEN struct_pack(r := result) END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).r AS snapshot FROM b_tool_events".replace("last_value(", "(last_value(").replace("1 PRECEDING).r", "1 PRECEDING)).r")
)
def latest_snapshot(spark, sf_dir):
    return events.latest_snapshot(b.tool_events(spark, sf_dir)).select("event_id", "snapshot")


@query(b.with_(b.TOOL_EVENTS) + "SELECT trajectory_id, min_by(event_id, sequence) AS transfer_event, min(sequence) AS transfer_sequence FROM b_tool_events WHERE name = 'signup' AND success GROUP BY 1")
def first_transfer(spark, sf_dir):
    return longs(events.first_transfer(b.tool_events(spark, sf_dir), "signup"), "transfer_sequence")


_PAIRS = "SELECT trajectory_id, args AS key, turn_id AS turn FROM b_tool_events WHERE name = "


@query(b.with_(b.TOOL_EVENTS) + f"SELECT r.trajectory_id, r.key, r.turn, max(v.turn) AS revoked_by FROM ({_PAIRS}'error') r LEFT JOIN ({_PAIRS}'signup') v ON r.trajectory_id = v.trajectory_id AND r.key = v.key AND v.turn > r.turn GROUP BY 1, 2, 3")
def later_revocation(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir).select("name", "trajectory_id", F.col("args").alias("key"), F.col("turn_id").cast("long").alias("turn"))
    return events.later_revocations(rows.where("name = 'error'").drop("name"), rows.where("name = 'signup'").drop("name"), ["trajectory_id", "key"])


@query(
    b.with_(b.TOOL_EVENTS, _MARKED)
    + "SELECT trajectory_id, turn_id AS turn, NOT success OR no_progress AS bad_turn, name = 'purchase' AND success AND NOT no_progress AS eligible_correct_refusal FROM marked"
)
def turn_labels(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("turn", F.col("turn_id").cast("long"))
    evidence = rows.where("not success").select("trajectory_id", "turn", F.lit("tool_error").alias("source")).unionByName(rows.where("no_progress").select("trajectory_id", "turn", F.lit("duplicate").alias("source")))
    asked = rows.where("name = 'purchase'").select("trajectory_id", "turn")
    return events.turn_labels(rows.select("trajectory_id", "turn"), evidence, asked).select("trajectory_id", "turn", "bad_turn", "eligible_correct_refusal")


@query(
    """WITH f AS NOT MATERIALIZED (SELECT s_suppkey AS number, s_nationkey % 5 AS origin, s_suppkey % 5 AS destination, lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || ':00' AS departs, lpad(CAST((s_suppkey * 7) % 24 AS VARCHAR), 2, '0') || ':30' AS arrives FROM supplier)
SELECT a.number AS first_number, b.number AS second_number FROM f a JOIN f b ON a.destination = b.origin AND b.departs >= a.arrives"""
)
def one_stop_flights(spark, sf_dir):
    clock = lambda h, m: F.concat(F.lpad((h % 24).cast("string"), 2, "0"), F.lit(m))
    key = F.col("s_suppkey")
    flights = b.table(spark, sf_dir, "supplier").select(key.alias("number"), (F.col("s_nationkey") % 5).cast("long").alias("origin"), (key % 5).alias("destination"), clock(key, ":00").alias("departs"), clock(key * 7, ":30").alias("arrives"), F.lit("2024-05-10").alias("date"))
    return events.one_stop(flights).select("first_number", "second_number")


# Progress and rewards

_PHI = """phi AS NOT MATERIALIZED (SELECT *, sum(satisfied::INT::DOUBLE) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY trajectory_id) AS phi_after,
  (sum(satisfied::INT::DOUBLE) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - satisfied::INT::DOUBLE) / count(*) OVER (PARTITION BY trajectory_id) AS phi_before FROM b_turns)"""


def _phi(spark, sf_dir):
    return progress.running_phi(b.turns(spark, sf_dir))


@query(b.with_(b.TURNS, _PHI) + "SELECT trajectory_id, turn, round(phi_after, 6) + 0.0 AS phi, round(0.5 * (phi_after - phi_before), 6) + 0.0 AS delta FROM phi")
def progress_phi(spark, sf_dir):
    return longs(_phi(spark, sf_dir).select("trajectory_id", "turn", r6("phi_after").alias("phi"), r6(0.5 * (F.col("phi_after") - F.col("phi_before"))).alias("delta")), "turn")


@query(b.with_(b.TURNS) + "SELECT trajectory_id, turn, round(sum(cost) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS suffix FROM b_turns")
def suffix_turn_returns(spark, sf_dir):
    return longs(b.turns(spark, sf_dir).select("trajectory_id", "turn", r6(progress.suffix_sum(F.col("cost"))).alias("suffix")), "turn")


@query(
    b.with_(b.TURNS)
    + """, s AS NOT MATERIALIZED (SELECT trajectory_id, turn + 1 AS turn, satisfied AND NOT bad AS official, satisfied AS db, bad AS wrote FROM b_turns)
SELECT trajectory_id, min(turn) FILTER (WHERE official) AS first_success, count(*) FILTER (WHERE seen AND dropped AND wrote) AS regressions, count(*) FILTER (WHERE seen AND dropped AND NOT wrote) AS unattributed FROM (
  SELECT *, coalesce(bool_or(official) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen,
    coalesce(lag(db) OVER (PARTITION BY trajectory_id ORDER BY turn), false) AND NOT db AS dropped FROM s) GROUP BY 1"""
)
def first_completion_regression(spark, sf_dir):
    states = b.turns(spark, sf_dir).select("trajectory_id", (F.col("turn") + 1).cast("long").alias("turn"), (F.col("satisfied") & ~F.col("bad")).alias("official"), F.col("satisfied").alias("db"), F.col("bad").alias("wrote"))
    return progress.completion(states).groupBy("trajectory_id").agg(F.min("first_success").alias("first_success"), F.count_if("regression").alias("regressions"), F.count_if("unattributed").alias("unattributed"))


@query(b.with_(b.TURNS) + "SELECT trajectory_id, bool_and(satisfied OR NOT (bad OR refusal)) AS policy_gate FROM b_turns GROUP BY 1")
def policy_gate(spark, sf_dir):
    return reward.policy_gate(b.turns(spark, sf_dir).select("trajectory_id", F.col("satisfied").alias("passed"), (F.col("bad") | F.col("refusal")).alias("applicable")))


_COMPONENTS = """parts AS NOT MATERIALIZED (SELECT trajectory_id, avg(satisfied::INT) AS db, avg((NOT bad)::INT) FILTER (WHERE bad OR refusal) AS official_communicate,
  avg(satisfied::INT) FILTER (WHERE refusal) AS required_action, avg((cost < 0.05)::INT) FILTER (WHERE bad) AS judge_semantic, count(*) AS turns, least(sum(cost) / 10, 0.2::DOUBLE) AS penalty FROM b_turns GROUP BY 1)"""
_TERMS = {"db": 0.30, "official_communicate": 0.15, "required_action": 0.30, "judge_semantic": 0.25}
_TOTAL = " + ".join(f"coalesce({k} * {w}::DOUBLE, 0)" for k, w in _TERMS.items())
_WEIGHT = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in _TERMS.items())
_MEAN = f"(CASE WHEN {_WEIGHT} > 0 THEN ({_TOTAL}) / ({_WEIGHT}) ELSE 0 END)"
_STRICT = "(" + " AND ".join(f"({k} IS NULL OR {k} = 1)" for k in _TERMS) + ")::INT::DOUBLE"
_SCORED = f"""scored AS NOT MATERIALIZED (SELECT p.trajectory_id, {_MEAN} AS progress, {_STRICT} AS strict, penalty, db AS phi_end, r.reward AS completion, termination, {_CUT} AS cut, turns < 6 AS gate FROM parts p JOIN b_rollouts r ON p.trajectory_id = r.trajectory_id)"""


def _parts(spark, sf_dir):
    share = lambda c, where=None: F.avg((c if where is None else F.when(where, c)).cast("double"))
    bad, refusal = F.col("bad"), F.col("refusal")
    return b.turns(spark, sf_dir).groupBy("trajectory_id").agg(
        share(F.col("satisfied")).alias("db"), share(~bad, bad | refusal).alias("official_communicate"), share(F.col("satisfied"), refusal).alias("required_action"), share(F.col("cost") < 0.05, bad).alias("judge_semantic"), F.count(F.lit(1)).alias("turns"), F.least(F.sum("cost") / 10, F.lit(0.2)).alias("penalty")
    )


def _scored(spark, sf_dir):
    values = {k: F.col(k) for k in _TERMS}
    return _parts(spark, sf_dir).join(b.rollouts(spark, sf_dir), "trajectory_id").select("trajectory_id", reward.weighted_mean(values, reward.NORMAL_WEIGHTS).alias("progress"), reward.strict_success(values).alias("strict"), "penalty", F.col("db").alias("phi_end"), F.col("reward").alias("completion"), "termination", (F.col("turns") < 6).alias("gate"))


@query(b.with_(b.TURNS, _COMPONENTS) + f"SELECT trajectory_id, round({_MEAN}, 6) + 0.0 AS progress FROM parts")
def weighted_component_mean(spark, sf_dir):
    return _parts(spark, sf_dir).select("trajectory_id", r6(reward.weighted_mean({k: F.col(k) for k in _TERMS}, reward.NORMAL_WEIGHTS)).alias("progress"))


@query(b.with_(b.TURNS, _COMPONENTS) + f"SELECT trajectory_id, {_STRICT} AS strict FROM parts")
def strict_success(spark, sf_dir):
    return _parts(spark, sf_dir).select("trajectory_id", reward.strict_success({k: F.col(k) for k in _TERMS}).alias("strict"))


_FACTOR = "CASE WHEN cut THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END"
_REWARDS = b.with_(b.ROLLOUTS, b.TURNS, _COMPONENTS, _SCORED)


@query(_REWARDS + f"SELECT trajectory_id, round(CASE WHEN gate THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.75 * progress + 0.25 * strict - penalty)) ELSE 0 END * {_FACTOR} + 1e-9, 6) + 0.0 AS train_reward FROM scored")
def reward_legacy(spark, sf_dir):
    return _scored(spark, sf_dir).select("trajectory_id", r6(reward.legacy(F.col("progress"), F.col("strict"), F.col("penalty"), F.col("termination"), F.col("gate")) + TIE).alias("train_reward"))


@query(_REWARDS + f"SELECT trajectory_id, round(CASE WHEN gate THEN greatest(0.0::DOUBLE, {_FACTOR} * (strict + 0.5 * phi_end) - penalty) ELSE 0 END + 1e-9, 6) + 0.0 AS train_reward FROM scored")
def reward_strict_progress(spark, sf_dir):
    return _scored(spark, sf_dir).select("trajectory_id", r6(reward.strict_progress(F.col("strict"), F.col("phi_end"), F.col("penalty"), F.col("termination"), F.col("gate")) + TIE).alias("train_reward"))


@query(_REWARDS + "SELECT trajectory_id, round(CASE WHEN cut THEN 0 ELSE completion + 0.5 * phi_end END + 1e-9, 6) + 0.0 AS train_reward FROM scored")
def reward_turn_local(spark, sf_dir):
    zero = scalars.zero_truncated(F.lit("zero"), F.col("termination"))
    return _scored(spark, sf_dir).select("trajectory_id", r6(reward.turn_local(F.col("completion"), F.col("phi_end"), F.col("termination"), zero) + TIE).alias("train_reward"))


# Credit

_MEMBERS = """members AS NOT MATERIALIZED (SELECT task_id AS grp, trajectory_id, reward * (termination <> 'hard_turn_limit')::INT AS score, (reward = 1)::INT::DOUBLE AS terminal, (termination <> 'hard_turn_limit')::INT::DOUBLE AS multiplier,
  termination <> 'human_transfer' AS complete FROM b_rollouts WHERE termination <> 'infrastructure_error'),
base AS NOT MATERIALIZED (SELECT *, (score - avg(score) OVER g) / (stddev_pop(score) OVER g + 1e-6) AS baseline FROM members WINDOW g AS (PARTITION BY grp)),
joined AS NOT MATERIALIZED (SELECT phi.*, grp, terminal, multiplier, complete, baseline, tokens >= 3 AS present, phi_after - phi_before AS step, last_value(phi_after) OVER (PARTITION BY phi.trajectory_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS phi_end FROM phi JOIN base ON phi.trajectory_id = base.trajectory_id)"""


def _credit_frames(spark, sf_dir):
    """Turns and members; a task's rollouts are one group."""
    rows = b.rollouts(spark, sf_dir).where(F.col("termination") != "infrastructure_error")
    alive = (F.col("termination") != "hard_turn_limit").cast("double")
    members = rows.select(F.col("task_id").alias("group"), "trajectory_id", (F.col("reward") * alive).alias("score"), (F.col("reward") == 1).cast("double").alias("terminal"), alive.alias("multiplier"), (F.col("termination") != "human_transfer").alias("complete"))
    return _phi(spark, sf_dir).withColumn("present", F.col("tokens") >= 3), members


def _credit_sql(version: str) -> str:
    ahead = "sum(CASE WHEN bad THEN least(step, 0) ELSE step END) OVER (PARTITION BY trajectory_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    returns = {"v1": "multiplier * (terminal + 0.5 * (phi_end - phi_before))", "v4": "0.5 * step"}.get(version, f"CASE WHEN complete AND NOT bad THEN multiplier * (terminal + 0.5 * {ahead}) ELSE 0 END")
    centred = "CASE WHEN complete AND present THEN ret - coalesce(avg(ret) FILTER (WHERE complete AND present) OVER (PARTITION BY grp), 0) ELSE 0 END"
    penalty = {"v2": "bad::INT::DOUBLE", "v3": "greatest(bad::INT::DOUBLE, cost)"}.get(version, "0")
    local = "CASE WHEN present THEN ret ELSE 0 END - bad::INT::DOUBLE - cost" if version == "v4" else centred
    value = "baseline + local"
    if version == "v4":
        value = f"CASE WHEN bad THEN least({value}, -1.0 - cost) ELSE {value} END"
    elif version in ("v2", "v3"):
        value = f"baseline + CASE WHEN {penalty} > 0 THEN least(local, 0) - {penalty} ELSE local END"
    return (
        b.with_(b.ROLLOUTS, b.TURNS, _PHI, _MEMBERS)
        + f", returned AS NOT MATERIALIZED (SELECT *, {returns} AS ret FROM joined), localised AS NOT MATERIALIZED (SELECT *, {local} AS local FROM returned)"
        + f" SELECT trajectory_id, turn, round(CASE WHEN multiplier = 0 THEN 0 ELSE {value} END + 1e-9, 6) + 0.0 AS advantage FROM localised"
    )


def _credit(spark, sf_dir, version, **options):
    out = credits.assign(*_credit_frames(spark, sf_dir), version=version, tasks=b.tasks_of(b.table(spark, sf_dir, "lineitem")), **options)
    return longs(out.select("trajectory_id", "turn", r6(F.col("advantage") + TIE).alias("advantage")), "turn")


@query(_credit_sql("v1"))
def credit_v1_future_return(spark, sf_dir):
    return _credit(spark, sf_dir, "v1")


@query(_credit_sql("v2"))
def credit_v2_clipped_suffix(spark, sf_dir):
    return _credit(spark, sf_dir, "v2")


@query(_credit_sql("v3"))
def credit_v3_process_cost(spark, sf_dir):
    return _credit(spark, sf_dir, "v3")


@query(_credit_sql("v4"))
def credit_v4_immediate(spark, sf_dir):
    return _credit(spark, sf_dir, "v4")


_GUARDED = _credit_sql("v4").replace(" SELECT trajectory_id, turn, round(", ", final AS NOT MATERIALIZED (SELECT *, (").replace(" + 1e-9, 6) + 0.0 AS advantage FROM localised", ") AS a FROM localised)")
_LABELLED = "CASE WHEN multiplier = 0 THEN 0 WHEN bad THEN least(a, -1) WHEN refusal THEN greatest(a + 1, 1) ELSE a END"


@query(_GUARDED + f" SELECT trajectory_id, turn, round({_LABELLED} + 1e-9, 6) + 0.0 AS advantage FROM final")
def credit_sign_guards(spark, sf_dir):
    return _credit(spark, sf_dir, "v4", labels=True)


@query(_GUARDED + f" SELECT CAST(sum(tokens) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN abs({_LABELLED}) > 1e-8 THEN tokens ELSE 0 END) AS BIGINT) AS nonzero_tokens FROM final")
def credit_token_broadcast_stats(spark, sf_dir):
    return credits.token_statistics(credits.assign(*_credit_frames(spark, sf_dir), version="v4", labels=True))


@query(_GUARDED + f" SELECT grp AS task_id, bool_or(abs({_LABELLED}) > 1e-8) AS has_signal FROM final WHERE present GROUP BY 1")
def credit_group_signal(spark, sf_dir):
    return credits.has_signal(credits.assign(*_credit_frames(spark, sf_dir), version="v4", labels=True)).withColumnRenamed("group", "task_id")


@query(_GUARDED + f" SELECT trajectory_id, CAST(sum(tokens + 1) AS BIGINT) AS n_tokens, round(sum(tokens * ({_LABELLED})) + 1e-9, 6) + 0.0 AS total FROM final GROUP BY 1")
def credit_token_arrays(spark, sf_dir):
    """Token advantages of whole responses, by digest; the arrays themselves stay in the operator."""
    turns, members = _credit_frames(spark, sf_dir)
    mapping = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tokens"))), lambda s: F.concat(F.array_repeat(s["turn"], s["tokens"]), F.array(F.lit(-1)))))
    responses = turns.groupBy("trajectory_id").agg(mapping.alias("response_turn_ids"))
    out = credits.broadcast_tokens(responses, credits.assign(turns, members, version="v4", labels=True))
    return out.select("trajectory_id", F.size("token_advantages").cast("long").alias("n_tokens"), r6(F.aggregate("token_advantages", F.lit(0.0), lambda a, x: a + x) + TIE).alias("total"))


# Profiles, clocks, replays

_RATIO = """z AS NOT MATERIALIZED (SELECT a.embedding AS cur, p.embedding AS old FROM embeddings a JOIN embeddings p ON a.vec_id = p.vec_id + 1),
d AS NOT MATERIALIZED (SELECT unnest(cur)::DOUBLE - unnest(old)::DOUBLE AS d, unnest(generate_series(0, len(cur) - 1)) AS pos FROM z)"""


@query(b.with_(_RATIO) + "SELECT count(*) AS n, round(avg(exp(d)), 6) + 0.0 AS mean, round(stddev_pop(exp(d)), 6) + 0.0 AS std, round(quantile_cont(exp(d), 0.01), 6) + 0.0 AS p01, round(quantile_cont(exp(d), 0.5), 6) + 0.0 AS p50, round(quantile_cont(exp(d), 0.99), 6) + 0.0 AS p99, round(max(abs(exp(d) - 1)), 6) + 0.0 AS max_off, round(avg(abs(d)), 6) + 0.0 AS mean_abs_delta FROM d WHERE pos % 2 = 1")
def ppo_ratio_stats(spark, sf_dir):
    vectors = b.table(spark, sf_dir, "embeddings")
    pairs = vectors.select("vec_id", F.col("embedding").alias("cur")).join(vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("old")), "vec_id")
    tokens = profiling.token_pairs(pairs, "cur", "old", F.col("pos") % 2)
    out = profiling.ratio_statistics(tokens)
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


@query(
    b.with_(b.TOOL_EVENTS)
    + """, c AS NOT MATERIALIZED (SELECT event_id, trajectory_id, sequence, db_effect, row_number() OVER w AS attempt, CAST(sum(db_effect::INT) OVER w AS BIGINT) AS optimizer_step FROM b_tool_events WINDOW w AS (PARTITION BY trajectory_id ORDER BY sequence))
SELECT event_id, attempt, optimizer_step, CAST(sum(1 - db_effect::INT) OVER (PARTITION BY trajectory_id, optimizer_step ORDER BY sequence) AS BIGINT) AS consecutive_skips FROM c"""
)
def step_clock(spark, sf_dir):
    return longs(barrier.step_clock(b.tool_events(spark, sf_dir), ["trajectory_id"], "sequence", F.col("db_effect")).select("event_id", "attempt", "optimizer_step", "consecutive_skips"), "attempt")


@query(b.with_(b.TOOL_EVENTS) + "SELECT trajectory_id, min_by(result, sequence) AS fatal_error, min(sequence) AS at FROM b_tool_events WHERE name = 'error' GROUP BY 1")
def failure_latch(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir).withColumn("error", F.col("result"))
    return longs(barrier.failure_latch(rows, "trajectory_id", F.col("name") == "error", "sequence"), "at")


@query(
    b.with_(b.TOOL_EVENTS)
    + "SELECT event_id, used, CASE name WHEN 'error' THEN used <= 3 WHEN 'signup' THEN used <= 1 ELSE false END AS replace FROM (SELECT *, count(*) OVER (PARTITION BY trajectory_id, name ORDER BY sequence) AS used FROM b_tool_events)"
)
def slot_recovery(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir).withColumn("cause", F.col("name"))
    return barrier.recovery(rows, {"error": 3, "signup": 1}, ["trajectory_id"], "sequence").select("event_id", "used", "replace")


@query(_REWARDS + ", config AS (SELECT * FROM (VALUES ('v11', 0.5::DOUBLE, 0.75::DOUBLE), ('v12', 0.5::DOUBLE, 0.0::DOUBLE), ('v13', 0.25::DOUBLE, 0.0::DOUBLE)) AS k(name, scale, factor)) SELECT name, count(*) AS n, round(avg(CASE WHEN cut THEN factor ELSE 1 END * (completion + scale * phi_end)), 6) + 0.0 AS mean_reward FROM scored, config GROUP BY 1")
def config_ablation(spark, sf_dir):
    configs = spark.createDataFrame([("v11", 0.5, 0.75), ("v12", 0.5, 0.0), ("v13", 0.25, 0.0)], "name string, scale double, factor double")
    rows = replay.over_configs(_scored(spark, sf_dir), configs)
    value = F.when(scalars.truncated(F.col("termination")), F.col("factor")).otherwise(1.0) * (F.col("completion") + F.col("scale") * F.col("phi_end"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(value)).alias("mean_reward"))


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    out = barrier.windowed_counts(b.table(spark, sf_dir, "events"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", (F.round("value", 4) + F.lit(0.0)).alias("value"))


# Records, annotations and sets


@query(
    b.with_(b.TURNS)
    + """SELECT trajectory_id, turn, start, start + tokens AS "end", coalesce(start < lag(start + tokens) OVER (PARTITION BY trajectory_id ORDER BY turn), false) AS overlaps FROM (
  SELECT *, prompt_len - first_value(prompt_len) OVER (PARTITION BY trajectory_id ORDER BY turn) AS start FROM (
    SELECT trajectory_id, turn, tokens, 100 + 30 * turn AS prompt_len FROM b_turns))"""
)
def token_offsets(spark, sf_dir):
    rows = b.turns(spark, sf_dir).select("trajectory_id", F.col("turn").cast("long").alias("turn"), (100 + 30 * F.col("turn")).cast("long").alias("prompt_len"), F.col("tokens").alias("output_len"))
    return progress.token_offsets(rows, order="turn").select("trajectory_id", "turn", "start", "end", "overlaps")


@query(
    b.with_(b.MESSAGES)
    + """, n AS NOT MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dialog_id, role, content ORDER BY message_index) AS rn FROM b_messages),
v AS NOT MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dialog_id, role, content ORDER BY message_index) AS rn FROM b_messages WHERE role <> 'system' AND message_index % 3 > 0)
SELECT n.dialog_id, n.message_index, v.message_index AS visible_message_index, v.message_index IS NULL AS has_content FROM n LEFT JOIN v ON n.dialog_id = v.dialog_id AND n.role = v.role AND n.content = v.content AND n.rn = v.rn"""
)
def compacted_transcript(spark, sf_dir):
    rows = b.messages(spark, sf_dir).withColumn("tool_calls", F.lit(None).cast("string"))
    out = records.compacted(rows, rows.where("role <> 'system' and message_index % 3 > 0"), by="dialog_id")
    return out.select("dialog_id", "message_index", "visible_message_index", F.col("content").isNotNull().alias("has_content"))


@query(
    b.with_(b.TOOL_EVENTS)
    + """, failed AS NOT MATERIALIZED (SELECT trajectory_id, 'rule-' || name AS rule_id, min(CASE WHEN name = 'error' THEN turn_id END) AS blamed, min(CASE WHEN name = 'click' THEN event_id END) AS event_id FROM b_tool_events WHERE name IN ('error', 'click', 'view') GROUP BY 1, name),
moved AS NOT MATERIALIZED (SELECT trajectory_id, min(turn_id) AS turn_id FROM b_tool_events WHERE name = 'signup' GROUP BY 1)
SELECT trajectory_id, rule_id, blamed - 1 AS turn, 'judge_explicit_blame' AS source FROM failed WHERE blamed IS NOT NULL
UNION ALL SELECT f.trajectory_id, f.rule_id, e.turn_id - 1, 'tool_event_id' FROM failed f JOIN b_tool_events e ON f.trajectory_id = e.trajectory_id AND f.event_id = e.event_id WHERE f.blamed IS NULL
UNION ALL SELECT trajectory_id, 'invalid_transfer', turn_id - 1, 'executed_tool' FROM moved"""
)
def policy_attribution(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir)
    one = lambda value, name: F.array_compact(F.array(F.min(F.when(F.col("name") == name, F.col(value)))))
    failed = rows.where("name in ('error', 'click', 'view')").groupBy("trajectory_id", F.concat(F.lit("rule-"), F.col("name")).alias("rule_id")).agg(one("turn_id", "error").alias("blamed_turns"), one("event_id", "click").alias("event_ids"))
    moved = rows.where("name = 'signup'").groupBy("trajectory_id").agg(F.min("turn_id").alias("turn_id"))
    return longs(records.policy_attribution(failed, rows, moved)[0], "turn")


@query(b.with_(b.TOOL_EVENTS) + "SELECT trajectory_id, event_id, NOT bad AND rn = 1 AS awarded FROM (SELECT trajectory_id, event_id, NOT success AS bad, row_number() OVER (PARTITION BY NOT success, trajectory_id, args ORDER BY turn_id) AS rn FROM b_tool_events)")
def first_clean_refusal(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir).select("trajectory_id", "event_id", "args", (~F.col("success")).alias("bad"), F.col("turn_id").alias("turn"))
    return events.first_clean_refusals(rows, ["trajectory_id", "args"]).select("trajectory_id", "event_id", "awarded")


@query(
    b.with_(b.TOOL_EVENTS)
    + """, t AS NOT MATERIALIZED (SELECT trajectory_id, min(sequence) AS at FROM b_tool_events WHERE name = 'signup' AND success GROUP BY 1),
m AS NOT MATERIALIZED (SELECT e.trajectory_id, e.name FROM b_tool_events e JOIN t ON e.trajectory_id = t.trajectory_id WHERE e.success AND e.sequence < t.at AND e.name IN ('view', 'click') GROUP BY 1, 2 HAVING count(*) >= CASE e.name WHEN 'view' THEN 2 ELSE 1 END)
SELECT t.trajectory_id, count(m.name) / 2.0::DOUBLE AS value FROM t LEFT JOIN m ON t.trajectory_id = m.trajectory_id GROUP BY 1"""
)
def pre_transfer_actions(spark, sf_dir):
    rows = b.tool_events(spark, sf_dir)
    wanted = spark.createDataFrame([("g1", "view", 2), ("g2", "click", 1)], "group_id string, name string, min_count int")
    return events.pre_transfer_share(rows, events.first_transfer(rows, "signup"), wanted)


@query(b.with_(b.TURNS, _PHI) + "SELECT trajectory_id, bool_or(NOT satisfied) AS included, CASE WHEN bool_or(NOT satisfied) THEN 'verified_unmet_progress' ELSE 'no_unmet_progress' END AS reason FROM phi GROUP BY 1")
def training_selection(spark, sf_dir):
    checks = b.turns(spark, sf_dir).select(F.col("trajectory_id").alias("task_id"), F.lit(True).alias("included"), F.col("satisfied").alias("initial"))
    return records.training_selection(checks.select("task_id").distinct(), checks).select(F.col("task_id").alias("trajectory_id"), "included", "reason")


@query("SELECT item_id || ':policy:' || rule AS criterion_id FROM benchmark, (VALUES ('user_identity'), ('refund_destination'), ('passenger_count')) AS r(rule)")
def policy_rubric(spark, sf_dir):
    tasks = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"))
    return records.policy_rows(tasks, ["user_identity", "refund_destination", "passenger_count"]).select("criterion_id")


@query("SELECT DISTINCT doc_id AS id FROM (SELECT doc_id FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id FROM documents WHERE n_chars < 200)")
def cleanup_union(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    tagged = docs.where("source = 'src1'").select(F.lit("dynamic").alias("set_name"), F.col("doc_id").alias("id")).unionByName(docs.where("n_chars < 200").select(F.lit("template").alias("set_name"), F.col("doc_id").alias("id"))).unionByName(docs.select(F.lit("ablation").alias("set_name"), F.col("doc_id").alias("id")))
    return curation.cleanup_sets(tagged, ["dynamic", "template"])


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def repair_overlay(spark, sf_dir):
    repairs = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return curation.overlay(b.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), repairs, "c_custkey", ["c_acctbal"])


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def manifest_gaps(spark, sf_dir):
    """Labelled ids that no longer document has."""
    docs = b.table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id")
    return curation.unmatched_manifest(docs, b.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT o_orderkey AS trajectory_id, o_custkey AS task_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_validation(spark, sf_dir):
    rows = b.rollouts(spark, sf_dir).select("trajectory_id", "task_id")
    return groups.latest_by_session(rows, ["task_id"], "trajectory_id")


@query(b.with_(b.ROLLOUTS, b.TURNS) + ", a AS NOT MATERIALIZED (SELECT trajectory_id, reward FROM b_rollouts), c AS NOT MATERIALIZED (SELECT trajectory_id, count(*) FILTER (WHERE satisfied) > 2 AS ok FROM b_turns GROUP BY 1) SELECT a.trajectory_id, reward AS base, CASE WHEN ok THEN 1.0 ELSE reward END::DOUBLE AS other FROM a JOIN c ON a.trajectory_id = c.trajectory_id WHERE abs(reward - CASE WHEN ok THEN 1.0 ELSE reward END) > 1e-12")
def replay_changes(spark, sf_dir):
    base = b.rollouts(spark, sf_dir).select("trajectory_id", "reward")
    enough = b.turns(spark, sf_dir).groupBy("trajectory_id").agg((F.count_if("satisfied") > 2).alias("ok"))
    both = base.join(enough, "trajectory_id")
    return replay.changed(both, both.withColumn("reward", F.when(F.col("ok"), 1.0).otherwise(F.col("reward"))), ["trajectory_id"], "reward")


# Without an equivalent in SQL


@query(
    b.with_(b.TOOL_EVENTS)
    + """, wanted AS NOT MATERIALIZED (SELECT trajectory_id, CAST(event_id AS VARCHAR) AS action_id, name, args FROM b_tool_events WHERE sequence < 5),
ranked AS NOT MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trajectory_id, name, args ORDER BY action_id) AS k FROM wanted),
usable AS NOT MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trajectory_id, name, args ORDER BY sequence) AS k FROM b_tool_events WHERE success)
SELECT r.trajectory_id, r.action_id, u.event_id FROM ranked r JOIN usable u ON r.trajectory_id = u.trajectory_id AND r.name = u.name AND r.args = u.args AND r.k = u.k"""
)
def action_matching(spark, sf_dir):
    """Required actions of each user, matched one-to-one among all events.

    The tables have no annotations. The first five events of each user, in order of time and then of id, stand for
    the short list of required actions of a task; the events they are matched among are all of the user's. Equal
    actions have equal candidates, so the first takes the first, and so on.
    """
    rows = b.tool_events(spark, sf_dir).withColumn("args_key", canon.arguments_key()(F.col("name"), F.col("args")))
    wanted = rows.where("sequence < 5").select("trajectory_id", F.col("event_id").cast("string").alias("action_id"), "name", "args_key")
    return matching.match_actions(matching.candidates(wanted, rows, ["trajectory_id"]))


@query(
    b.with_(b.TOOL_EVENTS)
    + """, goals AS NOT MATERIALIZED (SELECT *, name IN ('purchase', 'signup') AS goal, CAST(result AS BIGINT) % 2 = 0 AS ok FROM b_tool_events),
own AS NOT MATERIALIZED (SELECT *, lag(ok) OVER (PARTITION BY trajectory_id, name ORDER BY sequence) AS was FROM goals WHERE goal),
steps AS NOT MATERIALIZED (SELECT *, ok AND row_number() OVER (PARTITION BY trajectory_id, name, ok ORDER BY sequence) = 1 AS won, NOT ok AND coalesce(was, false) AND sum(CASE WHEN NOT ok AND was THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id, name ORDER BY sequence) = 1 AS fell FROM own)
SELECT g.trajectory_id, CAST(g.sequence AS INTEGER) AS turn, round(CASE WHEN s.won THEN 0.25 WHEN s.fell THEN -0.25 ELSE 0 END::DOUBLE, 6) + 0.0 AS credit,
  round((CASE WHEN last_value(CASE WHEN g.name = 'purchase' THEN g.ok END IGNORE NULLS) OVER w THEN 0.5 ELSE 0 END + CASE WHEN last_value(CASE WHEN g.name = 'signup' THEN g.ok END IGNORE NULLS) OVER w THEN 0.5 ELSE 0 END)::DOUBLE, 6) + 0.0 AS phi
FROM goals g LEFT JOIN steps s ON g.trajectory_id = s.trajectory_id AND g.sequence = s.sequence WINDOW w AS (PARTITION BY g.trajectory_id ORDER BY g.sequence)"""
)
def db_subgoal_trace(spark, sf_dir):
    """Credits of two subgoals over each user's events, one turn an event."""
    rows = b.tool_events(spark, sf_dir)
    shaped = rows.select("trajectory_id", "turn_id", "sequence", F.when(F.col("name").isin("purchase", "signup"), F.col("name")).alias("goal"), (F.col("result").cast("long") % 2 == 0).alias("ok"), F.col("db_effect").alias("effect"), (F.col("name") == "error").alias("violates"))
    goals = ["purchase", "signup"]
    return subgoals.subgoal_credit(shaped, goals).withColumn("credit", r6("credit")).withColumn("phi", r6("phi"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS fingerprint FROM events")
def canonical_json_hash(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", canon.fingerprint("props").alias("fingerprint"))


@query("SELECT conv_id AS dialog_id, turn AS message_index, turn % 5 IN (1, 2) OR regexp_matches(text, '(?i)</?think(?:\\s[^>]*)?>') AS has_reasoning, turn % 5 IN (1, 2, 3) OR regexp_matches(text, '(?i)</?think(?:\\s[^>]*)?>') AS contains_reasoning FROM conversations")
def reasoning_scan(spark, sf_dir):
    """Whether a message's JSON holds reasoning, under the lenient and the strict rule; some messages are given reasoning fields, with and without a value."""
    turn = F.col("message_index") % 5
    fields = [F.when(turn == 1, F.lit("so")).alias("Reasoning"), F.when(turn == 2, F.lit(0)).alias("thinking"), F.when(turn == 3, F.lit("")).alias("reasoning_content")]
    as_json = F.to_json(F.struct("role", "content", F.array(F.struct(*fields)).alias("parts")))
    return b.messages(spark, sf_dir).select("dialog_id", "message_index", canon.has_reasoning(as_json).alias("has_reasoning"), canon.contains_reasoning(as_json).alias("contains_reasoning"))


@query(
    """WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, source AS task, doc_id AS unit, sha256(text) AS fingerprint FROM documents),
walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS seen, MAP {}::MAP(VARCHAR, INTEGER) AS taken, NULL::VARCHAR AS task, NULL::BIGINT AS unit, NULL::VARCHAR AS fingerprint, false AS accepted
  UNION ALL SELECT s.k, CASE WHEN ok THEN list_append(seen, s.fingerprint) ELSE seen END, CASE WHEN ok THEN map_concat(taken, MAP {coalesce(s.task, '~'): n + 1}) ELSE taken END, s.task, s.unit, s.fingerprint, ok
  FROM (SELECT d.*, w.seen, w.taken, coalesce(w.taken[coalesce(d.task, '~')], 0) AS n, NOT list_contains(w.seen, d.fingerprint) AND coalesce(w.taken[coalesce(d.task, '~')], 0) < 4 AS ok FROM walk w JOIN d ON d.k = w.k + 1) s)
SELECT task, unit, fingerprint FROM walk WHERE accepted"""
)
def task_cap_with_dedup(spark, sf_dir):
    """The first four documents of each source that bring a new text, where texts of capped documents stay free for later sources."""
    docs = b.table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("unit"), F.col("doc_id").alias("place"), F.sha2("text", 256).alias("fingerprint"))
    return curation.cap_with_dedup(docs, "task", "unit", "place", "fingerprint", 4).select("task", "unit", "fingerprint")


@query(
    b.with_(b.ROLLOUTS)
    + """SELECT task_id || ':' || slot // 8 AS uid, CAST(count(*) FILTER (WHERE termination <> 'infrastructure_error') AS INTEGER) AS members, CAST(count(*) FILTER (WHERE termination = 'infrastructure_error') AS INTEGER) AS failed,
  coalesce(sum(reward) FILTER (WHERE termination <> 'infrastructure_error'), 0)::DOUBLE AS reward_sum FROM b_rollouts GROUP BY task_id, slot // 8"""
)
def stream_group_barrier(spark, sf_dir):
    """Groups of eight of each task's rollouts, and of those left over, held until all have settled; infrastructure errors leave the group.

    The rows go through a file stream in one run to its end, into a table in the shared folder.
    """
    run = F.floor(F.col("slot") / 8)
    rows = b.rollouts(spark, sf_dir).withColumn("size", F.least(F.lit(8), F.count(F.lit(1)).over(W.partitionBy("task_id")) - 8 * run).cast("int"))
    status = F.when(F.col("termination") == "infrastructure_error", "failed").otherwise("finished")
    shaped = rows.select(F.concat_ws(":", "task_id", run).alias("uid"), (F.col("slot") % 8).alias("session"), status.alias("status"), "reward", "size")
    queue, out, at = (shared_path(spark, k) for k in ("queue", "groups", "progress"))
    shaped.write.parquet(queue)
    stream = spark.readStream.schema(shaped.schema).parquet(queue)
    barrier.group_barrier(stream, "size").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(barrier.SETTLED).parquet(out)


def queries() -> dict[str, Query]:
    from rollmill.plans import checks, mechanisms  # noqa: F401  registers their queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from rollmill.plans import checks, mechanisms  # noqa: F401

    return dict(ORACLES)
