"""Queries over operators that need a mechanism of their own: running sums over ranges, interval levels, exact samples.

Bridges read the generic tables as their inputs; every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.operators import concurrency, curation, failures, matching, replay, scans, subgoals
from rollmill.operators.common import checked
from rollmill.plans import bridges as b
from rollmill.plans.catalogue import longs, query, r6
from rollmill.sources.shared import shared_path
from rollmill.streaming import expiry, refill

# Leases: an event takes a place of its type's pool for half a minute per unit of its value; those of the highest values never give it back.

_LEASES = """leases AS MATERIALIZED (SELECT event_type AS pool, event_id AS lease, epoch_us(ts) AS s, CASE WHEN value < 300 THEN epoch_us(ts) + CAST(floor(value * 30) AS BIGINT) * 1000000 END AS e FROM events),
steps AS MATERIALIZED (SELECT pool, lease, s AS at, CASE WHEN e = s THEN 1 ELSE 2 END AS turn, 1 AS change FROM leases UNION ALL SELECT pool, lease, e, CASE WHEN e = s THEN 1 ELSE 0 END, -1 FROM leases WHERE e IS NOT NULL),
levels AS MATERIALIZED (SELECT *, sum(change) OVER w AS level, coalesce(lead("at") OVER w - "at", 0) AS lasts FROM steps WINDOW w AS (PARTITION BY pool ORDER BY "at", turn, lease, -change))"""
STALL, DEADLINE = 900_000_000, 2_400_000_000


def _events(spark, sf_dir):
    """``at``: microseconds, whatever the session's time zone."""
    return b.table(spark, sf_dir, "events").withColumn("at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


def leases(spark, sf_dir):
    at = F.col("at")
    return _events(spark, sf_dir).select(F.col("event_type").alias("pool"), F.col("event_id").alias("lease"), at.alias("start"), F.when(F.col("value") < 300, at + F.floor(F.col("value") * 30) * 1_000_000).alias("end"))


@query(
    f"""WITH {_LEASES}
SELECT pool, count(*) FILTER (change > 0) AS n_leases, count(*) FILTER (change > 0) - count(*) FILTER (change < 0) AS open_leases, CAST(max(level) AS BIGINT) AS peak, min("at") FILTER (level = top AND change > 0) AS peak_at,
  CAST(sum(lasts) FILTER (level = top) AS BIGINT) AS time_at_peak, coalesce(max(lasts) FILTER (level > 0), 0) AS longest_gap, count(*) FILTER (level > 0 AND lasts >= {STALL}) AS n_stalls
FROM (SELECT *, max(level) OVER (PARTITION BY pool) AS top FROM levels) GROUP BY pool"""
)
def lease_peaks(spark, sf_dir):
    """Peaks of concurrently held leases of each pool, the time spent at them, and gaps without any progress."""
    return concurrency.peaks(leases(spark, sf_dir), stall=STALL)


@query(f'WITH {_LEASES} SELECT pool, lease, "at", CAST(level AS BIGINT) AS level FROM levels WHERE change > 0 AND level > 12')
def lease_faults(spark, sf_dir):
    """Leases that were taken although their pool's limit of twelve was reached."""
    return concurrency.faults(leases(spark, sf_dir), F.lit(12)).select("pool", "lease", "at", "level")


@query(
    f"""WITH waits AS (SELECT user_id % 3 AS pool, event_id AS waiter, epoch_us(ts) AS s, CASE WHEN value < 60 THEN epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 END AS e FROM events WHERE event_type IN ('view', 'click')),
moves AS MATERIALIZED (SELECT *, lead("at") OVER (PARTITION BY pool ORDER BY "at") AS next_at FROM (SELECT DISTINCT user_id % 3 AS pool, epoch_us(ts) AS at FROM events WHERE event_type NOT IN ('view', 'click'))),
found AS (SELECT w.*, (SELECT min("at") FROM moves m WHERE m.pool = w.pool AND "at" > s) AS moved, (SELECT min("at") FROM moves m WHERE m.pool = w.pool AND "at" > s AND (next_at IS NULL OR next_at - "at" >= {STALL})) AS low FROM waits w),
failed AS (SELECT *, least(s + {DEADLINE}, CASE WHEN moved IS NULL OR moved - s >= {STALL} THEN s + {STALL} ELSE low + {STALL} END) AS failed_at FROM found)
SELECT pool, waiter, s AS start, CASE WHEN failed_at = s + {DEADLINE} THEN 'deadline_exceeded' ELSE 'stalled' END AS reason, failed_at FROM failed WHERE e IS NULL OR e > failed_at"""
)
def queue_failures(spark, sf_dir):
    """Waiting events that met their deadline, or a stretch in which no event of another kind came."""
    events, at = _events(spark, sf_dir).withColumn("pool", F.col("user_id") % 3), F.col("at")
    asks = F.col("event_type").isin("view", "click")
    waits = events.where(asks).select("pool", F.col("event_id").alias("waiter"), at.alias("start"), F.when(F.col("value") < 60, at + F.floor(F.col("value") * 60) * 1_000_000).alias("end"))
    return concurrency.queue_failures(waits, events.where(~asks).select("pool", "at"), STALL, DEADLINE)


@query("SELECT user_id % 50 AS partition, count(*) FILTER (event_type = 'view') AS initial, count(*) FILTER (event_type = 'error') AS infrastructure, count(*) FILTER (event_type IN ('click', 'signup')) AS \"user\", count(*) FILTER (event_type = 'purchase') AS truncation FROM events GROUP BY 1")
def attempt_counts(spark, sf_dir):
    """Attempts by kind, the kinds read from event types."""
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "initial"), ("error", "infrastructure"), ("click", "user"), ("signup", "user"), ("purchase", "truncation")) for x in pair))
    return concurrency.attempt_counts(b.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("partition"), kinds[F.col("event_type")].alias("kind")))


# Graphs of errors: three events of a user in a row are a record; the second is the first one's cause, the third its context, or both are its members. Some third errors lead back to the first.

_ERRORS = """e AS MATERIALIZED (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS s, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
nodes AS MATERIALIZED (SELECT user_id * 100000 + s // 3 AS record, s % 3 AS node, k, CASE event_type WHEN 'view' THEN ['RuntimeError', 'Exception'] WHEN 'click' THEN ['ReadError', 'NetworkError', 'TransportError']
  WHEN 'purchase' THEN ['RateLimitError', 'APIStatusError'] WHEN 'signup' THEN ['ExceptionGroup', 'BaseExceptionGroup'] ELSE [['TimeoutError', 'OSError'], ['CancelledError'], ['EndOfStream'], ['OSError']][k % 4 + 1] END AS bases,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 5 = 0 THEN 400 ELSE 429 END END AS status FROM e),
edges AS MATERIALIZED (SELECT c.record, 0 AS parent, c.node AS child, CASE WHEN list_contains(p.bases, 'BaseExceptionGroup') THEN 'member' WHEN c.node = 1 THEN 'cause' ELSE 'context' END AS relation FROM nodes c JOIN nodes p ON p.record = c.record AND p.node = 0 WHERE c.node > 0
  UNION ALL SELECT record, 2, 0, 'cause' FROM nodes WHERE node = 2 AND k % 7 = 0
  UNION ALL SELECT record, 1, 2, 'cause' FROM nodes WHERE node = 2 AND k % 7 = 1)"""


@query(
    f"""WITH RECURSIVE {_ERRORS},
flags AS MATERIALIZED (SELECT *, list_has_any(bases, ['TransportError', 'NetworkError']) AS transport, list_contains(bases, 'TimeoutError') AS deadline, bases[1] = 'CancelledError' AS cancelled,
  list_has_any(bases, ['TimeoutError', 'TransportError']) OR coalesce(status = 429, false) AS service, bases[1] IN ('EndOfStream', 'OSError') AND NOT list_contains(bases, 'TimeoutError') AS beneath, bases[1] IN ('RuntimeError', 'ExceptionGroup') AS wraps FROM nodes),
steps AS MATERIALIZED (SELECT e.record, e.parent, CASE WHEN skip THEN n.child ELSE e.child END AS child FROM (SELECT e.*, p.deadline AND c.cancelled AND relation <> 'member' AS skip FROM edges e JOIN flags p ON p.record = e.record AND p.node = parent JOIN flags c ON c.record = e.record AND c.node = child) e
  LEFT JOIN edges n ON skip AND n.record = e.record AND n.parent = e.child AND n.relation <> 'member' WHERE NOT skip OR n.child IS NOT NULL),
walk AS (SELECT record, 0::BIGINT AS node, [0::BIGINT] AS path, false AS context, false AS circle FROM nodes WHERE node = 0
  UNION ALL SELECT w.record, s.child, list_append(path, s.child), context OR f.transport, list_contains(path, s.child) FROM walk w JOIN flags f ON f.record = w.record AND f.node = w.node JOIN steps s ON s.record = w.record AND s.parent = w.node WHERE NOT circle)
SELECT w.record, bool_and(NOT circle AND (service OR (context AND beneath) OR (wraps AND EXISTS (SELECT 1 FROM steps s WHERE s.record = w.record AND s.parent = w.node)))) AND any_value(w.record) % 4 <> 0 AS retryable FROM walk w JOIN flags f ON f.record = w.record AND f.node = w.node GROUP BY 1"""
)
def retry_graphs(spark, sf_dir):
    """Whether interactions may be tried again, on graphs of errors made of each user's events."""
    events = b.tool_events(spark, sf_dir).select(F.col("trajectory_id"), "sequence", "name", F.regexp_extract("args", "[0-9]+", 0).cast("long").alias("k"))
    names = lambda *x: F.array(*map(F.lit, x))
    kind, k = F.col("name"), F.col("k")
    odd = F.when(k % 4 == 0, names("TimeoutError", "OSError")).when(k % 4 == 1, names("CancelledError")).when(k % 4 == 2, names("EndOfStream")).otherwise(names("OSError"))
    bases = F.when(kind == "view", names("RuntimeError", "Exception")).when(kind == "click", names("ReadError", "NetworkError", "TransportError")).when(kind == "purchase", names("RateLimitError", "APIStatusError")).when(kind == "signup", names("ExceptionGroup", "BaseExceptionGroup")).otherwise(odd)
    status = F.when(kind == "purchase", F.when(k % 5 == 0, 400).otherwise(429))
    none = F.lit(None).cast("string")
    nodes = events.select((F.col("trajectory_id") * 100000 + F.floor(F.col("sequence") / 3)).alias("record"), (F.col("sequence") % 3).cast("long").alias("node"), "k", bases.alias("bases"), status.alias("status"), none.alias("errno"), none.alias("phase"))
    roots = nodes.where("node = 0").select("record", F.array_contains("bases", "BaseExceptionGroup").alias("group"))
    down = nodes.where("node > 0").join(roots, "record").select("record", F.lit(0).cast("long").alias("parent"), F.col("node").alias("child"), F.when(F.col("group"), "member").when(F.col("node") == 1, "cause").otherwise("context").alias("relation"))
    third = nodes.where("node = 2")
    back = third.where(k % 7 == 0).select("record", F.lit(2).cast("long").alias("parent"), F.lit(0).cast("long").alias("child"), F.lit("cause").alias("relation"))
    across = third.where(k % 7 == 1).select("record", F.lit(1).cast("long").alias("parent"), F.lit(2).cast("long").alias("child"), F.lit("cause").alias("relation"))
    records = roots.select("record", F.when(F.col("record") % 4 == 0, "token_alignment").otherwise("model_generation").alias("phase"), F.lit(0).cast("long").alias("root"))
    return failures.interaction_graph(records, nodes, down.unionAll(back).unionAll(across))


# State machines


@query(
    b.with_(b.TOOL_EVENTS)
    + """, w AS NOT MATERIALIZED (SELECT trajectory_id, sequence, sequence // 3 + 1 AS turn, CASE name WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 END AS g, CAST(result AS BIGINT) % 3 <> 0 AS ok, CAST(result AS BIGINT) % 11 = 5 AS unknown, CAST(result AS BIGINT) % 7 = 3 AS idle, name = 'error' AS violates FROM b_tool_events),
eff AS MATERIALIZED (SELECT * FROM w WHERE g IS NOT NULL AND NOT idle),
p AS MATERIALIZED (SELECT e.*, i.i, CASE WHEN i.i = g AND NOT unknown THEN ok END AS sets, coalesce(last_value(CASE WHEN i.i = g THEN ok AND NOT unknown END IGNORE NULLS) OVER (PARTITION BY trajectory_id, i.i ORDER BY sequence), false) AS proven FROM eff e CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) i),
held AS MATERIALIZED (SELECT *, NOT unknown AND proven AND coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY trajectory_id, i ORDER BY sequence), false) AS c FROM p),
moves AS MATERIALIZED (SELECT *, coalesce(lag(c) OVER (PARTITION BY trajectory_id, i ORDER BY sequence), false) AS was, last_value(c) OVER (PARTITION BY trajectory_id, i, turn ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS at_end FROM held),
marks AS MATERIALIZED (SELECT trajectory_id, turn, i, bool_or(NOT unknown AND NOT was AND c AND i = g AND ok) AND bool_and(at_end) AS may, bool_or(NOT unknown AND was AND NOT c) AS lost, bool_or(unknown) AS unknown, bool_or(i = g AND ok AND NOT c) AS failed, bool_and(at_end) AS at_end FROM moves GROUP BY ALL),
turns AS MATERIALIZED (SELECT trajectory_id, turn, bool_or(violates) AS violates, bool_or(g IS NOT NULL AND NOT ok) AS unmatched FROM w GROUP BY ALL),
wrongs AS MATERIALIZED (SELECT t.trajectory_id, t.turn, any_value(t.violates) AS violates, any_value(t.unmatched) OR coalesce(bool_or(m.lost OR m.unknown OR m.failed), false) AS wrong, coalesce(bool_or(m.lost), false) AS regression, coalesce(bool_or(m.unknown), false) AS unknown FROM turns t LEFT JOIN marks m ON m.trajectory_id = t.trajectory_id AND m.turn = t.turn GROUP BY t.trajectory_id, t.turn),
firsts AS MATERIALIZED (SELECT trajectory_id, i, min(turn) FILTER (may AND NOT wrong AND NOT violates) AS won, min(turn) FILTER (lost) AS fell FROM marks JOIN (SELECT trajectory_id, turn, wrong, violates FROM wrongs) USING (trajectory_id, turn) GROUP BY ALL),
grid AS MATERIALIZED (SELECT t.*, x.i, m.may, m.at_end, won, fell, coalesce(last_value(m.at_end IGNORE NULLS) OVER (PARTITION BY t.trajectory_id, x.i ORDER BY t.turn), false) AS holds FROM wrongs t CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) x LEFT JOIN marks m ON m.trajectory_id = t.trajectory_id AND m.turn = t.turn AND m.i = x.i LEFT JOIN firsts f ON f.trajectory_id = t.trajectory_id AND f.i = x.i)
SELECT trajectory_id, CAST(turn - 1 AS INTEGER) AS turn, round(0.5::DOUBLE / 3 * (count(*) FILTER (won = turn) - count(*) FILTER (fell = turn)), 6) + 0.0 AS credit, round(count(*) FILTER (holds)::DOUBLE / 3, 6) + 0.0 AS phi,
  any_value(wrong) AS wrong, (any_value(wrong) OR any_value(violates)) AND coalesce(bool_or(may AND (won IS NULL OR won > turn)), false) AS deferred, any_value(regression) AS regression, any_value(unknown) AS unknown FROM grid GROUP BY trajectory_id, turn"""
)
def subgoal_turns(spark, sf_dir):
    """Three subgoals over each user's events, three events a turn; some writes leave an unknown state, some change nothing."""
    events = b.tool_events(spark, sf_dir).select("trajectory_id", "sequence", "name", F.col("result").cast("long").alias("r"), (F.floor(F.col("sequence") / 3) + 1).cast("int").alias("turn_id"))
    goal = F.when(F.col("name") == "purchase", 0).when(F.col("name") == "signup", 1).when(F.col("name") == "click", 2)
    rows = events.withColumns({"g": goal, "ok": F.col("r") % 3 != 0, "unknown": F.col("r") % 11 == 5, "idle": F.col("r") % 7 == 3})
    sets = F.col("g").isNotNull() & ~F.col("idle") & ~F.col("unknown")
    rows = scans.running(rows, ["trajectory_id"], ["sequence"], last={f"s{i}": F.when(sets & (F.col("g") == i), F.col("ok")) for i in range(3)})
    state = F.when(~F.col("unknown"), F.array(*(F.coalesce(f"s{i}", F.lit(False)) for i in range(3))))
    writes = rows.where(F.col("g").isNotNull()).select("trajectory_id", "turn_id", "sequence", F.when(F.col("ok"), F.array("g")).otherwise(F.array().cast("array<int>")).alias("matches"), F.array("g").alias("names"), state.alias("state"), (~F.col("idle")).alias("effect"), F.lit(False).alias("outside"))
    trajectories = events.groupBy("trajectory_id").agg(F.max("turn_id").alias("turns"), F.collect_set(F.when(F.col("name") == "error", F.col("turn_id") - 1)).alias("violating")).withColumn("initial", F.array(*[F.lit(False)] * 3))
    out = subgoals.subgoal_turns(writes, trajectories, 3)
    return out.select("trajectory_id", "turn", r6("credit").alias("credit"), r6("phi").alias("phi"), "wrong", "deferred", "regression", "unknown")


@query(
    """WITH m AS (SELECT conv_id AS dialog_id, turn AS message_index, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'proposal' WHEN role = 'assistant' THEN 'action' ELSE 'reply' END AS kind, length(text) % 2 AS h, length(text) % 3 > 0 AS affirms FROM conversations),
s AS (SELECT *, sum(CASE WHEN kind = 'proposal' THEN 1 ELSE 0 END) OVER (PARTITION BY dialog_id ORDER BY message_index) AS stretch FROM m),
c AS (SELECT *, stretch > 0 AND kind = 'action' AND h = first_value(h) OVER w AND sum(CASE WHEN kind = 'reply' AND affirms THEN 1 ELSE 0 END) OVER w > 0 AND sum(CASE WHEN kind = 'reply' AND NOT affirms THEN 1 ELSE 0 END) OVER w = 0 AS may FROM s WINDOW w AS (PARTITION BY dialog_id, stretch ORDER BY message_index))
SELECT dialog_id, message_index, may AND row_number() OVER (PARTITION BY dialog_id, stretch, may ORDER BY message_index) = 1 AS confirmed FROM c"""
)
def one_shot_confirmations(spark, sf_dir):
    """Actions of the assistant that its own last proposal, and the user's reply to it, allow."""
    role, turn = F.col("role"), F.col("message_index")
    kind = F.when((role == "assistant") & (turn % 4 == 1), "proposal").when(role == "assistant", "action").otherwise("reply")
    talk = b.messages(spark, sf_dir).select("dialog_id", "message_index", kind.alias("kind"), (F.length("content") % 2).cast("string").alias("hash"), (F.length("content") % 3 > 0).alias("affirmative"))
    return subgoals.confirmations(talk)


# Streams


@query(
    """WITH e AS (SELECT user_id || '-' || CAST(epoch_us(ts) // 43200000000 AS VARCHAR) AS uid, CAST(event_id % 4 AS INTEGER) AS session, event_type, value, epoch_us(ts) // 1000 AS t FROM events),
told AS (SELECT uid, session, event_type = 'error' AS failed, value, row_number() OVER (PARTITION BY uid, session ORDER BY t, event_type = 'error' DESC) AS k FROM e WHERE event_type <> 'view'),
seen AS (SELECT uid, min(t) AS first FROM e GROUP BY 1),
sums AS (SELECT uid, count(*) AS n, count(*) FILTER (NOT failed) AS members, count(*) FILTER (failed) AS failed, coalesce(fsum(value) FILTER (NOT failed), 0) AS total FROM told WHERE k = 1 GROUP BY 1)
SELECT seen.uid, coalesce(members, 0) AS members, coalesce(failed, 0) AS failed, round(coalesce(total, 0), 6) + 0.0 AS reward_sum, coalesce(n, 0) < 2 AS expired FROM seen LEFT JOIN sums USING (uid)
WHERE coalesce(n, 0) >= 2 OR first + 21600000 <= (SELECT max(t) FROM e) - 600000"""
)
def stream_expiring_barrier(spark, sf_dir):
    """Half days of a user as groups of two sessions, streamed; those that never fill leave by their timer."""
    rows = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "open").otherwise("finished")
    half_day = F.floor(F.col("at") / 43_200_000_000).cast("string")
    shaped = rows.select(F.concat_ws("-", F.col("user_id").cast("string"), half_day).alias("uid"), (F.col("event_id") % 4).cast("int").alias("session"), status.alias("status"), F.col("value").alias("reward"), F.timestamp_micros("at").alias("at"))
    queue, out, marks = (shared_path(spark, k) for k in ("queue", "groups", "progress"))
    shaped.write.parquet(queue)
    stream = spark.readStream.schema(shaped.schema).parquet(queue)
    expiry.expiring_barrier(stream, 2, "6 hours", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return longs(spark.read.schema(expiry.OUT).parquet(out), "members", "failed").withColumn("reward_sum", r6("reward_sum"))


STEPS = 3

_WAVES = f"""groups AS MATERIALIZED (SELECT row_number() OVER (ORDER BY task_id) - 1 AS number, task_id, max(reward) - min(reward) > 1e-12 AS mixed FROM b_rollouts GROUP BY task_id),
n AS MATERIALIZED (SELECT count(*) AS n, greatest(1, count(*) // 8) AS target, greatest(1, count(*) // 10) AS wave_groups FROM groups),
asks AS (SELECT 0 AS step, 1 AS wave, 0::BIGINT AS first, wave_groups AS asked FROM n
  UNION ALL SELECT CASE WHEN more THEN step ELSE step + 1 END, CASE WHEN more THEN wave + 1 ELSE 1 END, CASE WHEN more THEN first ELSE first + asked END, CASE WHEN more THEN asked + least(wave_groups, target - usable) ELSE wave_groups END FROM (
    SELECT a.*, n.*, usable < target AND wave < 3 AS more FROM (SELECT asks.*, (SELECT count(*) FROM range(0, 100000) r(k), groups g, n WHERE k < asked AND g.number = (first + k) % n.n AND g.mixed) AS usable FROM asks) a, n) WHERE more OR step + 1 < {STEPS}),
ends AS MATERIALIZED (SELECT step, max(first) AS first, max(asked) AS asked FROM asks GROUP BY step),
picked AS (SELECT step, k, task_id, row_number() OVER (PARTITION BY step ORDER BY k) AS place, count(*) OVER (PARTITION BY step) AS usable FROM ends, range(0, 100000) r(k), groups g, n WHERE k < asked AND g.number = (first + k) % n.n AND g.mixed)
SELECT CAST(step AS BIGINT) AS policy_version, step || '-' || k AS uid, task_id FROM picked, n WHERE place <= target"""


@query(b.with_(b.ROLLOUTS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _WAVES)
def capped_refill(spark, sf_dir):
    """Three steps of sampling: tasks in order answer what waves ask for, mixed ones are usable; what each step handed on."""
    tasks = b.rollouts(spark, sf_dir).groupBy("task_id").agg((F.max("reward") - F.min("reward") > 1e-12).alias("mixed"))
    tasks = scans.numbered(tasks, ["task_id"], "number").withColumn("number", F.col("number") - 1)
    n = tasks.count()
    if not n:
        return spark.createDataFrame([], "policy_version long, uid string, task_id long")
    run = refill.Refill(spark, shared_path(spark, "refill"), refill.Rules(max(1, n // 8), max(1, n // 10), 3, True), STEPS)
    run.start()
    epoch, first, before = -1, {0: 0}, 0
    # this loop stands for the workers that answer requests: one pass a wave, of which there are at most nine
    while not (state := run.committed(epoch)).done:
        first.setdefault(state.step, before)
        asked = run.read("requests").where(F.col("policy_version") == state.step)
        number = F.split("uid", "-")[1].cast("long")
        found = asked.withColumn("k", number).withColumn("number", (F.col("k") + first[state.step]) % n).join(tasks, "number")
        before = first[state.step] + state.asked
        epoch += 1
        run.fold(found.select("uid", "policy_version", F.lit("finished").alias("status"), "mixed", F.col("k").alias("arrived")), epoch)
    starts = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    handed = run.read("batches").withColumn("number", ((starts[F.col("policy_version").cast("int")] + F.col("arrived")) % n))
    return handed.join(tasks, "number").select("policy_version", "uid", "task_id")


# Matching under an order


@query(
    b.with_(b.TOOL_EVENTS)
    + """, t AS MATERIALIZED (SELECT trajectory_id, name, sequence // 2 AS turn FROM b_tool_events WHERE success),
v AS (SELECT trajectory_id, min(turn) AS viewed FROM t WHERE name = 'view' GROUP BY 1),
c AS (SELECT t.trajectory_id, viewed, min(turn) AS clicked FROM t JOIN v USING (trajectory_id) WHERE name = 'click' AND turn > viewed GROUP BY ALL),
p AS (SELECT t.trajectory_id, min(turn) AS bought FROM t JOIN c USING (trajectory_id) WHERE name = 'purchase' AND turn > clicked GROUP BY 1)
SELECT trajectory_id, 'view' AS action_id FROM v UNION ALL SELECT trajectory_id, 'click' FROM c UNION ALL SELECT trajectory_id, 'purchase' FROM p
UNION ALL SELECT trajectory_id, unnest(['first', 'second'][1:least(2, count(*))]) FROM t WHERE name = 'signup' GROUP BY trajectory_id"""
)
def ordered_matching(spark, sf_dir):
    """Which of five required actions each user did: a view, a click in a later turn, a purchase in a later one still, and two signups at any time."""
    rows = b.tool_events(spark, sf_dir).withColumn("turn_id", F.floor(F.col("sequence") / 2)).withColumn("args_key", F.lit(""))
    wanted = spark.createDataFrame([("view", "view"), ("click", "click"), ("purchase", "purchase"), ("first", "signup"), ("second", "signup")], "action_id string, name string").withColumn("args_key", F.lit(""))
    edges = matching.candidates(wanted, rows, ["trajectory_id"])
    return matching.match_actions(edges, dependencies=[("view", "click"), ("click", "purchase")]).select("trajectory_id", "action_id")


# Exact samples


@query()
def seeded_sample(spark, sf_dir):
    """As many documents as there are labels, by Python's own sampling; its generator is no SQL, so tests hold it against Python."""
    docs, labels = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")
    return curation.seeded_sample(docs.select("doc_id", "source"), min(labels.count(), docs.count()), 42, ["doc_id"]).select("place", "doc_id", "source")


# Kinds of leaks: verbatim passages, all numbers and codes of a passage, and a passage's wording whatever fills its slots. Targets are two words of a passage that stand for a flight and its day.

_SKELETON = r"""list_filter(regexp_split_to_array(regexp_replace(lower({text}), '\d{{4}}-\d\d-\d\d(?:t\d\d:\d\d(?::\d\d)?)?|\d{{1,2}}:\d\d(?::\d\d)?|[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+|\b[0-9A-Za-z_]*\d[0-9A-Za-z_]*(?:[.,]\d+)*\b', '□', 'g'), '[^\p{{L}}\p{{M}}□]+'), lambda w: w <> '')"""


@query(
    f"""WITH doc AS MATERIALIZED (SELECT doc_id, {_SKELETON.format(text="text")} AS ws FROM documents), item AS MATERIALIZED (SELECT item_id, {_SKELETON.format(text="text")} AS ws FROM benchmark),
held AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS r FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM doc WHERE len(ws) > 2)),
runs AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(ws[i:i + 2], ' ') AS r FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM item WHERE len(ws) > 2)),
sizes AS (SELECT item_id, count(*) AS n FROM runs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_common, n AS n_runs FROM held JOIN runs USING (r) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8::DOUBLE * n - 1e-9)"""
)
def template_leaks(spark, sf_dir):
    """Documents that hold most of a benchmark item's wording, whatever fills its slots."""
    return curation.template_leaks(b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_PLAIN = r"list_transform(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}._@-]+'), lambda w: regexp_replace(w, '^[._@-]+|[._@-]+$', '', 'g'))"


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, text, {_PLAIN.format(text="text")} AS ws, {_SKELETON.format(text="text")} AS sk FROM documents),
i AS MATERIALIZED (SELECT item_id, text, list_distinct(list_filter({_PLAIN.format(text="text")}, lambda w: length(w) > 11)[1:2]) AS vs, {_SKELETON.format(text="text")} AS sk FROM benchmark),
verbatim AS (SELECT DISTINCT doc_id FROM d JOIN i ON i.text <> '' AND contains(d.text, i.text)),
vals AS (SELECT DISTINCT doc_id FROM d JOIN i ON len(vs) > 0 AND list_has_all(ws, vs)),
held AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(sk[k:k + 2], ' ') AS r FROM (SELECT doc_id, sk, unnest(generate_series(1, len(sk) - 2)) AS k FROM d WHERE len(sk) > 2)),
runs AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(sk[k:k + 2], ' ') AS r FROM (SELECT item_id, sk, unnest(generate_series(1, len(sk) - 2)) AS k FROM i WHERE len(sk) > 2)),
template AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, item_id FROM held JOIN runs USING (r) JOIN (SELECT item_id, count(*) AS n FROM runs GROUP BY 1) USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8::DOUBLE * n - 1e-9))),
u AS (SELECT doc_id, 'v' AS kind FROM verbatim UNION ALL SELECT doc_id, 'w' FROM vals UNION ALL SELECT doc_id, 't' FROM template)
SELECT doc_id, bool_or(kind = 'v') AS verbatim, bool_or(kind = 'w') AS "values", bool_or(kind = 't') AS template FROM u GROUP BY doc_id"""
)
def leak_kinds(spark, sf_dir):
    """Which kinds of leak each leaking document has."""
    bench = b.table(spark, sf_dir, "benchmark")
    words = F.transform(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}._@-]+"), lambda w: F.regexp_replace(w, r"^[._@-]+|[._@-]+$", ""))
    targets = bench.select("item_id", F.slice(F.filter(words, lambda w: F.length(w) > 11), 1, 2).alias("values"))
    return curation.leak_kinds(b.table(spark, sf_dir, "documents"), bench, targets, "doc_id", "item_id")


# Rescoring: rollouts as saved records. Some were made with another prompt, some under another rubric, some have inputs that were touched.

_INPUTS = """'{{"reward_project_config":{{"credit":{{"version":"{credit}"}},"reward":{{"progress_scale":' || {scale} || '}}}},"rewards":[' || CASE reward WHEN 1 THEN '1.0' WHEN 0.5 THEN '0.5' ELSE '0.0' END || '],"task_id":' || task_id || '}}'"""


@query(
    b.with_(b.ROLLOUTS)
    + f""", saved AS NOT MATERIALIZED (SELECT *, sha256({_INPUTS.format(credit="procredit-turn-v3", scale="'0.25'")}) AS digest, sha256({_INPUTS.format(credit="procredit-turn-v4", scale="'0.5'")}) AS fresh FROM b_rollouts)
SELECT trajectory_id, concat_ws(',', CASE WHEN termination = 'user_stop' THEN 'prompt' END, CASE WHEN policy_version < 1995 THEN 'rubric' END, CASE WHEN tokens < 50000 THEN 'inputs' END) AS broken, 'v1-rescored' AS reward_version, 'v1' AS came_from,
  CASE WHEN tokens < 50000 THEN sha256('touched') ELSE digest END AS source, fresh AS scoring_inputs_sha256, CAST(policy_version AS VARCHAR) AS manifest FROM saved"""
)
def rescored_lineage(spark, sf_dir):
    """Which records may be scored again, and what each says it came from."""
    project = lambda credit, scale: F.struct(F.struct(F.lit(credit).alias("version")).alias("credit"), F.struct(F.lit(scale).alias("progress_scale")).alias("reward"))
    rows = b.rollouts(spark, sf_dir).withColumn("scoring_inputs", F.struct("task_id", F.array("reward").alias("rewards"), project("procredit-turn-v3", 0.25).alias("reward_project_config")))
    old, scores = F.col("policy_version") < 1995, F.lit("{}")
    rows = rows.withColumns({
        "scoring_inputs_sha256": F.when(F.col("tokens") < 50_000, F.sha2(F.lit("touched"), 256)).otherwise(replay.inputs_sha256(rows)), "reward_version": F.lit("v1"), "evaluation_manifest_id": F.col("policy_version").cast("string"),
        "agent_system_prompt_sha256": F.when(F.col("termination") == "user_stop", "other").otherwise("bound"), "judge_rubric_sha256": F.when(old, "before").otherwise("now"), "official_scores": scores, "judge_result": scores, "environment_transcript": scores,
    })
    marked = checked(rows, replay.rescoring_rules(rows, "bound", F.lit("now")), "flag")
    out = replay.with_lineage(marked, "v1-rescored", project("procredit-turn-v4", 0.5))
    return out.select("trajectory_id", F.array_join("violations", ",").alias("broken"), "reward_version", F.col("rescored_from_reward_version").alias("came_from"), F.col("rescored_from_scoring_inputs_sha256").alias("source"), "scoring_inputs_sha256", F.col("rescored_from_evaluation_manifest_id").alias("manifest"))
