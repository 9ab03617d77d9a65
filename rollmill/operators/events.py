"""Tool-event analytics: repetition, duplicate queries, penalties, costs, write scopes, transfers, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions import scalars

# Penalties of the default profile.
PENALTIES = {
    "parse_error": 0.10,
    "unknown_tool": 0.10,
    "schema_invalid": 0.08,
    "model_caused_execution_error": 0.08,
    "confirmation_required": 0.0,
    "multiple_tool_calls": 0.10,
    "mixed_content_and_tool_call": 0.10,
    "unchanged_retry": 0.06,
    "duplicate_no_progress": 0.03,
    "extra_assistant_turn": 0.02,
}
CAP, SOFT_LIMIT, OVER_TURN_CAP = 0.20, 15, 0.08


def mark_repetition(events: DataFrame, key: list[str], order: str = "sequence", skip: Column | None = None) -> DataFrame:
    """Adds unchanged_retry and no_progress, against the latest earlier equal call.

    ``skip``: events that are neither marked nor compared with (blocked or control events).
    """
    base = events.withColumn("__skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    w = W.partitionBy("__skip", *key).orderBy(order)
    was, effect, result = (F.lag(c).over(w) for c in ("success", "db_effect", "result"))
    seen = F.lag(F.lit(True)).over(w).isNotNull() & ~F.col("__skip")
    failed = seen & ~F.col("success") & F.coalesce(~was, F.lit(False))
    idle = seen & F.col("success") & F.coalesce(was, F.lit(False)) & F.col("db_effect").eqNullSafe(F.lit(False)) & effect.eqNullSafe(F.lit(False)) & F.col("result").eqNullSafe(result)
    return base.withColumn("unchanged_retry", F.coalesce(failed, F.lit(False))).withColumn("no_progress", F.coalesce(idle, F.lit(False))).drop("__skip")


def duplicate_queries(events: DataFrame, key: list[str], reads: Column, proven: Column | None = None, order: str = "sequence") -> DataFrame:
    """Adds query_status and duplicate_of: later successful reads of one key duplicate the first.

    Status: excluded (no read), unresolved (no proof), failed_read, first_success or duplicate.
    """
    proof = F.lit(True) if proven is None else F.coalesce(proven, F.lit(False))
    seeds = reads & proof & F.col("success")
    w = W.partitionBy("__seed", *key).orderBy(order)
    base = events.withColumn("__seed", F.coalesce(seeds, F.lit(False))).withColumn("__first", F.first("event_id").over(w)).withColumn("__rn", F.row_number().over(w))
    status = (
        F.when(~reads, "excluded").when(~proof, "unresolved").when(~F.col("success"), "failed_read").when(F.col("__rn") == 1, "first_success").otherwise("duplicate")
    )
    return base.withColumn("query_status", status).withColumn("duplicate_of", F.when(F.col("__seed") & (F.col("__rn") > 1), F.col("__first"))).drop("__seed", "__first", "__rn")


def _price(kind: Column, penalties: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, amount in penalties.items():
        out = F.when(kind == name, F.lit(amount)).otherwise(out)
    return out


def event_cost(penalties: dict[str, float] | None = None, blocked: Column | None = None) -> Column:
    """Base error, retry and no-progress amounts of an event (error_kind, unchanged_retry, no_progress); blocked siblings cost nothing."""
    p = PENALTIES | (penalties or {})
    free = F.coalesce(F.col("error_kind") == "confirmation_required", F.lit(False))
    if blocked is not None:
        free = free | F.coalesce(blocked, F.lit(False))
    amount = F.coalesce(_price(F.col("error_kind"), p), F.lit(0.0)) + F.when(F.col("unchanged_retry"), p["unchanged_retry"]).otherwise(0.0) + F.when(F.col("no_progress"), p["duplicate_no_progress"]).otherwise(0.0)
    return F.when(free, F.lit(0.0)).otherwise(amount)


def over_turns(turns: Column, soft: int, each: float, cap: float | None) -> Column:
    total = F.greatest(F.lit(0), turns - soft) * F.lit(each)
    return total if cap is None else F.least(total, F.lit(cap))


def process_penalty(events: DataFrame, turns: DataFrame, by: str = "trajectory_id", penalties: dict[str, float] | None = None, cap: float | None = CAP, soft: int = SOFT_LIMIT, over_cap: float | None = OVER_TURN_CAP) -> DataFrame:
    """Per trajectory of ``turns`` (id, turns): the scalar penalty, capped."""
    p = PENALTIES | (penalties or {})
    costs = events.groupBy(by).agg(F.sum(event_cost(penalties)).alias("__c"))
    total = F.coalesce(F.col("__c"), F.lit(0.0)) + over_turns(F.col("turns"), soft, p["extra_assistant_turn"], over_cap)
    return turns.join(costs, by, "left").select(by, "turns", (total if cap is None else F.least(total, F.lit(cap))).alias("penalty"))


def turn_costs(events: DataFrame, turns: DataFrame, by: str = "trajectory_id", penalties: dict[str, float] | None = None, capped: bool = True, cap: float = CAP, soft: int = SOFT_LIMIT, over_cap: float = OVER_TURN_CAP) -> DataFrame:
    """Per trajectory and 0-based turn with a cost: what its events and its being an extra turn cost.

    ``capped``: extra turns share a capped amount in order, and all turns are scaled to the capped total.
    """
    p = PENALTIES | (penalties or {})
    each = p["extra_assistant_turn"]
    own = events.select(by, (F.col("turn_id") - 1).alias("turn"), event_cost(penalties).alias("c"))
    extra = turns.where(F.col("turns") > soft).select(by, F.explode(F.sequence(F.lit(soft), F.col("turns") - 1)).alias("turn"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(each), F.lit(over_cap) - (F.col("turn") - soft) * F.lit(each))) if capped else F.lit(each)
    by_turn = own.unionByName(extra.select(by, "turn", share.alias("c"))).groupBy(by, "turn").agg(F.sum("c").alias("cost"))
    if capped:
        total = F.sum("cost").over(W.partitionBy(by))
        by_turn = by_turn.withColumn("cost", F.when(total > cap, F.col("cost") * F.lit(cap) / total).otherwise(F.col("cost")))
    return by_turn.where("cost > 0")


def write_scope(events: DataFrame, annotations: DataFrame, scope: list[str], creations: Column, by: str = "trajectory_id", order: str = "sequence") -> DataFrame:
    """Adds allowed: the write's scope is annotated and, for creations, within its annotated budget.

    events: writes alone; annotations: one row for each annotated action (scope columns).
    """
    budget = annotations.groupBy(*scope).agg(F.count(F.lit(1)).alias("__budget"))
    running = F.count(F.lit(1)).over(W.partitionBy(by, *scope).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("running", running).join(budget, scope, "left")
    allowed = F.col("__budget").isNotNull() & (~creations | (F.col("running") <= F.col("__budget")))
    return rows.withColumn("budget", F.coalesce("__budget", F.lit(0)).cast("long")).withColumn("allowed", allowed).drop("__budget")


def first_transfer(events: DataFrame, name: str = "transfer_to_human_agents", by: str = "trajectory_id") -> DataFrame:
    """The first successful transfer of each trajectory."""
    return events.where((F.col("name") == name) & F.col("success")).groupBy(by).agg(F.min_by("event_id", "sequence").alias("transfer_event"), F.min("sequence").alias("transfer_sequence"))


def pre_transfer_share(events: DataFrame, transfers: DataFrame, groups: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Share of required action groups (group_id, name, min_count) met by successful events before the transfer."""
    before = events.join(transfers, by).where(F.col("success") & (F.col("sequence") < F.col("transfer_sequence")))
    met = before.join(groups, "name").groupBy(by, "group_id", "min_count").agg(F.count(F.lit(1)).alias("n")).where("n >= min_count")
    done = transfers.select(by).join(met.groupBy(by).agg(F.countDistinct("group_id").alias("m")), by, "left")
    return done.select(by, F.try_divide(F.coalesce("m", F.lit(0)), groups.agg(F.countDistinct("group_id")).scalar()).alias("value"))


def latest_snapshot(events: DataFrame, by: str = "trajectory_id", order: str = "sequence") -> DataFrame:
    """Adds snapshot: the latest successful read's result before an event; any effective write clears it."""
    mark = F.when(F.col("db_effect").eqNullSafe(F.lit(True)), F.struct(F.lit(None).cast("string").alias("r"))).when(F.col("success"), F.struct(F.col("result").alias("r")))
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("snapshot", F.last(mark, ignorenulls=True).over(w)["r"])


#: Characters of a time that name its stretch of the day, such as the hour.
STRETCH = 2
#: Pairs of a slot, and slots of a task, that candidates of connections are dealt to.
BLOCK, BLOCKS = 4_000_000, 4


def one_stop_candidates(flights: DataFrame) -> DataFrame:
    """Pairs that ``one_stop`` compares: a first leg meets the second legs of its airport and day that leave in its stretch of the day or in a later one.

    Stretches order as the times do, so only pairs within one are in doubt. A first leg is repeated for
    the stretches it reaches, at most as many as an airport's day has, and pairs are made by airport,
    day and stretch, so a hot airport's day is as many keys. A key's pairs are dealt to as many slots as
    they need, ``BLOCK`` pairs each: its first legs by hash, its second legs to all of them; and
    slots to as many tasks as they need, as what goes in is far less than what comes out. One count of
    pairs by key goes ahead, on which both depend.
    """
    first = flights.select(*[F.col(c).alias(f"first_{c}") for c in flights.columns], scalars.leg_day(F.col("arrives"), F.col("date")).alias("__d"), F.substring("arrives", 1, STRETCH).alias("__a"))
    second = flights.select(*[F.col(c).alias(f"second_{c}") for c in flights.columns], F.substring("departs", 1, STRETCH).alias("__s"))
    stretches = second.select(F.col("second_origin").alias("__o"), F.col("second_date").alias("__e"), F.col("__s").alias("__t")).distinct()
    reach = first.join(stretches, (F.col("first_destination") == F.col("__o")) & (F.col("__d") == F.col("__e")) & (F.col("__t") >= F.col("__a"))).drop("__d", "__a")
    second = second.withColumns({"__o": F.col("second_origin"), "__e": F.col("second_date")}).withColumnRenamed("__s", "__t")
    keys = ["__o", "__e", "__t"]
    sizes = reach.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(second.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m")), keys)
    slots = sizes.select(*keys, F.ceil(F.col("__n") * F.col("__m") / BLOCK).cast("int").alias("__slots"))
    tasks = max(int(flights.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(slots.agg(F.sum("__slots")).first()[0] or 0) // BLOCKS))
    dealt = reach.join(slots, keys).withColumn("__slot", F.pmod(F.xxhash64(*(c for c in first.columns if c.startswith("first_"))), F.col("__slots")).cast("int"))
    repeated = second.join(slots, keys).withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__slots") - 1)))
    keys = [*keys, "__slot"]
    # a number of tasks that is given is kept: small inputs aren't put together again
    return dealt.drop("__slots").repartition(tasks, *keys).join(repeated.drop("__slots").repartition(tasks, *keys), keys).drop(*keys)


def one_stop(flights: DataFrame) -> DataFrame:
    """Pairs of flights (date, origin, destination, departs, arrives, number) that connect: same airport, and no departure before the arrival; times compare as strings."""
    names = [f"{side}_{c}" for side in ("first", "second") for c in flights.columns]
    return one_stop_candidates(flights).where(F.col("second_departs") >= F.col("first_arrives")).select(*names)


def penalty_signals(events: DataFrame) -> DataFrame:
    """One row for each base error, retry and no-progress signal of an event."""
    signals = F.array_compact(F.array(F.when(F.col("error_kind") != "confirmation_required", F.col("error_kind")), F.when(F.col("unchanged_retry"), F.lit("unchanged_retry")), F.when(F.col("no_progress"), F.lit("duplicate_no_progress"))))
    return events.select("trajectory_id", "event_id", "turn_id", F.explode(signals).alias("kind"))


def error_histogram(events: DataFrame) -> DataFrame:
    return events.where(F.col("error_kind").isNotNull()).groupBy("error_kind").agg(F.count(F.lit(1)).alias("n"))


def policy_turn(messages: DataFrame, prefixes: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Assistant messages with the 1-based turn whose half-open prefix range (start, stop) holds them."""
    m, p = messages.alias("m"), prefixes.alias("p")
    return m.join(p, (F.col(f"m.{by}") == F.col(f"p.{by}")) & (F.col("m.message_index") >= F.col("p.start")) & (F.col("m.message_index") < F.col("p.stop")) & (F.col("m.role") == "assistant")).select("m.*", F.col("p.turn").alias("assistant_turn_id"))


def later_revocations(refusals: DataFrame, revocations: DataFrame, by: list[str]) -> DataFrame:
    """Refusals with the last later turn that revokes their key (null: none)."""
    r, v = refusals.alias("r"), revocations.alias("v")
    on = [F.col(f"r.{c}") == F.col(f"v.{c}") for c in by]
    joined = r.join(v, [*on, F.col("v.turn") > F.col("r.turn")], "left")
    return joined.groupBy(*[F.col(f"r.{c}") for c in refusals.columns]).agg(F.max("v.turn").alias("revoked_by"))


def first_clean_refusals(refusals: DataFrame, by: list[str]) -> DataFrame:
    """Adds awarded: of refusals of one key in turns that aren't bad, the first."""
    w = W.partitionBy("bad", *by).orderBy("turn")
    return refusals.withColumn("awarded", ~F.col("bad") & (F.row_number().over(w) == 1))


def turn_labels(turns: DataFrame, evidence: DataFrame, refusals: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """bad_turn (any evidence row: turn, source) and eligible_correct_refusal (a refusal in a turn that isn't bad)."""
    bad = evidence.groupBy(by, "turn").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    asked = refusals.select(by, "turn").distinct().withColumn("__r", F.lit(True))
    rows = turns.join(bad, [by, "turn"], "left").join(asked, [by, "turn"], "left")
    return rows.withColumn("bad_turn", F.col("sources").isNotNull()).withColumn("eligible_correct_refusal", F.coalesce("__r", F.lit(False)) & ~F.col("bad_turn")).drop("__r")
