"""Progress of check states over prefixes: phi, deltas, suffix sums, completion and regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def included(check: Column, initial: Column, version: str, has_db: Column) -> Column:
    """Whether a check counts: not satisfied at the start; version 2 leaves out ``req:`` checks where a db check exists."""
    base = ~F.coalesce(initial, F.lit(False))
    return base & ~(check.startswith("req:") & has_db) if version == "progress-v2" else base


def phi(checks: DataFrame, by: str = "trajectory_id", prefix: str = "prefix") -> DataFrame:
    """Per prefix: the share of included checks (value, included) that are satisfied; 0 where none is included."""
    share = F.avg(F.when(F.col("included"), F.col("value").cast("double")))
    return checks.groupBy(by, prefix).agg(F.coalesce(share, F.lit(0.0)).alias("phi"))


def running_phi(turns: DataFrame, satisfied: str = "satisfied", by: str = "trajectory_id", turn: str = "turn") -> DataFrame:
    """Adds phi_before and phi_after where a trajectory's checks are its turns, each settled by its own turn."""
    w = W.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    met = F.sum(F.col(satisfied).cast("double")).over(w.orderBy(turn).rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("phi_after", met / n).withColumn("phi_before", (met - F.col(satisfied).cast("double")) / n)


def deltas(prefixes: DataFrame, scale: float = 0.5, by: str = "trajectory_id", prefix: str = "prefix") -> DataFrame:
    """Per 0-based turn: scale * (phi after - phi before), signed."""
    step = F.lead("phi").over(W.partitionBy(by).orderBy(prefix)) - F.col("phi")
    return prefixes.withColumn("delta", F.lit(scale) * step).where("delta is not null").withColumnRenamed(prefix, "turn").drop("phi")


def suffix_sum(value: Column, by: str = "trajectory_id", turn: str = "turn") -> Column:
    """Sum of a value from this turn to the last."""
    return F.sum(value).over(W.partitionBy(by).orderBy(turn).rowsBetween(0, W.unboundedFollowing))


def terminal_progress(checks: DataFrame, judged: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Mean over final check values and semantic verdicts together; trajectories of neither have none here (0 by ``coalesce``)."""
    rows = checks.select(by, F.col("value").cast("double").alias("v")).unionByName(judged.select(by, F.col("passed").cast("double").alias("v")))
    return rows.groupBy(by).agg(F.avg("v").alias("progress"))


def completion(states: DataFrame, by: str = "trajectory_id", turn: str = "turn", done: str = "official", db: str = "db", wrote: str = "wrote") -> DataFrame:
    """Adds first_success (least turn that is done) and regression: db drops after completion in a turn with an effective write.

    states: one row for each turn 1 .. n; an initial row of turn 0 says whether all was done at the start.
    """
    w = W.partitionBy(by)
    ordered = w.orderBy(turn)
    seen = F.coalesce(F.bool_or(done).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    dropped = F.coalesce(F.lag(db).over(ordered), F.lit(False)) & ~F.col(db)
    first = F.min(F.when(F.col(done), F.col(turn))).over(w)
    return states.withColumn("first_success", first).withColumn("regression", seen & dropped & F.col(wrote)).withColumn("unattributed", seen & dropped & ~F.col(wrote))


def completion_bonus(states: DataFrame, db_positive: Column | float = 0.0, safe: Column | None = None, by: str = "trajectory_id", turn: str = "turn") -> DataFrame:
    """Adds bonus: max(0, 0.5 - what subgoals paid) in a safe first completing turn that a later regression undoes."""
    undone = F.bool_or("regression").over(W.partitionBy(by))
    paid = F.lit(db_positive) if isinstance(db_positive, float) else db_positive
    ok = undone & (F.col(turn) == F.col("first_success")) & (safe if safe is not None else F.lit(True))
    return states.withColumn("bonus", F.when(ok, F.greatest(F.lit(0.0), 0.5 - paid)).otherwise(0.0))


def token_offsets(turns: DataFrame, by: str = "trajectory_id", order: str = "assistant_turn_index") -> DataFrame:
    """start and end of each turn's output tokens in the response, from prompt and output lengths, and whether they overlap the turn before."""
    w = W.partitionBy(by).orderBy(order)
    start = F.col("prompt_len") - F.first("prompt_len").over(w)
    out = turns.withColumn("start", start).withColumn("end", F.col("start") + F.col("output_len"))
    return out.withColumn("overlaps", F.coalesce(F.col("start") < F.lag("end").over(w), F.lit(False)))
