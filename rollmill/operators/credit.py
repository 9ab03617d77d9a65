"""Credit assignment: from group scores to turn and token advantages, in four versions.

Frames: ``members`` has one row for each trajectory of a group (group, trajectory_id, score,
terminal, multiplier, complete), ``turns`` one for each actor turn (trajectory_id, turn from 0,
phi_before, phi_after, bad, refusal, cost, present: whether it owns tokens). Group statistics are
windows over members alone; the turns join them once, on the trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions.scalars import SIGNAL_TOLERANCE, STD_EPSILON, transform_advantage
from rollmill.operators.progress import suffix_sum

SCALE, VIOLATION = 0.5, 1.0
VERSIONS = ("v1", "v2", "v3", "v4")


def group_baseline(members: DataFrame, group: str = "group", normalize: bool = True) -> DataFrame:
    """Adds mean, std (population) and baseline, over all members, cut-off ones (score 0) included."""
    w = W.partitionBy(group)
    out = members.withColumn("mean", F.avg("score").over(w)).withColumn("std", F.stddev_pop("score").over(w))
    centred = F.col("score") - F.col("mean")
    return out.withColumn("baseline", centred / (F.col("std") + STD_EPSILON) if normalize else centred)


def turn_returns(version: str, by: str = "trajectory_id", turn: str = "turn") -> Column:
    """The return of a turn: v1 of what is still to come, v2 and v3 without what bad turns gained, v4 the turn's own step."""
    step = F.col("phi_after") - F.col("phi_before")
    if version == "v4":
        return SCALE * step
    if version == "v1":
        last = F.last("phi_after").over(W.partitionBy(by).orderBy(turn).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return F.col("multiplier") * (F.col("terminal") + SCALE * (last - F.col("phi_before")))
    ahead = suffix_sum(F.when(F.col("bad"), F.least(step, F.lit(0.0))).otherwise(step), by, turn)
    return F.when(F.col("complete") & ~F.col("bad"), F.col("multiplier") * (F.col("terminal") + SCALE * ahead)).otherwise(0.0)


def guarded(value: Column, bad: Column, cost: Column, floor: Column | None = None, regression: Column | None = None) -> Column:
    """Sign guards in their order: completion floor, policy ceiling, regression ceiling."""
    ceiling = F.lit(-VIOLATION) - cost
    out = value if floor is None else F.when(floor.isNotNull(), F.greatest(value, floor)).otherwise(value)
    out = F.when(bad, F.least(out, ceiling)).otherwise(out)
    return out if regression is None else F.when(regression, F.least(out, F.lit(-1.0) - cost)).otherwise(out)


def assign(turns: DataFrame, members: DataFrame, version: str = "v4", group: str = "group", normalize: bool = True, coefficient: float = 1.0, labels: bool = False, extra: Column | None = None, floor: Column | None = None, regression: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Turn advantages: adds turn_return, turn_advantage and advantage (what each of the turn's tokens gets).

    extra: opt-in local credit of a turn (subgoals, completion bonus); floor and regression: see
    ``guarded``; labels: end with the rule for bad turns and correct refusals. Members with
    multiplier 0 get zeros throughout. ``tasks``: over how many tasks turns are dealt by group where
    their group's mean is taken; without it, Spark's number of shuffle partitions.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown version: {version}")
    rows = turns.join(group_baseline(members, group, normalize), "trajectory_id").withColumn("turn_return", turn_returns(version))
    if version == "v4":
        local = F.when(F.col("present"), F.col("turn_return")).otherwise(0.0)
        if extra is not None:
            local = local + extra
        local = local - F.when(F.col("bad"), VIOLATION).otherwise(0.0) - F.col("cost")
    else:
        rows = rows.repartition(tasks, group) if tasks else rows
        counted = F.col("complete") & F.col("present")
        centre = F.coalesce(F.avg(F.when(counted, F.col("turn_return"))).over(W.partitionBy(group)), F.lit(0.0))
        local = F.when(counted, F.col("turn_return") - centre).otherwise(0.0)
        if version != "v1":
            penalty = F.when(F.col("bad"), VIOLATION).otherwise(0.0)
            penalty = F.greatest(penalty, F.col("cost")) if version == "v3" else penalty
            local = F.when(penalty > 0, F.least(local, F.lit(0.0)) - penalty).otherwise(local)
    rows = rows.withColumn("turn_advantage", F.when(F.col("multiplier") == 0, 0.0).otherwise(local))
    value = F.col("baseline") + coefficient * F.col("turn_advantage")
    if version == "v4":
        value = guarded(value, F.col("bad"), F.col("cost"), floor, regression)
        if labels:
            value = transform_advantage(value, F.col("bad"), F.col("refusal"))
    return rows.withColumn("advantage", F.when(F.col("multiplier") == 0, 0.0).otherwise(value))


def broadcast_tokens(trajectories: DataFrame, advantages: DataFrame, mapping: str = "response_turn_ids", by: str = "trajectory_id") -> DataFrame:
    """Adds token_advantages: each token's turn's advantage, 0 for observation tokens (-1)."""
    by_turn = advantages.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("turn", "advantage"))).alias("__a"))  # a trajectory's turns
    tokens = F.transform(F.col(mapping), lambda t: F.when(t >= 0, F.try_element_at(F.col("__a"), t)).otherwise(0.0))
    return trajectories.join(by_turn, by).withColumn("token_advantages", tokens).drop("__a")


def masked(tokens: Column, zero: Column) -> Column:
    """All zeros where the flag is set."""
    return F.when(zero, F.transform(tokens, lambda _: F.lit(0.0))).otherwise(tokens)


def has_signal(advantages: DataFrame, group: str = "group") -> DataFrame:
    """Per group: whether any turn that owns tokens has an advantage beyond the tolerance."""
    return advantages.where("present").groupBy(group).agg(F.bool_or(F.abs("advantage") > SIGNAL_TOLERANCE).alias("has_signal"))


def token_statistics(advantages: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens, and tokens whose advantage is beyond the tolerance."""
    return advantages.agg(F.sum(tokens).cast("long").alias("n_tokens"), F.sum(F.when(F.abs("advantage") > SIGNAL_TOLERANCE, F.col(tokens)).otherwise(0)).cast("long").alias("nonzero_tokens"))


def turn_consistent(tokens: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """Collapse of token rows (turn, advantage) to turns; ``agree`` says whether a turn's tokens have one value."""
    return tokens.where("turn >= 0").groupBy(by, "turn").agg(F.min("advantage").alias("advantage"), (F.min("advantage") == F.max("advantage")).alias("agree"))
