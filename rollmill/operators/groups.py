"""Sampling groups: advantages, complete groups, mixed-reward filters, slots, refills and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions.scalars import MIXED_EPSILON, STD_EPSILON


def group_advantages(rows: DataFrame, group: str = "task_id", reward: str = "reward", epsilon: float = STD_EPSILON) -> DataFrame:
    """Adds advantage: (r - mean) / (population std + epsilon) of the group."""
    w = W.partitionBy(group)
    return rows.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + F.lit(epsilon)))


def mixed_groups(rows: DataFrame, group: str = "task_id", reward: str = "reward") -> DataFrame:
    """Groups whose rewards differ by more than the tolerance."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(reward).alias("min_reward"), F.max(reward).alias("max_reward"))
    return out.where(F.col("max_reward") - F.col("min_reward") > MIXED_EPSILON)


def select_valid_groups(rows: DataFrame, size: int, target: int, group: str = "task_id", arrival: str = "trajectory_id", reward: str = "reward") -> DataFrame:
    """The first ``size`` rows of a group in order of arrival form it; complete, mixed groups count; the first ``target`` of them by the task's first arrival, or none if there are fewer."""
    w = W.partitionBy(group)
    placed = rows.withColumn("__rn", F.row_number().over(w.orderBy(arrival))).withColumn("__first", F.min(arrival).over(w)).where(F.col("__rn") <= size)
    whole = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("__first").alias("first_arrival"), (F.max(reward) - F.min(reward)).alias("spread"))
    good = whole.where((F.col("n") == size) & (F.col("spread") > MIXED_EPSILON))
    best = good.orderBy("first_arrival", group).limit(target)  # a bounded top-k
    chosen = best.where(best.agg(F.count(F.lit(1))).scalar() == target).select(group, "first_arrival")
    return placed.join(chosen, group).drop("__first").withColumnRenamed("__rn", "place")


def chunked_groups(rows: DataFrame, size: int, group: str = "task_id", order: str = "trajectory_id") -> DataFrame:
    """Consecutive runs of ``size`` rows within a task; the rest is left out. Adds chunk."""
    w = W.partitionBy(group)
    place = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(place / size)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(group, "chunk"))).where(F.col("__n") == size).drop("__n")


def group_rates(chunks: DataFrame, group: str = "task_id", reward: str = "reward") -> DataFrame:
    """Shares of groups with equal, all-zero, all-one and mixed rewards."""
    per = chunks.groupBy(group, "chunk").agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    rate = lambda c: F.avg(c.cast("double"))
    lo, hi = F.col("lo"), F.col("hi")
    return per.agg(F.count(F.lit(1)).alias("groups"), rate(hi - lo <= MIXED_EPSILON).alias("same_rate"), rate(hi == 0).alias("zero_rate"), rate(lo == 1).alias("one_rate"), rate(hi - lo > MIXED_EPSILON).alias("mixed_rate"))


def slots_complete(rows: DataFrame, size: int, group: str, session: str, failed: DataFrame | None = None) -> DataFrame:
    """Groups whose sessions are 0 .. size-1 without the failed ones (group, session). Adds complete."""
    if failed is not None:
        rows = rows.select(group, session).unionByName(failed.select(group, session))
    have = rows.groupBy(group).agg(F.sort_array(F.collect_list(session)).alias("sessions"))  # at most ``size`` a group in sound data
    return have.withColumn("complete", F.col("sessions") == F.sequence(F.lit(0), F.lit(size - 1)).cast("array<int>"))


def sampling_metrics(groups: DataFrame) -> DataFrame:
    """Keep rate and all-zero / all-one groups, from per-group lo, hi and kept."""
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("kept").cast("double")).alias("keep_rate"), F.count_if(F.col("hi") == 0).alias("all_zero"), F.count_if(F.col("lo") == 1).alias("all_one"))


def refill_plan(kept: DataFrame, target: int, waves: int, cap: int, size: int) -> DataFrame:
    """After each wave (wave, kept_groups): the deficit, and how many groups the next wave samples; no wave beyond the limits."""
    w = W.orderBy("wave").rowsBetween(W.unboundedPreceding, 0)  # at most ``waves`` rows
    total = F.sum("kept_groups").over(w)
    deficit = F.greatest(F.lit(target) - total, F.lit(0))
    room = F.floor(F.lit(cap) / size) - F.lit(target) - F.coalesce(F.sum("sampled_groups").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if "sampled_groups" in kept.columns else F.lit(cap // size)
    return kept.where(F.col("wave") < waves).withColumn("deficit", deficit).withColumn("next_groups", F.when(F.col("wave") + 1 < waves, F.least(deficit, room)).otherwise(0))


def latest_by_session(rows: DataFrame, group: list[str], index: str = "index") -> DataFrame:
    """The row of the highest index of each session."""
    best = rows.groupBy(*group).agg(F.max_by(F.struct(*rows.columns), index).alias("r"))
    return best.select("r.*")


def single_policy(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Groups that mix values of fields that must be uniform, with the counts of distinct values."""
    out = rows.groupBy(group).agg(*[F.countDistinct(c).alias(c) for c in fields])
    return out.where(" or ".join(f"{c} > 1" for c in fields))
