"""Evaluation: slot coverage, record triage, duplicate detection and pass^k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import scalars
from rollmill.operators.curation import first_reason


def expected_slots(tasks: DataFrame, n: int, task: str = "task_id") -> DataFrame:
    """Every task with every slot 0 .. n-1 (a bounded generation, no join)."""
    return tasks.select(task).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def missing_slots(tasks: DataFrame, records: DataFrame, n: int, task: str = "task_id") -> DataFrame:
    return expected_slots(tasks, n, task).join(records.select(task, "slot"), [task, "slot"], "left_anti")


def triage(foreign: Column, unexpected: Column, duplicate: Column, fatal: Column, rejected: Column, pending: Column, corrupt: Column, scoring_pending: Column, failed: Column) -> Column:
    """The state of an evaluation record: the first that applies, else valid."""
    return F.coalesce(
        first_reason(
            [("error", foreign | unexpected | duplicate | fatal), ("rejected", rejected), ("pending", pending), ("error", corrupt), ("scoring_pending", scoring_pending), ("infrastructure", failed)]
        ),
        F.lit("valid"),
    )


def scoring_pending(official: Column, custom: Column, phase: Column, phases: tuple[str, ...]) -> Column:
    return official.isNotNull() & custom.isNull() & F.coalesce(phase.isin(*phases), F.lit(False))


def task_successes(records: DataFrame, task: str = "task_id", reward: str = "reward", termination: str = "termination") -> DataFrame:
    """n, c (successes that aren't cut off) and raw_c per task."""
    ok = scalars.official_success(F.col(reward))
    cut = scalars.truncated(F.col(termination))
    return records.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok & ~cut).alias("c"), F.count_if(ok).alias("raw_c"))


def pass_hat(records: DataFrame, ks: tuple[int, ...] = (1, 4), task: str = "task_id") -> DataFrame:
    """pass^k per task, for tasks with k records or more (else null)."""
    counts = task_successes(records, task)
    return counts.select(task, "n", "c", "raw_c", *[scalars.pass_hat_k(F.col("n"), F.col("c"), k).alias(f"pass_{k}") for k in ks])


def pass_hat_macro(records: DataFrame, ks: tuple[int, ...] = (1, 4), task: str = "task_id") -> DataFrame:
    """The unweighted mean of pass^k over the tasks that have it."""
    return pass_hat(records, ks, task).agg(F.count(F.lit(1)).alias("tasks"), *[F.avg(f"pass_{k}").alias(f"pass_{k}") for k in ks])


def coverage_complete(tasks: DataFrame, records: DataFrame, n: int, task: str = "task_id") -> bool:
    return not missing_slots(tasks, records, n, task).take(1)


def report(records: DataFrame, tasks: DataFrame, n: int, ks: tuple[int, ...] = (1, 4)) -> DataFrame:
    """Macro metrics of a complete evaluation; no row while slots are missing."""
    gap = missing_slots(tasks, records, n).limit(1).agg(F.count(F.lit(1)).alias("gaps"))
    return pass_hat_macro(records, ks).where(gap.scalar() == 0)


def repaired_reward(db: Column, communicate: Column, normal_stop: Column) -> Column:
    return F.when(normal_stop, db * communicate).otherwise(0.0)
