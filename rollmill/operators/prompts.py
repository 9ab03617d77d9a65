"""Initial prompts: whether each fits its limits, and the report over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.operators.profiling import nearest_rank

#: Tokens kept free for the answer to begin, and names of violations (fixed values).
RESERVE = 1
OVER_LIMIT, OVER_CONTEXT = "initial_prompt_limit_exceeded", "total_context_reserve_exceeded"


def violations(tokens: Column, limit: int, context: int) -> Column:
    if limit < 1:
        raise ValueError("the limit of a prompt must be positive")
    return F.array_compact(F.array(F.when(tokens > limit, F.lit(OVER_LIMIT)), F.when(tokens + RESERVE > context, F.lit(OVER_CONTEXT))))


def inspected(rows: DataFrame, limit: int, context: int, tokens: str = "initial_prompt_tokens") -> DataFrame:
    """Adds the limits, the prompt with its reserve, violations and status (ok, rejected, or failed where nothing was measured)."""
    n = F.col(tokens)
    return rows.select(
        "*",
        F.lit(limit).alias("initial_prompt_limit"),
        F.lit(RESERVE).alias("reserved_tokens"),
        (n + RESERVE).alias("prompt_plus_reserve_tokens"),
        F.lit(context).alias("max_context_tokens"),
        violations(n, limit, context).alias("violations"),
        F.when(n.isNull(), "failed").when(F.size(violations(n, limit, context)) > 0, "rejected").otherwise("ok").alias("status"),
    )


def report(rows: DataFrame, expected: DataFrame, task: str = "task_id", tokens: str = "initial_prompt_tokens") -> DataFrame:
    """One row over inspected prompts: measured samples, nearest-rank quantiles, tasks never measured, and whether all asked for passed."""
    measured = rows.where(F.col(tokens).isNotNull())
    missing = expected.select(task).distinct().join(measured.select(task), task, "left_anti").agg(F.count(F.lit(1)).alias("missing_tasks"))
    failed = rows.agg(F.count_if(~F.col("status").eqNullSafe(F.lit("ok"))).alias("failed_samples"), F.countDistinct(task).alias("tasks"))
    whole = nearest_rank(measured, tokens).crossJoin(missing).crossJoin(failed)  # one row each
    return whole.withColumn("all_requested_samples_passed", (F.col("n") > 0) & (F.col("failed_samples") == 0) & (F.col("missing_tasks") == 0)).withColumnRenamed("n", "measured_samples")


def samples_per_task(rows: DataFrame, task: str = "task_id") -> DataFrame:
    return rows.groupBy(task).agg(F.count(F.lit(1)).alias("samples"))
