"""Assertions on frames: rules that raise, or flag, as part of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: dict[str, Column], on_error: str = "raise") -> DataFrame:
    """Each rule is a condition that rows must meet (null counts as not met).

    ``raise``: the first row that breaks a rule fails the job, with the rule's name.
    ``flag``: rows get ``violations``, the names of the rules they break.
    """
    broken = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    if on_error == "flag":
        return df.withColumn("violations", F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in broken.items()]), lambda x: x.isNotNull()))
    case = F.lit(None).cast("string")
    for name, b in reversed(broken.items()):
        case = F.when(b, F.lit(name)).otherwise(case)
    # the failing branch is part of the filter, so no column pruning can drop it
    return df.where(F.when(case.isNotNull(), F.raise_error(F.concat(F.lit("rule broken: "), case)).cast("boolean")).otherwise(F.lit(True)))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty(df: DataFrame, what: str) -> None:
    """Raises unless the frame has no row."""
    if row := df.take(1):
        raise ValueError(f"{what}: {row[0].asDict()}")
