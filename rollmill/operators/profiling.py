"""Profiles of rollouts and prompts, and policy-ratio statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.functions import scalars
from rollmill.sources.shared import checkpointed


def at_ranks(rows: DataFrame, value: str, wanted: Callable[[int], list[int]]) -> tuple[int, dict[int, Any]]:
    """(number of values that are not null, values at ranks from 1 in their order); ``wanted`` names the ranks, given the number.

    Values are counted, dealt out by range, and only the range partitions that hold a rank are
    looked into, so no task ever holds all distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = checkpointed(counted.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = sorted((r["p"], r["n"], r["first"]) for r in dealt.groupBy("p").agg(F.sum("n").alias("n"), F.min("v").alias("first")).collect())  # a row for each partition
    total, before, starts = sum(n for _, n, _ in sizes), 0, {}
    for p, n, _ in sizes:
        starts[p] = (before, before + n)
        before += n
    ranks = sorted(set(wanted(total))) if total else []
    asked = [(p, r, r - low) for r in ranks for p, (low, high) in starts.items() if low < r <= high]
    if not asked:
        return total, {}
    upto = F.sum("n").over(W.partitionBy("p").orderBy("v"))
    some = dealt.where(F.col("p").isin(sorted({p for p, _, _ in asked}))).withColumn("upto", upto)
    picks = [F.min(F.when((F.col("p") == p) & (F.col("upto") >= local), F.col("v"))).alias(f"r{rank}") for p, rank, local in asked]
    found = some.agg(*picks).first()
    return total, {rank: found[f"r{rank}"] for _, rank, _ in asked}


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> dict[float, float | None]:
    """Linearly interpolated quantiles of a column; null for no values."""
    edges = lambda n: [1 + int(f((n - 1) * q)) for q in shares for f in (math.floor, math.ceil)]
    n, found = at_ranks(rows, value, edges)
    out: dict[float, float | None] = {}
    for q in shares:
        if not n:
            out[q] = None
            continue
        place = (n - 1) * q
        low, high = float(found[1 + math.floor(place)]), float(found[1 + math.ceil(place)])
        out[q] = low + (high - low) * (place - math.floor(place))
    return out


def _literals(values: dict[float, Any], names: str, kind: str = "double") -> list[Column]:
    return [F.lit(v).cast(kind).alias(names.format(round(q * 100))) for q, v in values.items()]


def profile(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> list[Column]:
    """The quantiles of a column as columns of one value."""
    return _literals(quantiles(rows, value, shares), "p{}")


def nearest_rank(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Least, greatest and nearest-rank quantiles, values of the column themselves."""
    kind = dict(rows.dtypes)[value]
    rank = lambda n, q: max(1, math.ceil(round(q * n, 9)))
    n, found = at_ranks(rows, value, lambda n: [rank(n, q) for q in shares])
    disc = _literals({q: found[rank(n, q)] if n else None for q in shares}, "p{}", kind)
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("least"), *disc, F.max(value).alias("greatest"))


def profile_rollouts(rows: DataFrame, reward: str = "reward", length: str = "tokens", termination: str = "termination", shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Counts, exact-success and truncation rates, mean reward and length quantiles."""
    rate = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.count(F.lit(1)).alias("rollouts"), rate(scalars.exact_success(F.col(reward))).alias("success_rate"), rate(scalars.truncated(F.col(termination))).alias("truncated_rate"), F.avg(reward).alias("mean_reward"), *profile(rows, length, shares)
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def ratio_statistics(pairs: DataFrame, current: str = "current", old: str = "old", mask: str = "mask") -> DataFrame:
    """Of masked-in tokens: mean, population std and quantiles of exp(current - old), the greatest distance from 1, the mean absolute difference."""
    delta = F.col(current) - F.col(old)
    kept = pairs.where(F.col(mask) == 1).select(delta.alias("d"), F.exp(delta).alias("r"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), *_literals(quantiles(kept, "r", (0.01, 0.5, 0.99)), "p{:02d}"), F.max(F.abs(F.col("r") - 1)).alias("max_off"), F.avg(F.abs("d")).alias("mean_abs_delta"))


def token_pairs(rows: DataFrame, current: str, old: str, mask: Column) -> DataFrame:
    """Tokens of two aligned arrays; ``mask`` may use ``pos``."""
    zipped = F.arrays_zip(F.col(current).alias("current"), F.col(old).alias("old"))
    out = rows.select(*[c for c in rows.columns if c not in (current, old)], F.posexplode(F.transform(zipped, lambda z: F.struct(z["current"].cast("double").alias("c"), z["old"].cast("double").alias("o")))).alias("pos", "z"))
    return out.withColumn("current", F.col("z.c")).withColumn("old", F.col("z.o")).withColumn("mask", mask).drop("z")


def ordered_digest(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """SHA-256 over a group's values in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("string").alias("v"))))
    return rows.groupBy(group).agg(F.sha2(F.concat_ws(",", F.transform(ordered, lambda s: s["v"])), 256).alias("digest"))
