"""Streaming: group barriers, failure latches, step clocks and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Into how many buckets a barrier deals its groups.
BUCKETS = 16_384
SETTLED = "uid string, members int, failed int, reward_sum double"


def group_barrier(stream: DataFrame, size: int | str, buckets: int = BUCKETS) -> DataFrame:
    """Emits a group (uid) once all its sessions have settled; failed ones leave the membership and never return.

    stream: uid, session, status (finished or failed; others leave a session open), reward. Works
    on a batch frame too. ``size`` is that of every group, or the column that has each group's own.
    State is the set of settled sessions, at most as many as the group's size, and a mark once the group is out, so repeated deliveries change nothing.
    Groups are kept by ``buckets`` of their hashes, as calls and state for each one group cost more
    than the groups; a micro-batch reads and writes the buckets that it has rows of.
    """

    def settle(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uids, dones, faileds, totals, out = state.get if state.exists else ([], [], [], [], [])
        groups = {u: (set(d), set(f), t) for u, d, f, t in zip(uids, dones, faileds, totals, strict=True)}
        out, wanted = dict.fromkeys(out), {}
        for pdf in batches:
            sizes = pdf[size].tolist() if isinstance(size, str) else [size] * len(pdf)
            for uid, session, status, reward, n in zip(pdf["uid"].tolist(), pdf["session"].tolist(), pdf["status"].tolist(), pdf["reward"].tolist(), sizes, strict=True):
                if uid in out:
                    continue
                wanted[uid] = n
                done, failed, total = groups.get(uid) or (set(), set(), 0.0)
                if session not in done and session not in failed:
                    if status == "failed":
                        failed.add(session)
                    elif status == "finished":
                        done.add(session)
                        total += float(reward)
                groups[uid] = (done, failed, total)
        ready = [(u, len(groups[u][0]), len(groups[u][1]), groups[u][2]) for u, n in wanted.items() if len(groups[u][0]) + len(groups[u][1]) >= n]
        for uid, *_ in ready:
            del groups[uid]
            out[uid] = None
        kept = [(u, sorted(d), sorted(f), t) for u, (d, f, t) in groups.items()]
        state.update((*([k[i] for k in kept] for i in range(4)), list(out)))
        if ready:
            yield pd.DataFrame(ready, columns=["uid", "members", "failed", "reward_sum"])

    kinds = "uids array<string>, done array<array<int>>, failed array<array<int>>, totals array<double>, out array<string>"
    names = ["uid", "session", "status", "reward", *([size] if isinstance(size, str) else [])]
    rows = stream.select(*names).withColumn("uid", F.col("uid").cast("string")).withColumn("__bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    return rows.groupBy("__bucket").applyInPandasWithState(settle, SETTLED, kinds, "append", GroupStateTimeout.NoTimeout)


def failure_latch(rows: DataFrame, group: str, fatal: Column, order: str) -> DataFrame:
    """The first fatal error of each group."""
    return rows.where(fatal).groupBy(group).agg(F.min_by("error", order).alias("fatal_error"), F.min(order).alias("at"))


def step_clock(steps: DataFrame, by: list[str], order: str, updated: Column) -> DataFrame:
    """Adds attempt, optimizer_step and consecutive_skips (attempts without an update since the last update)."""
    w = W.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    base = steps.withColumn("__u", updated.cast("int")).withColumn("attempt", F.row_number().over(w)).withColumn("optimizer_step", F.sum("__u").over(upto).cast("long"))
    island = W.partitionBy(*by, "optimizer_step").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return base.withColumn("consecutive_skips", F.sum(1 - F.col("__u")).over(island).cast("long")).drop("__u")


def recovery(attempts: DataFrame, budgets: dict[str, int], slot: list[str], order: str = "attempt") -> DataFrame:
    """Adds used (attempts of the cause so far) and replace: whether the cause's budget still allows a replacement."""
    used = F.count(F.lit(1)).over(W.partitionBy(*slot, "cause").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    limit = F.lit(0)
    for cause, n in budgets.items():
        limit = F.when(F.col("cause") == cause, F.lit(n)).otherwise(limit)
    return attempts.withColumn("used", used).withColumn("replace", F.coalesce(F.col("cause").isNotNull() & (F.col("used") <= limit), F.lit(False)))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
