"""What saved leases tell of a shared budget: levels, peaks, time at the peak, gaps without progress, and waits that should have failed.

A lease holds one place of a pool from ``start`` to ``end`` (null: never given back). Where times
are equal, places are given back before others are taken, and a lease of no length takes its place
between the two. Levels are a running sum over a pool's whole history, so pools are few and hot by
nature; see ``scans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.operators.scans import running

KINDS = ("initial", "infrastructure", "user", "truncation")


def lease_events(leases: DataFrame, pool: str = "pool", lease: str = "lease", start: str = "start", end: str = "end") -> DataFrame:
    """pool, at, turn (order among equal times), lease, change: two rows for each lease, one if it was never given back."""
    no_length = F.col(end) == F.col(start)
    took = F.struct(F.col(start).alias("at"), F.when(no_length, 1).otherwise(2).alias("turn"), F.lit(1).alias("change"))
    gave = F.struct(F.col(end).alias("at"), F.when(no_length, 1).otherwise(0).alias("turn"), F.lit(-1).alias("change"))
    both = F.filter(F.array(took, gave), lambda e: e["at"].isNotNull())
    return leases.select(F.col(pool).alias("pool"), F.col(lease).alias("lease"), F.inline(both)).withColumn("step", -F.col("change"))


def levels(leases: DataFrame, heartbeats: DataFrame | None = None, **columns: str) -> DataFrame:
    """Every event of every pool with the level after it and the time of the next event; heartbeats (pool, lease, at) change no level."""
    events = lease_events(leases, **columns)
    if heartbeats is not None:
        events = events.unionByName(heartbeats.select("pool", "lease", "at", F.lit(1).alias("turn"), F.lit(0).alias("change"), F.lit(0).alias("step")))
    return running(events, ["pool"], ["at", "turn", "lease", "step"], {"level": F.col("change").cast("long")}, {"next_at": F.col("at")}).drop("step")


def peaks(leases: DataFrame, stall: int | None = None, heartbeats: DataFrame | None = None, **columns: str) -> DataFrame:
    """Per pool: leases, peak, peak_at (when first reached), time_at_peak, open_leases, longest_gap and n_stalls.

    A gap is the time between events while a place is held; it is a stall from ``stall`` on. Times are numbers.
    """
    at = levels(leases, heartbeats, **columns)
    lasts = F.coalesce(F.col("next_at") - F.col("at"), F.lit(0))
    # the time at each level first, then the highest level: both are sums that combine before the exchange
    by_level = at.groupBy("pool", "level").agg(
        F.count_if(F.col("change") > 0).alias("took"),
        F.count_if(F.col("change") < 0).alias("gave"),
        F.min(F.when(F.col("change") > 0, F.col("at"))).alias("reached"),
        F.sum(lasts).alias("time"),
        F.max(F.when(F.col("level") > 0, lasts)).alias("gap"),
        (F.count_if((F.col("level") > 0) & (lasts >= stall)) if stall is not None else F.lit(0).cast("long")).alias("stalls"),
    )
    top = F.max_by(F.struct("level", "reached", "time"), "level")
    out = by_level.groupBy("pool").agg(F.sum("took").alias("n_leases"), (F.sum("took") - F.sum("gave")).alias("open_leases"), top.alias("top"), F.max("gap").alias("longest_gap"), F.sum("stalls").alias("n_stalls"))
    return out.select("pool", "n_leases", "open_leases", F.col("top.level").alias("peak"), F.col("top.reached").alias("peak_at"), F.col("top.time").alias("time_at_peak"), F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"), "n_stalls")


def faults(leases: DataFrame, limits: Column, **columns: str) -> DataFrame:
    """Events after which a pool holds more than its limit (``limits``: a column of pool), which a sound budget never lets happen."""
    return levels(leases, **columns).where((F.col("change") > 0) & (F.col("level") > limits))


def overlapping_leases(leases: DataFrame, pool: str = "pool", lease: str = "lease", start: str = "start", end: str = "end") -> DataFrame:
    """Leases of a name that was still held when it was taken again: pool, lease, at."""
    at = running(leases.select(F.col(pool).alias("pool"), F.col(lease).alias("lease"), F.col(start).alias("at"), F.col(end).alias("until")), ["pool", "lease"], ["at", "until"], {"n": F.lit(1).cast("long")}, {"again": F.col("at")})
    return at.where(F.col("again").isNotNull() & (F.col("until").isNull() | (F.col("again") < F.col("until")))).select("pool", "lease", F.col("again").alias("at"))


def attempt_counts(attempts: DataFrame, partition: str = "partition", kind: str = "kind") -> DataFrame:
    """Attempts by kind, failed ones included: a column for each kind; an unknown kind is an error."""
    known = F.when(F.col(kind).isin(*KINDS), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown rollout attempt kind: "), F.coalesce(kind, F.lit("none")))))
    return attempts.select(partition, known.alias("__kind")).groupBy(partition).agg(*(F.count_if(F.col("__kind") == k).alias(k) for k in KINDS))


def queue_failures(waits: DataFrame, progress: DataFrame, stall: int, timeout: int | None = None) -> DataFrame:
    """Waits that should have failed: pool, waiter, start, reason (deadline_exceeded or stalled) and when.

    waits: pool, waiter, start, end (when its place came, null: never). progress: pool, at, when the
    pool's state moved. A wait fails at its deadline, or when nothing has moved for ``stall`` since
    it began or since the last move in it, whichever comes first, the deadline where they tie; not
    if its place came by then. Each wait finds the next move, and the next gap of ``stall`` or more, by
    its number: how many there are up to the wait's start is a running count.
    """
    moves = running(progress.select("pool", "at").distinct(), ["pool"], ["at"], {"n": F.lit(1).cast("long")}, {"next_at": F.col("at")})
    moves = moves.withColumn("wide", F.col("next_at").isNull() | (F.col("next_at") - F.col("at") >= stall))
    asks = waits.select("pool", F.col("start").alias("at"), F.lit(1).alias("side"), "waiter", "end", F.lit(0).alias("move"), F.lit(0).alias("gap"))
    marks = moves.select("pool", "at", F.lit(0).alias("side"), F.lit(None).cast(asks.schema["waiter"].dataType).alias("waiter"), F.lit(None).cast("long").alias("end"), F.lit(1).alias("move"), F.col("wide").cast("int").alias("gap"))
    line = running(asks.unionByName(marks), ["pool"], ["at", "side", "waiter"], {"n_moves": F.col("move").cast("long"), "n_gaps": F.col("gap").cast("long")}).where("side = 1")
    # the scan hands the moves back numbered; gaps are numbered among themselves
    gaps = running(moves.where("wide"), ["pool"], ["at"], {"k": F.lit(1).cast("long")}).select(F.col("pool").alias("p"), "k", F.col("at").alias("low"))
    nexts = moves.select(F.col("pool").alias("p"), "n", F.col("at").alias("moved"))
    found = line.join(nexts, F.col("pool").eqNullSafe(F.col("p")) & (F.col("n_moves") + 1 == F.col("n")), "left").drop("p", "n")
    found = found.join(gaps, F.col("pool").eqNullSafe(F.col("p")) & (F.col("n_gaps") + 1 == F.col("k")), "left").drop("p", "k")
    at_once = F.col("moved").isNull() | (F.col("moved") - F.col("at") >= stall)
    stalled = F.when(at_once, F.col("at") + stall).otherwise(F.col("low") + stall)
    deadline = F.col("at") + F.lit(timeout) if timeout is not None else F.lit(None).cast("long")
    failed = F.least(deadline, stalled)  # nulls are left out
    out = found.withColumn("failed_at", failed).where(F.col("failed_at").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("failed_at"))))
    return out.select("pool", "waiter", F.col("at").alias("start"), F.when(F.col("failed_at").eqNullSafe(deadline), "deadline_exceeded").otherwise("stalled").alias("reason"), "failed_at")
