"""A group barrier whose state ends: groups leave when they are whole or when their time is up, and what is remembered of them leaves too."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollmill.streaming.barrier import BUCKETS

OUT = "uid string, members int, failed int, reward_sum double, expired boolean"
#: A bucket: its timer; of each group the name, first and last time, end, whether it is out and how many sessions settled; and those sessions, group after group.
STATE = "armed long, uids array<string>, firsts array<long>, lasts array<long>, timers array<long>, closed array<boolean>, counts array<int>, sessions array<int>, ats array<long>, faileds array<boolean>, rewards array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and map state need this provider; it keeps state on disk, so groups need not fit in memory."""
    spark.conf.set(_SETTING, PROVIDER)


@dataclass
class Group:
    """An open group with its settled sessions, or the mark of one that is out; ``timer`` is when it ends."""

    first: int
    last: int
    timer: int
    closed: bool = False
    sessions: dict[int, tuple[int, bool, float]] = field(default_factory=dict)


class GroupBarrier(StatefulProcessor):
    """State of a bucket of groups: of each, its settled sessions, at most as many as its size, or a mark that it is out; and one timer, that of the group which ends first.

    The end of an open group ends its wait. That of a group that is out removes the mark: it stands
    as far in the future as rows of the group can lie, so what is delivered again later is late and
    dropped before it gets here. Calls to the state are one read and one write for each bucket that
    has rows or an end, whatever the number of groups.
    """

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def _load(self) -> tuple[dict[str | None, Group], int | None]:
        held = self.state.get()  # null where there is none
        if held is None:
            return {}, None
        armed, uids, firsts, lasts, timers, closed, counts, *sessions = held
        groups, told = {}, iter(zip(*sessions, strict=True))
        for uid, first, last, timer, out, n in zip(uids, firsts, lasts, timers, closed, counts, strict=True):
            groups[uid] = Group(first, last, timer, out, {session: (at, failed, reward) for session, at, failed, reward in islice(told, n)})
        return groups, armed

    def _store(self, groups: dict[str | None, Group], armed: int | None) -> None:
        """Keeps the groups and sets the bucket's timer, if it isn't the one that is ``armed``."""
        due = min((g.timer for g in groups.values()), default=None)
        if armed is not None and armed != due:
            self.handle.deleteTimer(armed)
        if due is None:
            self.state.clear()
            return
        if armed != due:
            self.handle.registerTimer(due)
        each = list(groups.values())
        told = [(session, *v) for g in each for session, v in g.sessions.items()]
        self.state.update((due, list(groups), [g.first for g in each], [g.last for g in each], [g.timer for g in each], [g.closed for g in each], [len(g.sessions) for g in each], *([t[i] for t in told] for i in range(4))))

    def _close(self, uid: str | None, group: Group, keep_until: int, expired: bool) -> Row:
        good = [reward for _, failed, reward in group.sessions.values() if not failed]
        n = len(group.sessions)
        group.sessions, group.timer, group.closed = {}, keep_until, True
        # an exact sum, whatever order the sessions came in
        return Row(uid=uid, members=len(good), failed=n - len(good), reward_sum=math.fsum(good), expired=expired)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        groups, armed = self._load()
        touched = {}
        for uid, session, status, reward, at in ((r["uid"], r["session"], r["status"], r["reward"], r["at_ms"]) for r in rows):
            group = groups.get(uid)
            if group is None:
                group = groups[uid] = Group(at, at, at + self.wait)
            touched[uid] = group
            group.first, group.last = min(group.first, at), max(group.last, at)
            if group.closed or status not in ("finished", "failed"):
                continue
            # the earliest word on a session holds, a failure before a success of the same time
            known, told = group.sessions.get(session), (at, status == "failed", float(reward or 0.0))
            if known is None or (told[0], not told[1]) < (known[0], not known[1]):
                group.sessions[session] = told
        left = []
        for uid, group in touched.items():
            if group.closed:
                group.timer = max(group.timer, group.last + self.wait)
            elif len(group.sessions) >= self.size:
                left.append(self._close(uid, group, group.last + self.wait, False))
            else:
                group.timer = group.first + self.wait
        self._store(groups, armed)
        yield from left

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        groups, _ = self._load()
        now, left = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
        for uid, group in list(groups.items()):
            if group.timer <= now and not group.closed:
                left.append(self._close(uid, group, max(group.timer, group.last) + self.wait, True))
            if group.timer <= now:
                del groups[uid]
        self._store(groups, None)  # the timer that called is gone
        yield from left

    def close(self) -> None:
        pass


def expiring_barrier(stream: DataFrame, size: int, wait: str = "1 hour", late: str = "10 minutes", time: str = "at", buckets: int = BUCKETS) -> DataFrame:
    """Emits a group (uid) once ``size`` sessions have settled, or, marked ``expired``, once ``wait`` has passed since its first row.

    stream: uid, session, status (finished or failed; others leave a session open), reward, and a
    time. Failed sessions leave the membership; the earliest word on a session holds. Rows behind the
    watermark (``late``) are dropped; rows of a group that is out change nothing. State is bounded by
    the groups of the last ``wait`` and ``late``, kept by ``buckets`` of their hashes: see ``GroupBarrier``.
    """
    from pyspark.sql import functions as F

    use_rocksdb(stream.sparkSession)
    wait_ms = stream.sparkSession.sql(f"SELECT CAST(INTERVAL '{wait}' AS INTERVAL DAY TO SECOND) AS w").first()["w"].total_seconds() * 1000
    rows = stream.select(F.col("uid").cast("string").alias("uid"), F.col("session").cast("int").alias("session"), "status", F.col("reward").cast("double").alias("reward"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets))).groupBy("bucket").transformWithState(GroupBarrier(size, int(wait_ms)), OUT, "append", "eventTime")
