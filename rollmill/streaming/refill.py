"""Capped refill: groups are asked for, settle in a stream, and are used a whole batch at a time.

A step wants ``target`` usable groups. Its first wave asks for ``wave_groups``; once every group asked
for has settled, the step is done if enough are usable, and else the next wave asks for what is
missing, up to ``waves``. At the cap what is there is used, if the rules say so, or the step is given
up. What is left over is thrown away, as the next step has another policy.

State lives in a folder, a version for each micro-batch: ``groups`` (settled groups of the open
step), ``requests`` (groups asked for), ``batches`` (groups handed on) and ``commits``, one small file
for each micro-batch, written last and only if it is not there. A micro-batch that is run again,
after a failure at any place, finds its commit and does nothing, or writes its version over; only
committed versions are read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rollmill.sources import commits

GROUP = "uid string, policy_version long, status string, mixed boolean, arrived long"
KEPT = "uid string, policy_version long, usable boolean, reason string, arrived long"
REQUEST = "uid string, policy_version long, wave int"
BATCH = "uid string, policy_version long, arrived long"


@dataclass(frozen=True)
class Rules:
    target: int
    wave_groups: int
    waves: int = 3
    use_remainder: bool = False

    def __post_init__(self):
        if min(self.target, self.wave_groups, self.waves) < 1:
            raise ValueError("sizes of bounded sampling must be positive")


@dataclass
class Step:
    """Where a run stands: the step and its policy, waves and groups asked for, and what became of groups so far."""

    step: int = 0
    wave: int = 1
    asked: int = 0
    version: int = -1  # of the groups table
    done: bool = False
    totals: dict[str, int] = field(default_factory=dict)

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self.totals[name] = self.totals.get(name, 0) + n


class Refill:
    """The tables of one run. Micro-batches come with their number, as ``foreachBatch`` gives them, from 0 on."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules, steps: int):
        self.spark, self.folder, self.rules, self.steps = spark, folder.rstrip("/"), rules, steps

    def _commit(self, epoch: int, state: Step) -> None:
        """Fails if another run has committed this micro-batch."""
        if not commits.put_if_absent(self.spark, f"{self.folder}/commits/{epoch}", json.dumps(asdict(state))):
            raise RuntimeError(f"micro-batch {epoch} already exists")

    def committed(self, epoch: int) -> Step | None:
        text = commits.text_of(self.spark, f"{self.folder}/commits/{epoch}")
        return None if text is None else Step(**json.loads(text))

    def last(self) -> tuple[int, Step] | None:
        """The last committed micro-batch, -1 being the start."""
        done = [int(x) for x in commits.names(self.spark, f"{self.folder}/commits")]
        return (max(done), self.committed(max(done))) if done else None

    def read(self, kind: str) -> DataFrame:
        """All committed versions of ``requests`` or ``batches``."""
        schema = {"requests": REQUEST, "batches": BATCH}[kind]
        last = self.last()
        paths = [f"{self.folder}/{kind}/{e}" for e in commits.names(self.spark, f"{self.folder}/{kind}") if int(e) <= last[0]] if last else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{epoch}")

    def _ask(self, epoch: int, state: Step, n: int) -> None:
        uid = F.concat(F.lit(f"{state.step}-"), (F.col("id") + state.asked).cast("string"))
        self._write(self.spark.range(n).select(uid.alias("uid"), F.lit(state.step).cast("long").alias("policy_version"), F.lit(state.wave).alias("wave")), "requests", epoch)
        state.asked += n
        state.add(asked=n)

    def start(self) -> None:
        """Asks for the first wave, before any micro-batch; a run that goes on has done so."""
        if self.committed(-1) is None:
            state = Step(done=self.steps < 1)
            if not state.done:
                self._ask(-1, state, self.rules.wave_groups)
            self._commit(-1, state)

    def fold(self, rows: DataFrame, epoch: int) -> None:
        """One micro-batch of settled groups (uid, policy_version, status, mixed, arrived)."""
        if self.committed(epoch) is not None:
            return
        state = self.committed(epoch - 1)
        if state is None:
            raise RuntimeError(f"micro-batch {epoch} comes before {epoch - 1} is committed")
        if state.done:
            self._commit(epoch, state)
            return
        none = self.spark.createDataFrame([], KEPT)
        before = self.spark.read.schema(KEPT).parquet(f"{self.folder}/groups/{state.version}") if state.version >= 0 else none
        # only groups that this step asked for count, once, by their first word
        number = F.regexp_extract("uid", f"^{state.step}-([0-9]+)$", 1).try_cast("long")
        fresh = rows.where((number >= 0) & (number < state.asked)).groupBy("uid").agg(F.min_by(F.struct("policy_version", "status", "mixed", "arrived"), F.struct("arrived", "status")).alias("g")).select("uid", "g.*")
        why = F.when(F.col("status") != "finished", "failed").when(F.col("policy_version") != state.step, "stale").when(~F.coalesce("mixed", F.lit(False)), "uniform")
        fresh = fresh.join(before.select("uid"), "uid", "left_anti").select("uid", "policy_version", why.isNull().alias("usable"), why.alias("reason"), "arrived")
        self._write(before.unionByName(fresh), "groups", epoch)
        state.version = epoch
        groups = self.spark.read.schema(KEPT).parquet(f"{self.folder}/groups/{epoch}")
        settled, usable = groups.agg(F.count(F.lit(1)), F.count_if("usable")).first()
        if settled == state.asked:
            self._settle(groups, usable, epoch, state)
        self._commit(epoch, state)

    def _settle(self, groups: DataFrame, usable: int, epoch: int, state: Step) -> None:
        rules, at_cap = self.rules, state.wave >= self.rules.waves
        if usable < rules.target and not at_cap:
            state.wave += 1
            self._ask(epoch, state, min(rules.wave_groups, rules.target - usable))
            return
        taken = min(usable, rules.target) if usable >= rules.target or rules.use_remainder else 0
        reasons = {r["reason"]: r["n"] for r in groups.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        state.add(batches=int(taken > 0), selected=taken, surplus=usable - taken if taken else 0, abandoned=0 if taken else usable, capped=int(at_cap and usable < rules.target), remainder=int(0 < taken < rules.target), **reasons)
        if taken:
            self._write(groups.where("usable").orderBy("arrived", "uid").limit(taken).select("uid", "policy_version", "arrived"), "batches", epoch)  # a bounded top-k
        # the next step has another policy: what is left belongs to none
        state.step, state.wave, state.asked, state.version = state.step + 1, 1, 0, -1
        state.done = state.step >= self.steps
        if not state.done:
            self._ask(epoch, state, rules.wave_groups)

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The stream's query; start it again with the same folders after a failure, and it goes on where it stopped."""
        self.start()
        return stream.select(*(f.split()[0] for f in GROUP.split(", "))).writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
