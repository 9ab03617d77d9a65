"""State machines over a trajectory's events: subgoal credit, and one-shot confirmations.

Each event is a step that keeps a goal's state, or sets it whatever it was, so what holds after an
event is the last thing that was set: a running last value, which ranges of events find for
themselves and hand on (see ``scans``). A trajectory that holds a third of all events is split.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.operators.scans import running

BUDGET = 0.5


def trace(goals: int, initial: list[bool], turns: int, writes: list[dict[str, Any]], violating: set[int]) -> dict[str, Any]:
    """Awards and charges of ``goals`` subgoals over one trajectory's writes in order; ``subgoal_turns`` has the same for tables.

    A write: turn (1-based), matches (goals whose inputs it meets), names (goals of its tool),
    state (the goals' truth after it; None: unknown), effect (False: proved no change), outside
    (does not touch the target). Each goal is awarded once, in the turn it first comes true
    without a wrong or unknown write or a violation in that turn (a withheld award is never paid
    later), and charged once, when it is lost.
    """
    weight = BUDGET / goals if goals else 0.0
    current, proven = list(initial), list(initial)
    awarded: set[int] = set()
    charged: set[int] = set()
    out: dict[str, Any] = {"credits": [], "positive": [], "negative": [], "phi": [sum(current) / goals if goals else 0.0], "wrong": [], "deferred": [], "regressions": [], "unknown": []}
    for turn in range(1, turns + 1):
        came, lost, blocked = set(), set(), False
        for w in (w for w in writes if w["turn"] == turn):
            blocked |= not w["matches"]
            if w["effect"] is False or w["outside"]:
                continue
            before = list(current)
            if w["state"] is None:
                blocked, current = True, [False] * goals
                out["unknown"].append(turn - 1)
                for i in w["names"]:
                    proven[i] = False
                continue
            for i in range(goals):
                if i in w["names"]:
                    proven[i] = i in w["matches"]
                current[i] = proven[i] and w["state"][i]
                if before[i] and not current[i]:
                    blocked = True
                    lost.add(i)
                if not before[i] and current[i] and i in w["matches"]:
                    came.add(i)
            blocked |= any(not current[i] for i in w["matches"])
        won = {i for i in came if current[i] and not initial[i] and i not in awarded}
        if blocked:
            out["wrong"].append(turn - 1)
        if won and (blocked or turn - 1 in violating):
            out["deferred"].append(turn - 1)
            won = set()
        if lost:
            out["regressions"].append(turn - 1)
        fresh = lost - charged
        awarded |= won
        charged |= fresh
        out["positive"].append(sorted(won))
        out["negative"].append(sorted(fresh))
        out["credits"].append(weight * (len(won) - len(fresh)))
        out["phi"].append(sum(current) / goals if goals else 0.0)
    return out


def eligible(basis: set[str], transfer: bool, user_tools: bool, dependencies: bool, updates: set[str]) -> bool:
    """Whether a task's subgoals count: a DB basis, no transfer, user tools or dependencies, two update tools or more."""
    return "DB" in basis and not transfer and not user_tools and not dependencies and len(updates) >= 2


WRITES = "turn_id int, sequence long, matches array<int>, names array<int>, state array<boolean>, effect boolean, outside boolean"


def subgoal_turns(writes: DataFrame, trajectories: DataFrame, goals: int, by: str = "trajectory_id") -> DataFrame:
    """Per turn: turn (from 0), credit, phi, positive and negative (goals), wrong, deferred, regression and unknown.

    writes: by, turn_id (from 1), sequence (the order of a trajectory's writes), matches, names,
    state, effect and outside, as ``trace`` has them. trajectories: by, turns, initial
    array<boolean>, violating array<int> (turns from 0). Null matches and names are none; a null
    effect is not a proof that nothing changed. Turns without writes are rows, too.
    """
    each = range(goals)
    has = lambda c, i: F.coalesce(F.array_contains(c, i), F.lit(False))
    every = writes.join(trajectories.select(by, "initial"), by)
    effective = ~F.col("effect").eqNullSafe(F.lit(False)) & ~F.coalesce("outside", F.lit(False))
    known = F.col("state").isNotNull()
    shown = every.where(effective).select(by, "turn_id", "sequence", "matches", "names", "state", "initial")
    proven = running(shown, [by], ["turn_id", "sequence"], last={f"p{i}": F.when(has("names", i), known & has("matches", i)) for i in each})
    after = proven.withColumns({f"c{i}": known & F.coalesce(f"p{i}", F.col("initial")[i]) & F.coalesce(F.col("state")[i], F.lit(False)) for i in each})
    moved = running(after, [by], ["turn_id", "sequence"], previous={f"q{i}": F.col(f"c{i}") for i in each})
    before = [F.coalesce(f"q{i}", F.col("initial")[i]) for i in each]
    any_of = lambda columns: F.greatest(F.lit(False), *columns, F.lit(False))
    lost = [known & before[i] & ~F.col(f"c{i}") for i in each]
    came = [known & ~before[i] & F.col(f"c{i}") & has("matches", i) for i in each]
    failed = [has("matches", i) & ~F.col(f"c{i}") for i in each]
    order = F.struct("sequence")
    seen = moved.groupBy(by, "turn_id").agg(
        *(F.bool_or(came[i]).alias(f"came{i}") for i in each), *(F.bool_or(lost[i]).alias(f"lost{i}") for i in each), *(F.max_by(f"c{i}", order).alias(f"end{i}") for i in each),
        F.bool_or(~known).alias("unknown"), F.bool_or(~known | any_of(lost) | any_of(failed)).alias("blocked"),
    )
    outside = every.groupBy(by, "turn_id").agg(F.bool_or(F.coalesce(F.size("matches"), F.lit(0)) <= 0).alias("unmatched"))
    turns = trajectories.where("turns > 0").select(by, "initial", "violating", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("turn_id"))
    rows = turns.join(seen, [by, "turn_id"], "left").join(outside, [by, "turn_id"], "left")
    rows = running(rows, [by], ["turn_id"], last={f"now{i}": F.col(f"end{i}") for i in each})
    no = lambda c: F.coalesce(c, F.lit(False))
    wrong = no(F.col("blocked")) | no(F.col("unmatched"))
    held = wrong | no(F.array_contains("violating", F.col("turn_id") - 1))
    eligible = [no(F.col(f"came{i}") & F.col(f"end{i}") & ~F.col("initial")[i]) for i in each]
    rows = rows.withColumns({"wrong": wrong, "held": held} | {f"may{i}": eligible[i] for i in each} | {f"gone{i}": no(F.col(f"lost{i}")) for i in each})
    firsts = rows.groupBy(by).agg(*(F.min(F.when(F.col(f"may{i}") & ~F.col("held"), F.col("turn_id"))).alias(f"won{i}") for i in each), *(F.min(F.when(F.col(f"gone{i}"), F.col("turn_id"))).alias(f"fell{i}") for i in each))
    rows = rows.join(firsts, by)
    at = F.col("turn_id")
    which = lambda name: F.filter(F.array(*(F.when(F.col(f"{name}{i}") == at, F.lit(i)) for i in each)), lambda x: x.isNotNull())
    positive, negative = which("won"), which("fell")
    late = [F.col(f"may{i}") & (F.col(f"won{i}").isNull() | (F.col(f"won{i}") > at)) for i in each]
    phi = sum((F.coalesce(f"now{i}", F.col("initial")[i]).cast("int") for i in each), F.lit(0)) / F.lit(goals)
    return rows.select(
        by, (at - 1).alias("turn"), (F.lit(BUDGET / goals) * (F.size(positive) - F.size(negative))).alias("credit"), phi.alias("phi"), positive.alias("positive"), negative.alias("negative"), "wrong",
        (F.col("held") & any_of(late)).alias("deferred"), any_of([F.col(f"gone{i}") for i in each]).alias("regression"), no(F.col("unknown")).alias("unknown"),
    )


def subgoal_credit(events: DataFrame, goals: list[Any], by: str = "trajectory_id") -> DataFrame:
    """Credits per turn. events: by, turn_id, sequence, goal (which of ``goals`` a write is about, null: none), ok (it meets the goal), effect, violates."""
    number = F.array_position(F.array(*map(F.lit, goals)), F.col("goal")).cast("int") - 1
    writes = events.where(F.col("goal").isNotNull()).withColumn("g", number)
    # a goal's own last effective write says whether it holds
    writes = running(writes, [by], ["turn_id", "sequence"], last={f"s{i}": F.when(F.col("effect") & (F.col("g") == i), F.col("ok")) for i in range(len(goals))})
    state: Column = F.array(*(F.coalesce(f"s{i}", F.lit(False)) for i in range(len(goals))))
    none = F.array().cast("array<int>")
    shaped = writes.select(by, "turn_id", "sequence", F.when(F.col("ok"), F.array("g")).otherwise(none).alias("matches"), F.array("g").alias("names"), state.alias("state"), "effect", F.lit(False).alias("outside"))
    initial = F.array(*(F.lit(False) for _ in goals))
    trajectories = events.groupBy(by).agg(F.max("turn_id").cast("int").alias("turns"), F.collect_set(F.when(F.col("violates"), F.col("turn_id").cast("int") - 1)).alias("violating"))
    return subgoal_turns(shaped, trajectories.withColumn("initial", initial), len(goals), by).select(by, "turn", "credit", "phi")


def confirmations(messages: DataFrame, by: str = "dialog_id") -> DataFrame:
    """One-shot confirmations: a proposal (kind 'proposal', hash) is confirmed by the next affirmative reply and used up by the first action of its hash.

    Adds confirmed to messages: whether the pending, confirmed proposal has the action's hash. A
    proposal starts anew whatever was before it, so messages fall into stretches that begin with one;
    in a stretch, an action is confirmed by an affirmative reply before it and no other reply.
    """
    kind = F.col("kind")
    yes = F.coalesce("affirmative", F.lit(False))
    stretches = running(messages.select(by, "message_index", "kind", "hash", "affirmative"), [by], ["message_index"], sums={"stretch": (kind == "proposal").cast("long")}, last={"pending": F.when(kind == "proposal", F.struct(F.col("hash").alias("h")))})
    told = running(stretches, [by, "stretch"], ["message_index"], sums={"yes": ((kind == "reply") & yes).cast("long"), "no": ((kind == "reply") & ~yes).cast("long")})
    may = (kind == "action") & (F.col("stretch") > 0) & (F.col("hash") == F.col("pending.h")) & (F.col("yes") > 0) & (F.col("no") == 0)
    first = told.where(may).groupBy(by, "stretch").agg(F.min("message_index").alias("used"))
    out = told.join(first, [by, "stretch"], "left")
    return out.select(by, "message_index", F.coalesce(F.col("message_index") == F.col("used"), F.lit(False)).alias("confirmed"))
