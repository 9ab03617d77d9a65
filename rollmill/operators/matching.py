"""Required actions: candidate edges by equi-join, and the largest one-to-one match under declared order."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.scalars import MUTATING_TOOLS


def candidates(actions: DataFrame, events: DataFrame, by: list[str], args: str = "args_key") -> DataFrame:
    """Edges (by.., action_id, event_id, sequence, turn_id): same name and arguments, successful, and effective for mutating tools."""
    usable = events.where(F.col("success") & (~F.col("name").isin(*MUTATING_TOOLS) | F.col("db_effect").eqNullSafe(F.lit(True))))
    keep = usable.select(*by, "name", args, "event_id", "sequence", "turn_id")
    return actions.join(keep, [*[c for c in by if c in actions.columns], "name", args])


def waived(expected: Column, state: Column) -> Column:
    """Whether a baggage update costs nothing, so that how it is paid does not matter: no paid bag, or, with the state before it, no more than the reservation had.

    With a state, numbers are JSON numbers, the state's a whole one: a number in quotes does not count.
    """
    at = lambda doc, path: F.try_variant_get(F.try_parse_json(doc), path, "variant")
    target, prior = (at(x, "$.nonfree_baggages") for x in (expected, state))
    number = lambda v, kinds: F.when(F.schema_of_variant(v).rlike(kinds), v.try_cast("double"))
    wanted, had = number(target, "^(BIGINT|DECIMAL|DOUBLE)"), number(prior, "^(BIGINT|DECIMAL)")
    had = F.when(F.get_json_object(state, "$.nonfree_baggages").rlike("^-?[0-9]+$"), had)  # 2.0 is no whole number here
    same = F.to_json(at(state, "$.reservation_id")).eqNullSafe(F.to_json(at(expected, "$.reservation_id")))
    free = F.get_json_object(expected, "$.nonfree_baggages").try_cast("double") == 0
    return F.coalesce(F.when(state.isNull(), free).otherwise(same & (had >= 0) & wanted.between(F.lit(0.0), had)), F.lit(False))


def waived_candidates(actions: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Edges of free baggage updates, on the arguments without their payment (loose_key), with the waiver as what is left to test."""
    name = "update_reservation_baggages"
    usable = events.where((F.col("name") == name) & F.col("success") & F.col("db_effect").eqNullSafe(F.lit(True)))
    keep = usable.select(*by, "loose_key", "event_id", "sequence", "turn_id", "state_before")
    wanted = actions.where(F.col("name") == name)
    return wanted.join(keep, [*[c for c in by if c in actions.columns], "loose_key"]).where(waived(F.col("arguments"), F.col("state_before")))


Edges = dict[str, list[tuple[int, int]]]
Match = dict[str, tuple[int, int]]


def parts(edges: Edges, order: list[tuple[str, str]]) -> list[list[str]]:
    """Connected components of actions: those that want an event in common, or that an order ties."""
    top = {a: a for a in edges}

    def root(a: str) -> str:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    first: dict[int, str] = {}
    ties = [(first.setdefault(event, a), a) for a in edges for event, _ in edges[a]] + [p for p in order if p[0] in edges and p[1] in edges]
    for a, b in ties:
        top[root(a)] = root(b)
    found: dict[str, list[str]] = {}
    for a in edges:
        found.setdefault(root(a), []).append(a)
    return list(found.values())


class Matching:
    """A largest match of actions and events without order, kept the largest while actions are held to events."""

    def __init__(self, edges: Edges):
        self.edges, self.owner, self.owned, self.held = edges, {}, {}, set()
        # layers of alternating paths first, which finds many short ones at a time
        while self._phase():
            pass

    def _phase(self) -> bool:
        layer = {a: 0 for a in self.edges if a not in self.owned}
        wave, ends = list(layer), False
        while wave and not ends:
            following = []
            for a in wave:
                for event, _ in self.edges[a]:
                    b = self.owner.get(event)
                    if b is None:
                        ends = True
                    elif b not in layer:
                        layer[b] = layer[a] + 1
                        following.append(b)
            wave = following
        return ends and any([self.grow(a, layer) for a in self.edges if a not in self.owned])

    def grow(self, action: str, layer: dict[str, int] | None = None) -> bool:
        """One more action matched, by an alternating path (down the layers, if given) that leaves held actions alone."""
        came: dict[int, str] = {}
        todo = [action]
        while todo:
            here = todo.pop()
            for event, _ in self.edges[here]:
                other = self.owner.get(event)
                if event in came or other in self.held or (layer is not None and other is not None and layer.get(other) != layer[here] + 1):
                    continue
                came[event] = here
                if other is not None:
                    todo.append(other)
                    continue
                at: int | None = event
                while at is not None:  # every event on the way back goes to the action that came for it
                    taker = came[at]
                    self.owner[at], self.owned[taker], at = taker, at, self.owned.get(taker)
                return True
        return False

    def hold(self, action: str, event: int) -> bool:
        """Holds ``action`` to ``event`` if a largest match can."""
        before, other = self.owned.get(action), self.owner.get(event)
        if before != event:
            if other in self.held:
                return False
            if before is not None:
                del self.owner[before]
            self.owner[event], self.owned[action] = action, event
            self.held.add(action)
            if other is not None:
                del self.owned[other]
                if not self.grow(other) and before is not None:
                    self.owner[event], self.owned[other] = other, event
                    self.owner[before], self.owned[action] = action, before
                    self.held.discard(action)
                    return False
        self.held.add(action)
        return True


def _free(edges: Edges) -> Match:
    """The match of a component without order."""
    match, out = Matching(edges), {}
    for action in sorted(edges, key=lambda a: len(edges[a])):
        for event in edges[action]:
            if match.hold(action, event[0]):
                out[action] = event
                break
    return out


def _search(edges: Edges, order: list[tuple[str, str]], size: int = 0, must: set[str] | frozenset = frozenset()) -> Match:
    """A largest match under order, of ``size`` at least and with all of ``must`` if there is one: the actions that order ties by search, the others as they can.

    Those of ``must`` have one event, which no other wants.

    A branch is left when a match without order of what remains could not make it larger than the
    best; events of one turn that the same actions want are tried once.
    """
    tied = {a for p in order for a in p}
    before = {a: [b for b, x in order if x == a] for a in edges}
    queue, ready = [], set()
    while more := [a for a in edges if a in tied and a not in ready and all(b in ready for b in before[a])]:
        queue += more
        ready |= set(more)  # actions on a circle, or after one without events, are never ready
    wants: dict[int, set[str]] = {}
    for a in edges:
        for event, _ in edges[a]:
            wants.setdefault(event, set()).add(a)
    best: Match = {}
    most = size - 1

    def rest(chosen: Match, names: list[str]) -> Matching:
        taken = {event for event, _ in chosen.values()}
        return Matching({a: [e for e in edges[a] if e[0] not in taken] for a in names})

    others = [a for a in edges if a not in tied]

    def go(k: int, chosen: Match) -> None:
        nonlocal best, most
        bound = rest(chosen, others + queue[k:])
        if len(chosen) + len(bound.owned) <= most:
            return
        if k == len(queue):
            if not must <= chosen.keys() | bound.owned.keys():
                return
            turns = {a: dict(edges[a]) for a in bound.owned}
            best, most = chosen | {a: (event, turns[a][event]) for a, event in bound.owned.items()}, len(chosen) + len(bound.owned)
            return
        action, tried = queue[k], set()
        if all(b in chosen for b in before[action]):
            taken = {event for event, _ in chosen.values()}
            for event, turn in edges[action]:
                kind = (turn, frozenset(wants[event]))
                if event not in taken and kind not in tried and all(chosen[b][1] < turn for b in before[action]):
                    tried.add(kind)
                    go(k + 1, chosen | {action: (event, turn)})
        if action not in must:
            go(k + 1, chosen)

    go(0, {})
    return best


def _ordered(edges: Edges, order: list[tuple[str, str]]) -> Match:
    """The match of a component with order: of the largest, the one that ``largest_match`` names."""
    witness = _search(edges, order)
    size, settled, skipped = len(witness), {}, set()
    for action in sorted(edges, key=lambda a: len(edges[a])):
        taken = {event for event, _ in settled.values()}
        for event in edges[action]:
            if witness.get(action) == event:
                break
            if event[0] in taken:
                continue
            held = settled | {action: event}
            used = taken | {event[0]}
            tried = {a: [held[a]] if a in held else [] if a in skipped else [e for e in edges[a] if e[0] not in used] for a in edges}
            found = _search(tried, order, size, set(held))
            if len(found) == size:
                witness = found
                break
        if action in witness:
            settled[action] = witness[action]
        else:
            skipped.add(action)
    return witness


def largest_match(edges: Edges, order: Iterable[tuple[str, str]] = ()) -> dict[str, int]:
    """action -> event of the largest match. edges: action -> [(event, turn)]; order: (before, after) pairs.

    A dependent action counts only if its predecessor is matched in an earlier turn. Of the largest
    matches it is the one that gives the actions of fewest events first, and those given before
    them, the earliest events they can have. Components, in which no action wants an event of
    another or is tied to it, are matched apart; only those with an order need a search.
    """
    order = list(order)
    out: Match = {}
    for names in parts(edges, order):
        own = {a: edges[a] for a in names}
        # a pair whose first action has no event at all stands: the second one can't be matched
        pairs = [p for p in order if p[1] in own]
        out |= _ordered(own, pairs) if pairs else _free(own)
    return {a: out[a][0] for a in edges if a in out}


def match_actions(edges: DataFrame, by: str = "trajectory_id", dependencies: list[tuple[str, str]] | DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """Matched (by, action_id, event_id), one group of edges (a trajectory's few required actions) at a time.

    dependencies: pairs for all trajectories, or a frame (task, before, after) with those of each
    task; edges then have the task, too.
    """
    pairs = dependencies if isinstance(dependencies, list) else []
    if isinstance(dependencies, DataFrame):
        own = dependencies.groupBy(task).agg(F.sort_array(F.collect_set(F.struct(F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after")))).alias("__order"))  # a task's few pairs
        edges = edges.join(own, task, "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found: Edges = {}
        ordered = pdf.sort_values(["sequence", "event_id", "action_id"])
        for action, event, turn in zip(*(ordered[c].tolist() for c in ("action_id", "event_id", "turn_id")), strict=True):
            found.setdefault(str(action), []).append((event, turn))
        order = pairs
        if "__order" in pdf and pdf["__order"].iloc[0] is not None:
            order = [(str(p["before"]), str(p["after"])) for p in pdf["__order"].iloc[0]]
        best = largest_match(found, [p for p in order if p[1] in found])
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(best), "action_id": list(best), "event_id": list(best.values())})

    kinds = dict(edges.dtypes)
    return edges.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, action_id string, event_id {kinds['event_id']}")


def component(matched: DataFrame, required: DataFrame, by: str = "trajectory_id") -> DataFrame:
    """completed / required per trajectory of ``required`` (by, n_required)."""
    done = matched.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return required.join(done, by, "left").select(by, (F.coalesce("n", F.lit(0)) / F.col("n_required")).alias("value"))
