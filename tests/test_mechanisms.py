"""Scans over ranges, and what saved leases tell, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from rollmill.functions import scalars
from rollmill.operators import concurrency, failures, matching, scans, subgoals


def test_running_over_ranges(spark):
    """A key over many ranges, keys within one, a null key: sums, the next row and the last value known."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(5), rng.choice([None, f"v{i}"])) for i in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i int, n int, v string")
    got = scans.running(frame, ["k"], ["i"], {"total": F.col("n").cast("long"), "place": F.lit(1).cast("long")}, {"next_i": F.col("i"), "next_v": F.col("v")}, last={"known": F.col("v")}, previous={"before": F.col("n")}, ranges=9)
    assert got.columns == ["k", "i", "n", "v", "total", "place", "next_i", "next_v", "known", "before"]
    want = []
    for key in {r[0] for r in rows}:
        own, total, known, before = sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 0, None, None
        for at, r in enumerate(own):
            total, known = total + r[2], r[3] or known
            after = own[at + 1] if at + 1 < len(own) else (None,) * 4
            want.append((*r, total, at + 1, after[1], after[3], known, before))
            before = r[2]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_numbered(spark):
    rows = [(k % 7, k) for k in range(50)]
    frame = spark.createDataFrame(rows, "x int, y int")
    assert [tuple(r) for r in scans.numbered(frame, ["x", "y"]).orderBy("place").collect()] == [(*r, k + 1) for k, r in enumerate(sorted(rows))]
    assert scans.numbered(frame.limit(0), ["x"]).collect() == []


LEASE = "pool string, lease string, start long, end long"


def replayed(rows):
    """The budget's own bookkeeping, event by event."""
    steps = []
    for pool, lease, start, end in rows:
        steps.append((pool, start, 1 if start == end else 2, lease, 0, 1))
        if end is not None:
            steps.append((pool, end, 1 if start == end else 0, lease, 1, -1))
    out = {}
    for pool in {s[0] for s in steps}:
        own, level, levels = sorted(s for s in steps if s[0] == pool), 0, []
        for k, (_, at, _, _, _, change) in enumerate(own):
            level += change
            levels.append((level, at, change, (own[k + 1][1] if k + 1 < len(own) else at) - at))
        peak = max(x[0] for x in levels)
        taken = sum(x[2] > 0 for x in levels)
        gaps = [x[3] for x in levels if x[0] > 0]
        out[pool] = (taken, taken - sum(x[2] < 0 for x in levels), peak, min(x[1] for x in levels if x[0] == peak and x[2] > 0), sum(x[3] for x in levels if x[0] == peak), max(gaps, default=0), sum(g >= 6 for g in gaps))
    return out


def test_peaks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AAAB"), f"l{k}", s := rng.randrange(300), None if rng.random() < 0.05 else s + rng.choice([0, 0, 1, 5, 20])) for k in range(200)] + [("C", "x", 1, 1)]
    got = {r["pool"]: tuple(r[c] for c in ("n_leases", "open_leases", "peak", "peak_at", "time_at_peak", "longest_gap", "n_stalls")) for r in concurrency.peaks(spark.createDataFrame(rows, LEASE), stall=6).collect()}
    assert got == replayed(rows)
    assert concurrency.peaks(spark.createDataFrame([], LEASE)).collect() == []


def test_faults_and_overlaps(spark):
    rows = [("p", "a", 0, 10), ("p", "b", 1, 3), ("p", "c", 2, 4), ("p", "d", 4, 5), ("p", "a", 9, 12), ("q", "a", 9, None), ("q", "a", 20, 21)]
    frame = spark.createDataFrame(rows, LEASE)
    assert [tuple(r) for r in concurrency.faults(frame, F.lit(2)).select("pool", "lease", "at", "level").collect()] == [("p", "c", 2, 3)]
    assert sorted(map(tuple, concurrency.overlapping_leases(frame).collect())) == [("p", "a", 9), ("q", "a", 20)]
    with pytest.raises(Exception, match="unknown rollout attempt kind: odd"):
        concurrency.attempt_counts(spark.createDataFrame([(1, "odd")], "partition int, kind string")).collect()


def test_heartbeats_are_progress(spark):
    frame = spark.createDataFrame([("p", "a", 0, 20)], LEASE)
    beats = spark.createDataFrame([("p", "a", 6), ("p", "a", 13)], "pool string, lease string, at long")
    quiet, beating = (concurrency.peaks(frame, stall=8, heartbeats=h).first() for h in (None, beats))
    assert (quiet["longest_gap"], quiet["n_stalls"], beating["longest_gap"], beating["n_stalls"], beating["time_at_peak"]) == (20, 1, 7, 0, 20)


@pytest.mark.parametrize("timeout", [None, 12])
def test_queue_failures(spark, timeout):
    rng = random.Random(3)
    moves = [(rng.choice("AAB"), rng.randrange(400)) for _ in range(60)]
    waits = [(rng.choice("AABC"), k, s := rng.randrange(400), None if rng.random() < 0.3 else s + rng.randrange(40)) for k in range(150)]
    want = []
    for pool, k, start, end in waits:
        last, failed = start, None
        for t in range(start, start + 1000):  # one look at each time, moves of that time seen last
            if timeout is not None and t - start >= timeout:
                failed = ("deadline_exceeded", t)
            elif t - last >= 9:
                failed = ("stalled", t)
            if failed or (end is not None and t >= end):
                break
            if (pool, t) in moves:
                last = t
        if failed and (end is None or end > failed[1]):
            want.append((pool, k, start, *failed))
    got = concurrency.queue_failures(spark.createDataFrame(waits, "pool string, waiter int, start long, end long"), spark.createDataFrame(moves, "pool string, at long"), 9, timeout)
    assert sorted(map(tuple, got.collect())) == sorted(want)


TYPES = {
    "RuntimeError": (["RuntimeError", "Exception"], None, None), "Odd": (["OddRuntimeError", "RuntimeError"], None, None), "Group": (["ExceptionGroup", "BaseExceptionGroup"], None, None), "Timeout": (["TimeoutError", "OSError"], None, None),
    "ReadTimeout": (["ReadTimeout", "TimeoutException", "TransportError"], None, None), "Cancelled": (["CancelledError", "BaseException"], None, None), "Eof": (["SSLEOFError", "OSError"], None, None), "Plain": (["OSError"], None, None), "Refused": (["OSError"], None, "ECONNREFUSED"),
    "Rate": (["RateLimitError", "APIStatusError"], 429, None), "Bad": (["BadRequestError", "APIStatusError"], 400, None), "Local": (["LocalProtocolError", "ProtocolError", "TransportError"], None, None), "Dns": (["gaierror", "OSError"], None, "EAI_AGAIN"), "Value": (["ValueError"], None, None), "Api": (["APITimeoutError", "APIConnectionError"], None, None),
}


def retryable(kinds, edges, node, above=(), transport=False):
    """The rule by recursion, error by error."""
    if node in above or node not in kinds:
        return False
    bases, status, errno = TYPES[kinds[node]]
    chained = [c for p, c, r in edges if p == node and r in ("cause", "context")]
    if {"TimeoutError", "TimeoutException"} & set(bases):
        chained = [n for c in chained for n in ([g for p, g, r in edges if p == c and r in ("cause", "context")] if kinds.get(c) == "Cancelled" else [c])]
    under = chained + [c for p, c, r in edges if p == node and r not in ("cause", "context")]
    own = kinds[node] in ("Timeout", "ReadTimeout", "Refused", "Rate", "Dns", "Api")
    own = own or (transport and kinds[node] in ("Eof", "Plain"))
    if not own and not (kinds[node] in ("RuntimeError", "Group") and under):
        return False
    transport = transport or bool({"TransportError", "TimeoutException"} & set(bases))
    return all(retryable(kinds, edges, c, (*above, node), transport) for c in under)


def test_graphs_of_errors(spark):
    rng = random.Random(4)
    records, nodes, edges, want = [], [], [], {}
    for record in range(160):
        n = rng.randrange(1, 6)
        names = ["RuntimeError", "Group", "Timeout", "ReadTimeout", "Refused", "Rate", "Dns", "Api", "Eof", "Cancelled"] if record % 3 else list(TYPES)
        kinds = {k: rng.choice(names if k < n - 1 else ["Rate", "Api", "Eof", "Refused", "Value"]) for k in range(n)}
        own = {(rng.randrange(k), k, rng.choice(["cause", "context", "member"])) for k in range(1, n)} | {(rng.randrange(k), k, "context") for k in range(1, n) if rng.random() < 0.3}
        if rng.random() < 0.15:
            own.add((n - 1, rng.randrange(n), "cause"))
        phase = rng.choice(["model_generation"] * 4 + ["tool_parser"])
        records.append((record, phase, 0))
        nodes += [(record, k, *TYPES[kind], None) for k, kind in kinds.items()]
        edges += [(record, *e) for e in own]
        want[record] = phase == "model_generation" and retryable(kinds, own, 0)
    records.append((900, "model_generation", None))
    want[900] = False
    got = failures.interaction_graph(spark.createDataFrame(records, "record long, phase string, root long"), spark.createDataFrame(nodes, failures.NODE), spark.createDataFrame(edges, failures.EDGE))
    found = {r["record"]: r["retryable"] for r in got.collect()}
    assert found == want and 20 < sum(want.values()) < 140


def test_a_group_in_a_wrapper_of_a_phase(spark):
    """Parallel errors of one group; infrastructure errors wrap in phases that can be repeated only."""
    for phase, last, right in (("model_generation", 429, True), ("model_generation", 403, False), ("tool_parser", 429, False)):
        nodes = [(1, 0, ["RolloutInfrastructureError", "RuntimeError"], None, None, phase), (1, 1, ["ExceptionGroup", "BaseExceptionGroup"], None, None, None), (1, 2, ["ConnectError", "NetworkError", "TransportError"], None, None, None), (1, 3, ["RateLimitError", "APIStatusError"], last, None, None)]
        edges = [(1, 0, 1, "cause"), (1, 1, 2, "member"), (1, 1, 3, "member")]
        got = failures.interaction_graph(spark.createDataFrame([(1, "model_generation", 0)], "record long, phase string, root long"), spark.createDataFrame(nodes, failures.NODE), spark.createDataFrame(edges, failures.EDGE))
        assert [tuple(r) for r in got.collect()] == [(1, right)]


def test_status_errors_of_any_kind(spark):
    chains = [([(kind, status, None, None, None)], status != 400) for kind, status in (("RateLimitError", 429), ("InternalServerError", 500), ("ServiceUnavailableError", 503), ("BadRequestError", 400), ("HTTPStatusError", 502))]
    frame = spark.createDataFrame([(c, w) for c, w in chains], f"chain {failures.CHAIN}, w boolean")
    assert all(r.w == r.g for r in frame.select("w", failures.interaction_retryable(F.lit("model_generation"), F.col("chain")).alias("g")).collect())


def test_waivers_need_numbers(spark):
    free = lambda x: f'{{"reservation_id": "R", "nonfree_baggages": {x}}}'
    rows = [(free(1), free(2), True), (free('"1"'), free(2), False), (free(1), free('"2"'), False), (free("1.0"), free(2), True), (free(1), free("2.0"), False), (free("true"), free(2), False), (free(3), free(2), False), (free(-1), free(2), False), (free('"0"'), None, True), (free("0.0"), None, True), (free(1), None, False), ("{}", free(2), False), ("no json", free(2), False), (free(1), free(2).replace("R", "Q"), False)]
    frame = spark.createDataFrame(rows, "e string, s string, w boolean")
    assert all(r.w == r.g for r in frame.select("w", matching.waived(F.col("e"), F.col("s")).alias("g")).collect())


def test_replies_with_unicode_spaces(spark):
    rows = [("yes please", True), (" Yes,　please.\x1f", True), ("yes​please", False), (None, False)]
    assert all(r.w == r.g for r in spark.createDataFrame(rows, "t string, w boolean").select("w", scalars.is_affirmative(F.col("t")).alias("g")).collect())


@pytest.mark.parametrize("goals", [1, 3])
def test_subgoals_as_scans(spark, goals):
    """Random traces, one of them hot, equal to the loop over each."""
    rng = random.Random(goals)
    writes, trajectories, want = [], [], {}
    for t in range(25):
        turns = 60 if t == 0 else rng.randrange(0, 7)
        own, initial = [], [rng.random() < 0.3 for _ in range(goals)]
        for turn in range(1, turns + 1):
            for _ in range(rng.randrange(4)):
                pick = lambda p: sorted(i for i in range(goals) if rng.random() < p)
                own.append({"turn": turn, "matches": set(pick(0.5)), "names": set(pick(0.6)), "state": None if rng.random() < 0.1 else [rng.random() < 0.7 for _ in range(goals)], "effect": rng.choice([True, True, None, False]), "outside": rng.random() < 0.1})
        violating = {x for x in range(turns) if rng.random() < 0.1}
        writes += [(t, w["turn"], k, sorted(w["matches"]), sorted(w["names"]), w["state"], w["effect"], w["outside"]) for k, w in enumerate(own)]
        trajectories.append((t, turns, initial, sorted(violating)))
        done = subgoals.trace(goals, initial, turns, own, violating)
        for k in range(turns):
            want[t, k] = (done["credits"][k], done["phi"][k + 1], done["positive"][k], done["negative"][k], *(k in done[c] for c in ("wrong", "deferred", "regressions", "unknown")))
    got = subgoals.subgoal_turns(spark.createDataFrame(writes, "trajectory_id int, " + subgoals.WRITES), spark.createDataFrame(trajectories, "trajectory_id int, turns int, initial array<boolean>, violating array<int>"), goals)
    found = {(r[0], r[1]): (pytest.approx(r[2]), pytest.approx(r[3]), *r[4:]) for r in got.collect()}
    assert found == want


def test_confirmations_as_scans(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for d in range(20):
        pending, confirmed = None, False
        for k in range(80 if d == 0 else rng.randrange(8)):
            kind, h, yes = rng.choice(["proposal", "reply", "reply", "action", "action", "other"]), rng.choice("ab"), rng.choice([True, True, False, None])
            rows.append((d, k, kind, h, yes))
            allowed = kind == "action" and confirmed and pending == h
            if kind == "proposal":
                pending, confirmed = h, False
            elif kind == "reply":
                confirmed = pending is not None and bool(yes)
                pending = pending if confirmed else None
            elif allowed:
                pending, confirmed = None, False
            want[d, k] = allowed
    got = subgoals.confirmations(spark.createDataFrame(rows, "dialog_id int, message_index long, kind string, hash string, affirmative boolean"))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want and any(want.values())
