import math
import random
import time

import pytest
from pyspark.sql import functions as F

from rollmill.operators import common, curation, evaluation, events, groups, matching, profiling, progress, replay, reward, subgoals
from rollmill.streaming import barrier


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_constant_groups_have_no_advantage(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, 1.0)], "task_id string, t int, reward double")
    got = {(r.task_id, r.t): r.advantage for r in groups.group_advantages(df).collect()}
    assert got["a", 1] == got["a", 2] == 0
    assert math.isclose(got["b", 2], 0.5 / (0.5 + 1e-6))
    assert [r.task_id for r in groups.mixed_groups(df).collect()] == ["b"]


def test_select_valid_groups_is_all_or_nothing(spark):
    data = [("a", i, float(i % 2)) for i in range(3)] + [("b", 10 + i, 0.0) for i in range(2)] + [("c", 5 + i, float(i)) for i in range(2)]
    df = spark.createDataFrame(data, "task_id string, trajectory_id int, reward double")
    assert rows(groups.select_valid_groups(df, 2, 2).select("task_id", "trajectory_id")) == [("a", 0), ("a", 1), ("c", 5), ("c", 6)]
    assert not groups.select_valid_groups(df, 2, 3).take(1)


def test_chunks_drop_the_remainder(spark):
    df = spark.createDataFrame([("a", i, float(i == 0)) for i in range(5)], "task_id string, trajectory_id int, reward double")
    assert groups.chunked_groups(df, 2).count() == 4
    r = groups.group_rates(groups.chunked_groups(df, 2)).first()
    assert (r.groups, r.mixed_rate, r.zero_rate) == (2, 0.5, 0.5)


def test_slots(spark):
    df = spark.createDataFrame([("u", 0), ("u", 2), ("v", 0), ("v", 1)], "uid string, session int")
    failed = spark.createDataFrame([("u", 1)], "uid string, session int")
    got = {r.uid: r.complete for r in groups.slots_complete(df, 3, "uid", "session", failed).collect()}
    assert got == {"u": True, "v": False}


def test_incomplete_evaluation_has_no_metrics(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    some = spark.createDataFrame([(1, 0, 1.0, "user_stop"), (1, 1, 1.0, "hard_turn_limit"), (2, 0, 0.0, "user_stop")], "task_id int, slot int, reward double, termination string")
    assert rows(evaluation.missing_slots(tasks, some, 2)) == [(2, 1)]
    assert not evaluation.report(some, tasks, 2).take(1)
    whole = some.union(spark.createDataFrame([(2, 1, 1.0, "user_stop")], some.schema))
    assert tuple(evaluation.report(whole, tasks, 2, (1, 2)).first()) == (2, 0.5, 0.0)


def test_triage_order(spark):
    yes, no = F.lit(True), F.lit(False)
    state = lambda *x: evaluation.triage(*x)
    got = spark.range(1).select(state(no, no, no, no, yes, yes, yes, no, no), state(yes, no, no, no, yes, no, no, no, no), state(no, no, no, no, no, no, no, yes, yes), state(*[no] * 9)).first()
    assert list(got) == ["rejected", "error", "scoring_pending", "valid"]


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps over it y"), (2, "the quick brown fox walks"), (3, "say hi now"), (4, None), (5, "the  quick brown fox jumps over it")], "doc_id int, text string")
    bench = spark.createDataFrame([("the quick brown fox jumps over it",), ("hi",), ("",), (None,)], "text string")
    leaked = curation.leaking(docs, bench, "doc_id")
    assert rows(leaked) == [(1,), (3,)]
    kept = curation.leak_filter(docs, leaked, "doc_id")
    assert rows(kept.select("doc_id")) == [(2,), (4,), (5,)]
    assert not curation.residual(kept, leaked, "doc_id").take(1)
    assert not curation.unmatched_manifest(docs, leaked, "doc_id").take(1)


def test_prefix_targets(spark):
    talk = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "tool", "d"), (1, 5, "assistant", "e")]
    got = curation.prefix_targets(spark.createDataFrame(talk, "dialog_id int, message_index int, role string, content string")).collect()
    assert sorted((r.message_index, r.n_history) for r in got) == [(2, 2), (5, 5)]


def test_group_split_is_half_to_even_and_never_all(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "g int")
    for ratio, k in ((0.0, 1), (0.25, 2), (0.35, 4), (1.0, 9)):
        assert curation.group_split(df, "g", ratio, 1).where("split = 'validation'").count() == k


def sequential_caps(units, cap):
    seen, used, out = set(), {}, []
    for task, unit, prints in units:
        if cap and used.get(task, 0) >= cap:
            continue
        new = [p for p in prints if p not in seen]
        if new:
            used[task] = used.get(task, 0) + 1
            seen |= set(new)
            out += [(unit, p) for p in new]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_caps_and_dedup_are_coupled(spark, seed):
    rng = random.Random(seed)
    units = [(rng.choice("ab"), i, sorted({rng.randrange(9) for _ in range(rng.randrange(1, 4))})) for i in range(14)]
    df = spark.createDataFrame([(t, u, u, p) for t, u, ps in units for p in ps], "task string, unit int, place int, print int")
    cap = seed % 3
    assert rows(curation.cap_with_dedup(df, "task", "unit", "place", "print", cap).select("unit", "print")) == sequential_caps(units, cap)


EVENTS = "trajectory_id int, event_id int, sequence int, turn_id int, name string, args string, success boolean, db_effect boolean, result string, error_kind string"


def test_repetition_looks_at_the_latest_equal_call(spark):
    data = [(1, 0, 0, 1, "f", "x", False, None, None, "schema_invalid"), (1, 1, 1, 2, "f", "x", False, None, None, "schema_invalid"), (1, 2, 2, 3, "f", "x", True, False, "r", None), (1, 3, 3, 4, "f", "x", True, False, "r", None), (1, 4, 4, 5, "f", "x", True, None, "r", None), (1, 5, 5, 6, "f", "y", False, None, None, "parse_error")]
    marked = events.mark_repetition(spark.createDataFrame(data, EVENTS), ["trajectory_id", "name", "args"])
    assert [(r.unchanged_retry, r.no_progress) for r in marked.orderBy("event_id").collect()] == [(False, False), (True, False), (False, False), (False, True), (False, False), (False, False)]
    turns = spark.createDataFrame([(1, 17), (2, 3)], "trajectory_id int, turns int")
    got = {r.trajectory_id: r.penalty for r in events.process_penalty(marked, turns).collect()}
    assert math.isclose(got[1], 0.2) and got[2] == 0.0  # 0.08 + 0.14 + 0.03 + 0.1 + 0.04, capped
    costs = {r.turn: r.cost for r in events.turn_costs(marked, turns).collect()}
    assert math.isclose(sum(costs.values()), 0.2) and math.isclose(costs[1] / costs[0], 0.14 / 0.08) and set(costs) == {0, 1, 3, 5, 15, 16}
    free = {r.turn: r.cost for r in events.turn_costs(marked, turns, capped=False).collect()}
    assert math.isclose(free[15], 0.02) and math.isclose(free[1], 0.14)


def test_duplicates_are_of_the_first(spark):
    data = [(1, i, i, i + 1, "read", "x", ok, None, None, None) for i, ok in enumerate([False, True, True, True])]
    got = events.duplicate_queries(spark.createDataFrame(data, EVENTS), ["trajectory_id", "args"], F.col("name") == "read")
    assert [(r.query_status, r.duplicate_of) for r in got.orderBy("event_id").collect()] == [("failed_read", None), ("first_success", None), ("duplicate", 1), ("duplicate", 1)]


def test_write_scopes(spark):
    writes = spark.createDataFrame([(1, 0, "book", "u"), (1, 1, "book", "u"), (1, 2, "book", "v")], "trajectory_id int, sequence int, name string, target string")
    allowed = events.write_scope(writes, spark.createDataFrame([("book", "u")], "name string, target string"), ["name", "target"], F.lit(True))
    assert [r.allowed for r in allowed.orderBy("sequence").collect()] == [True, False, False]


def test_labels_and_refusals(spark):
    turns = spark.createDataFrame([(1, t) for t in range(3)], "trajectory_id int, turn int")
    evidence = spark.createDataFrame([(1, 0, "policy"), (1, 0, "tool")], "trajectory_id int, turn int, source string")
    asked = spark.createDataFrame([(1, 0), (1, 2)], "trajectory_id int, turn int")
    got = events.turn_labels(turns, evidence, asked).orderBy("turn").collect()
    assert [(r.bad_turn, r.eligible_correct_refusal) for r in got] == [(True, False), (False, False), (False, True)]
    revoked = events.later_revocations(spark.createDataFrame([(1, "k", 2), (1, "k", 5)], "t int, key string, turn int"), spark.createDataFrame([(1, "k", 1), (1, "k", 3), (1, "k", 4)], "t int, key string, turn int"), ["t", "key"])
    assert rows(revoked.select("turn", "revoked_by")) == [(2, 4), (5, None)]


def test_phi_counts_included_checks_only(spark):
    checks = spark.createDataFrame([(1, 0, False, True), (1, 0, True, False), (1, 1, True, True), (1, 1, True, False), (2, 0, True, False)], "trajectory_id int, prefix int, value boolean, included boolean")
    got = progress.phi(checks)
    assert rows(got) == [(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.0)]
    assert rows(progress.deltas(got.where("trajectory_id = 1")).select("turn", "delta")) == [(0, 0.5)]


def test_completion_and_regression(spark):
    states = [(1, 0, False, False, False), (1, 1, True, True, True), (1, 2, False, False, True), (1, 3, True, True, True), (1, 4, False, False, False)]
    df = spark.createDataFrame(states, "trajectory_id int, turn int, official boolean, db boolean, wrote boolean")
    got = progress.completion_bonus(progress.completion(df)).orderBy("turn").collect()
    assert [(r.first_success, r.regression, r.unattributed, r.bonus) for r in got] == [(1, False, False, 0.0), (1, False, False, 0.5), (1, True, False, 0.0), (1, False, False, 0.0), (1, False, True, 0.0)]


def test_means_leave_out_what_does_not_apply(spark):
    df = spark.createDataFrame([(1.0, None, 0.5, None), (None, None, None, None), (1.0, 1.0, None, None)], "db double, official_communicate double, required_action double, judge_semantic double")
    values = {k: F.col(k) for k in reward.NORMAL_WEIGHTS}
    got = df.select(reward.weighted_mean(values, reward.NORMAL_WEIGHTS).alias("m"), reward.strict_success(values).alias("s")).collect()
    assert [(round(r.m, 12), r.s) for r in got] == [(0.75, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_reward_modes(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    half, one, cut, yes = F.lit(0.5), F.lit(1.0), F.lit("max_steps"), F.lit(True)
    assert math.isclose(f(reward.legacy(half, one, F.lit(0.1), cut, yes)), (0.375 + 0.25 - 0.1) * 0.75)
    assert math.isclose(f(reward.strict_progress(one, half, F.lit(0.1), cut, yes)), 0.75 * 1.25 - 0.1)
    assert f(reward.strict_progress(one, half, F.lit(0.1), cut, F.lit(False))) == 0
    assert f(reward.turn_local(one, half, cut, F.lit(True))) == 0
    assert math.isclose(f(reward.turn_local(one, half, F.lit("user_stop"))), 1.25)


def brute_match(edges, order):
    """The best of all matches: the largest, then that of the actions of fewest events first, by their earliest events."""
    actions = sorted(edges, key=lambda a: len(edges[a]))
    best = (1, [], {})

    def go(k, chosen, used, places):
        nonlocal best
        if k == len(actions):
            turn = {a: t for a, (e, t) in chosen.items()}
            if all(after not in turn or (before in turn and turn[before] < turn[after]) for before, after in order):
                best = min(best, (-len(chosen), places, {a: e for a, (e, _) in chosen.items()}), key=lambda x: x[:2])
            return
        go(k + 1, chosen, used, [*places, 99])
        for place, (e, t) in enumerate(edges[actions[k]]):
            if e not in used:
                go(k + 1, chosen | {actions[k]: (e, t)}, used | {e}, [*places, place])

    go(0, {}, set(), [])
    return best[2]


@pytest.mark.parametrize("seed", range(150))
def test_largest_match(seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 7)
    turns = [rng.randrange(4) for _ in range(n)]
    edges = {a: [(e, turns[e]) for e in range(n) if rng.random() < rng.choice([0.2, 0.5])] for a in "pqrstu"[: rng.randrange(2, 7)]}
    order = [("p", "q"), ("q", "r"), ("s", "q"), ("r", "p"), ("z", "t")]
    order = rng.sample(order, rng.randrange(4))
    assert matching.largest_match(edges, order) == brute_match(edges, order)


def test_forty_actions_with_an_order_of_five():
    """Each component by itself; also where all actions want all events, and where the order's actions share theirs with others."""
    spread = {f"a{k}": [(e, e // 4) for e in range(k, 200, 40)] for k in range(40)}
    crowded = {f"a{k}": [(e, e // 4) for e in range(60)] for k in range(40)}
    mixed = {f"a{k}": [(e, e // 4) for e in (range(12) if k < 9 else range(12 + k, 80, 9))] for k in range(40)}
    order = [(f"a{k}", f"a{k + 1}") for k in range(4)]
    for edges in (spread, crowded, mixed):
        began = time.perf_counter()
        got = matching.largest_match(edges, order)
        took = time.perf_counter() - began
        free = matching.largest_match(edges)
        assert len(got) == 40 if edges is not mixed else len(got) >= len(free) - 4
        assert all(got[x] // 4 < got[y] // 4 for x, y in order if y in got)
        assert took < (0.1 if edges is spread else 2.0), took


def test_match_in_a_plan(spark):
    data = [(1, i, i, i + 1, "f", "x", True, None, None, None) for i in range(3)] + [(1, 3, 3, 4, "book_reservation", "y", True, False, None, None)]
    ev = spark.createDataFrame(data, EVENTS).withColumnRenamed("args", "args_key")
    actions = spark.createDataFrame([(1, "a", "f", "x"), (1, "b", "f", "x"), (1, "c", "book_reservation", "y")], "trajectory_id int, action_id string, name string, args_key string")
    got = matching.match_actions(matching.candidates(actions, ev, ["trajectory_id"]))
    assert {r.action_id for r in got.collect()} == {"a", "b"}


def test_free_baggage_needs_no_payment(spark):
    want = spark.createDataFrame([(1, "a", "update_reservation_baggages", '{"reservation_id": "r", "nonfree_baggages": 1, "payment_id": "p"}', "k")], "trajectory_id int, action_id string, name string, arguments string, loose_key string")
    kind = "trajectory_id int, event_id int, sequence int, turn_id int, name string, loose_key string, success boolean, db_effect boolean, state_before string"
    states = [None, '{"reservation_id": "r", "nonfree_baggages": 1}', '{"reservation_id": "r", "nonfree_baggages": 0}', '{"reservation_id": "q", "nonfree_baggages": 4}']
    done = spark.createDataFrame([(1, i, i, i + 1, "update_reservation_baggages", "k", True, True, s) for i, s in enumerate(states)], kind)
    assert [r.event_id for r in matching.waived_candidates(want, done, ["trajectory_id"]).collect()] == [1]


def test_subgoals_pay_once_and_charge_once():
    write = lambda turn, ok, state: {"turn": turn, "matches": {0} if ok else set(), "names": {0}, "state": state, "effect": True, "outside": False}
    t = subgoals.trace(2, [False, False], 4, [write(1, True, [True, False]), write(2, False, [False, False]), write(3, True, [True, False]), write(4, False, [False, False])], set())
    assert t["credits"] == [0.25, -0.25, 0.0, 0.0]
    withheld = subgoals.trace(2, [False, False], 2, [write(1, True, [True, False])], {0})
    assert withheld["credits"] == [0.0, 0.0] and withheld["deferred"] == [0]
    unknown = subgoals.trace(1, [False], 2, [write(1, True, [True]), write(2, True, None)], set())
    assert unknown["credits"] == [0.5, 0.0] and unknown["unknown"] == [1]


def test_confirmations_are_used_up(spark):
    talk = [("d", 0, "proposal", "h", None), ("d", 1, "reply", None, True), ("d", 2, "action", "h", None), ("d", 3, "action", "h", None)]
    df = spark.createDataFrame(talk, "dialog_id string, message_index long, kind string, hash string, affirmative boolean")
    assert [r.confirmed for r in subgoals.confirmations(df).orderBy("message_index").collect()] == [False, False, True, False]


def test_quantiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    assert list(profiling.nearest_rank(df, "x").first()) == [10, 1, 5, 9, 10, 10, 10]
    assert list(df.select(*profiling.profile(df, "x")).first()) == [5.5, 9.1, 9.91]


def test_clock_and_recovery(spark):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate([False, True, False, False])], "t int, i int, u boolean")
    got = barrier.step_clock(df, ["t"], "i", F.col("u")).orderBy("i").collect()
    assert [(r.attempt, r.optimizer_step, r.consecutive_skips) for r in got] == [(1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 1, 2)]
    tries = spark.createDataFrame([(1, 0, "infra"), (1, 1, "infra"), (1, 2, None)], "slot int, attempt int, cause string")
    assert [r.replace for r in barrier.recovery(tries, {"infra": 1}, ["slot"]).orderBy("attempt").collect()] == [True, False, False]


def test_stream_barrier_waits_for_all(spark, tmp_path):
    path, schema = tmp_path / "q", "uid string, session int, status string, reward double"
    parts = [[("u", 0, "finished", 1.0), ("v", 0, "finished", 1.0)], [("u", 1, "failed", 0.0), ("u", 0, "finished", 9.0)], [("v", 1, "running", 0.0), ("u", 1, "finished", 5.0)]]
    out, at = str(tmp_path / "o"), str(tmp_path / "c")
    for part in parts:  # three runs over one checkpoint: a group survives restarts and repeats
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).parquet(str(path))
        barrier.group_barrier(stream, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.schema(barrier.SETTLED).parquet(out)) == [("u", 1, 1, 1.0)]


def test_barrier_state_is_a_row_for_each_bucket(spark, tmp_path):
    path, schema, out = tmp_path / "q", "uid string, session int, status string, reward double", str(tmp_path / "o")
    first = [(f"g{g}", 0, "finished", 1.0) for g in range(60)]
    for part in (first, first + [(f"g{g}", 1, "failed", 0.0) for g in range(40)], [(f"g{g}", 1, "finished", 2.0) for g in range(60)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).parquet(str(path))
        query = barrier.group_barrier(stream, 2, buckets=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
    want = [(f"g{g}", 1, 1, 1.0) if g < 40 else (f"g{g}", 2, 0, 3.0) for g in range(60)]
    assert sorted(rows(spark.read.schema(barrier.SETTLED).parquet(out))) == sorted(want)


def test_replays(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "t int, x double")
    configs = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, k double")
    both = replay.over_configs(df, configs).withColumn("y", F.col("x") * F.col("k"))
    assert both.count() == 4
    assert replay.changed(both.where("name = 'a'"), both.where("name = 'b'"), ["t"], "y").count() == 2
    assert not replay.changed(both.where("name = 'a'"), both.where("name = 'a'"), ["t"], "y").take(1)


def test_rules_raise_or_flag(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    flagged = common.checked(df, {"positive": F.col("x") > 0}, "flag").orderBy("x").collect()
    assert [list(r.violations) for r in flagged] == [["positive"], ["positive"], []]
    with pytest.raises(Exception, match="rule broken: positive"):
        common.checked(df, {"positive": F.col("x") > 0}).count()


def test_transfer_branch(spark):
    kind = "call double, pre double, said double, meant double, valid boolean, own boolean, required boolean"
    df = spark.createDataFrame([(1.0, None, 0.5, None, True, False, True), (1.0, None, None, None, True, True, None)], kind)
    values = {k: F.col(c) for k, c in zip(reward.TRANSFER_WEIGHTS, ("call", "pre", "said", "meant"))}
    later, first = (reward.transfer_scores(values, F.col("valid"), F.col("own"), dynamic) for dynamic in (True, False))
    got = df.select(*later, *first, reward.uses_transfer_branch(True, F.col("required"), F.lit(True))).collect()
    assert [round(x, 9) if isinstance(x, float) else x for x in got[0]] == [0.8, 0.0, 0.8, 0.0, True]
    assert list(got[1]) == [0.0, 0.0, 1.0, 1.0, False]
    ok = spark.range(1).select(reward.transfer_valid(F.lit(True), F.lit(True), F.lit(False), F.lit(False)), reward.transfer_valid_v2(F.lit(True), F.lit(False), F.lit(True), F.lit(True), F.lit(True))).first()
    assert list(ok) == [True, False]


def test_order_of_each_task(spark):
    """Dependencies go by task; of a chain without its first action nothing counts."""
    data = [(t, a, e, e, turn) for t in (1, 2, 3) for a, e, turn in (("a", 0, 1), ("b", 1, 1), ("b", 2, 2))]
    edges = spark.createDataFrame(data, "trajectory_id int, action_id string, event_id int, sequence int, turn_id int").withColumn("task_id", F.col("trajectory_id"))
    order = spark.createDataFrame([(1, "a", "b"), (2, "z", "b")], "task_id int, before string, after string")
    assert rows(matching.match_actions(edges, dependencies=order)) == [(1, "a", 0), (1, "b", 2), (2, "a", 0), (3, "a", 0), (3, "b", 1)]


def test_many_equal_actions_and_events():
    edges = {f"a{i}": [(e, e // 4) for e in range(24)] for i in range(12)}
    order = [(f"a{i}", f"a{i + 1}") for i in range(4)]
    assert len(matching.largest_match(edges, order)) == 12
    assert len(matching.largest_match({a: e[:5] for a, e in edges.items()})) == 5


def test_history_digests(spark):
    import hashlib

    talk = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", None), (1, 4, "assistant", "b"), (1, 5, "assistant", "c"), (2, 0, "user", "x"), (2, 1, "assistant", "é"), (3, 0, "assistant", "no")]
    df = spark.createDataFrame(talk, "dialog_id int, message_index int, role string, content string").repartition(4)
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    want = [(1, 2, 2, sha("system:s", "user:u"), sha("a")), (1, 4, 4, sha("system:s", "user:u", "assistant:a"), sha("b")), (2, 1, 1, sha("user:x"), sha("é"))]
    assert rows(curation.prefix_targets(df)) == want


def test_leaks_of_all_lengths(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(80)] + [None, "", "x-one two three four five six seven-y"]
    items = ["a b", "aa", "aa bb", "bb cc dd", "a cc dd ee f", "one two three four five six seven", "ee aa bb cc dd ee ff aa", " ", "", None] + [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 6, 7, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame([(i,) for i in items], "text string")
    want = {i for i, t in enumerate(texts) if t is not None and any(p and p in t for p in items)}
    assert {r.doc_id for r in curation.leaking(docs, bench, "doc_id").collect()} == want and want
    only = [p for p in items if p and len(p.split()) > 4]
    assert {r.doc_id for r in curation.leaking(docs, spark.createDataFrame([(p,) for p in only], "text string"), "doc_id").collect()} == {i for i, t in enumerate(texts) if t and any(p in t for p in only)}
    assert curation.leaking(docs, bench.limit(0), "doc_id").count() == 0


def test_samples_and_shuffles(spark):
    df = spark.range(103).withColumnRenamed("id", "i")
    drawn = curation.sample_rows(df, 10, 7, ["i"], ["i"])
    got = [r.i for r in drawn.collect()]
    assert got == sorted(got) and len(set(got)) == 10 and set(got) == {r.i for r in curation.sample_rows(df.repartition(5), 10, 7, ["i"]).collect()}
    with pytest.raises(Exception, match="fewer than 200"):
        curation.sample_rows(df, 200, 7, ["i"]).collect()
    whole = {r.i: r.place for r in curation.shuffled(df, 3, ["i"]).collect()}
    batches = {r.i: r.place for r in curation.shuffled(df, 3, ["i"], 25).collect()}
    assert len(batches) == 100 and batches.items() <= whole.items() and max(batches.values()) < min(whole[i] for i in whole.keys() - batches.keys())


def test_ranks_over_many_ranges(spark):
    rng = random.Random(11)
    values = [float(rng.randrange(50)) for _ in range(700)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    shares = (0.0, 0.01, 0.25, 0.5, 0.731, 1.0)
    got = profiling.quantiles(df, "x", shares)
    for q in shares:
        place = (len(known) - 1) * q
        low, high = known[math.floor(place)], known[math.ceil(place)]
        assert math.isclose(got[q], low + (high - low) * (place - math.floor(place)))
    r = profiling.nearest_rank(df, "x").first()
    assert (r.n, r.least, r.p50, r.p90, r.p99, r.greatest) == (700, known[0], known[349], known[629], known[692], known[-1])
    assert profiling.quantiles(df.limit(0), "x", (0.5,)) == {0.5: None} and profiling.nearest_rank(df.limit(0), "x").first().p50 is None


def test_kinds_of_leaks(spark):
    """Verbatim, by its values and by its wording; a run that every item and half of the documents share makes no pairs."""
    common = "please note that our agents are happy to help you with this"
    items = [(k, f"{common} my flight HAT{100 + k} on 2024-05-{10 + k} goes from {c} to {d} and i want seat {k}a near the {w} with {k + 1} bags") for k, (c, d, w) in enumerate([("rome", "oslo", "window"), ("paris", "bern", "aisle"), ("lima", "cairo", "exit")])]
    bench = spark.createDataFrame([*items, (7, "two words"), (8, None)], "item_id int, text string")
    targets = spark.createDataFrame([(k, [f"HAT{100 + k}", f"2024-05-{10 + k}"]) for k in range(3)] + [(9, [])], "item_id int, values array<string>")
    other = items[0][1].replace("HAT100", "XX9").replace("2024-05-10", "2023-01-01").replace("0a", "14F").replace("1 bags", "3 bags")
    docs = [(0, f"so: {items[1][1]} end"), (1, "I took hat101, (2024-05-11)."), (2, other.upper()), (3, common), (4, f"{common} only HAT102"), (5, None), (6, "")] + [(10 + k, f"{common} x{k}") for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r["doc_id"]: (r["verbatim"], r["values"], r["template"]) for r in curation.leak_kinds(frame, bench, targets, "doc_id", "item_id").collect()}
    assert got == {0: (True, True, True), 1: (False, True, False), 2: (False, False, True)}
    runs = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in ((k, spark.range(1).select(curation.skeleton(F.lit(t))).first()[0]) for k, t in items)}
    assert {(r["doc_id"], r["item_id"], r["n_common"], r["n_runs"]) for r in curation.template_leaks(frame, bench, "doc_id", "item_id").collect()} == {(0, 1, len(runs[1]), len(runs[1])), (2, 0, len(runs[0]), len(runs[0]))}
    assert curation.leak_kinds(frame.limit(0), bench, targets, "doc_id", "item_id").collect() == []


def test_connections_of_one_hub_and_hour_are_many_tasks(spark, monkeypatch):
    """Pairs of one key are dealt to many tasks, each once, and tasks aren't put together as their input is small."""
    monkeypatch.setattr(events, "BLOCK", 200)
    monkeypatch.setattr(events, "BLOCKS", 1)
    rows = [("2024-05-01", "hub" if k % 2 else "o", "d" if k % 2 else "hub", "08:30", "08:00", f"f{k}") for k in range(200)]
    out = events.one_stop(spark.createDataFrame(rows, "date string, origin string, destination string, departs string, arrives string, number string"))
    assert out.select("first_number", "second_number").distinct().count() == out.count() == 100 * 100
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 15 and max(held) < 100 * 100 / 5


def test_connections_compare_little_more_than_they_return(spark):
    """A hot airport whose arrivals are late and departures early: pairs that can't connect are never made."""
    rng = random.Random(3)
    at = lambda lo, hi: f"{rng.randrange(lo, hi):02d}:{rng.randrange(60):02d}"
    rows = [("2024-05-01", "hub" if k % 2 else f"o{k % 7}", f"d{k % 5}" if k % 2 else "hub", at(0, 9) if rng.random() < 0.9 else at(9, 24), at(16, 24) if rng.random() < 0.8 else f"{at(0, 5)}+1", f"f{k}") for k in range(600)] + [("2024-05-02", "hub", "d0", at(0, 9), at(9, 12), "late"), (None, "hub", "hub", "01:00", "00:30", "none")]
    frame = spark.createDataFrame(rows, "date string, origin string, destination string, departs string, arrives string, number string")
    day = spark.createDataFrame(rows, frame.schema).select("number", events.scalars.leg_day(F.col("arrives"), F.col("date")).alias("d"))
    days = {r["number"]: r["d"] for r in day.collect()}
    want = {(a[5], b[5]) for a in rows for b in rows if a[2] == b[1] and b[0] is not None and days[a[5]] == b[0] and b[3] >= a[4]}
    got = [(r["first_number"], r["second_number"]) for r in events.one_stop(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = sum(1 for a in rows for b in rows if a[2] == b[1] and days[a[5]] == b[0])
    assert len(want) <= events.one_stop_candidates(frame).count() <= len(want) * 1.5 < pairs
