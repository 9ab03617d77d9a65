"""Query states, failures, prompts, judge requests and the checks of saved runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rollmill.operators import events, failures, integrity, judging, prompts, querystate
from rollmill.operators.common import checked
from rollmill.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


FLIGHTS = "state string, place int, number string, origin string, destination string, departs string, arrives string, date string, status string, instance string"


def seen(spark, calls):
    users = spark.createDataFrame([("s", "u1", '{"name":"A"}'), ("t", "u1", '{"name":"B"}')], "state string, user_id string, value string")
    trips = spark.createDataFrame([("s", "R1", '{"bags":1}')], "state string, reservation_id string, value string")
    data = [
        ("s", 0, "F1", "A", "B", "08:00", "10:00", "2024-05-10", "available", '{"seats":1}'),
        ("s", 1, "F2", "B", "C", "11:00", "12:00", "2024-05-10", "available", '{"seats":2}'),
        ("s", 2, "F3", "B", "C", "09:00", "10:00", "2024-05-10", "available", '{"seats":3}'),
        ("s", 3, "F4", "A", "D", "08:00", "01:00+1", "2024-05-10", "available", '{"seats":4}'),
        ("s", 4, "F5", "D", "C", "02:00", "03:00", "2024-05-11", "available", '{"seats":5}'),
        ("s", 5, "F6", "A", "C", "08:00", "09:00", "2024-05-10", "delayed", '{"seats":6}'),
        ("s", 6, "F7", "A", "C", "08:00", "09:00", "2024-05-10", "available", '{"seats":7}'),
        ("s", 7, "F8", "A", "C", "07:00", "09:00", "2024-05-10", "available", '{"seats":8}'),
    ]
    flights = spark.createDataFrame(data, FLIGHTS)
    made = spark.createDataFrame([(str(i), n, json.dumps(a), s) for i, (n, a, s) in enumerate(calls)], "event_id string, name string, arguments string, state string")
    return made, {int(r.event_id): (r.scope, json.loads(r.seen)) for r in querystate.projected(made, users, trips, flights).collect()}


def test_equal_reads_are_answered_once(spark):
    """Many events that make one search meet its flights once, and only what is shown of them is joined to the events."""
    calls = spark.range(300).select(F.col("id").alias("event_id"), F.lit("search_direct_flight").alias("name"), F.to_json(F.struct(F.lit("A").alias("origin"), F.lit("B").alias("destination"), F.lit("d").alias("date"), F.col("id").alias("other"))).alias("arguments"), F.lit("s").alias("state"))
    flights = spark.range(50).select(F.lit("s").alias("state"), F.col("id").cast("int").alias("place"), F.col("id").cast("string").alias("number"), *[F.lit(v).alias(c) for c, v in (("origin", "A"), ("destination", "B"), ("departs", "08:00"), ("arrives", "09:00"), ("date", "d"), ("status", "available"), ("instance", "{}"))])
    none = spark.createDataFrame([], "state string, user_id string, reservation_id string, value string")
    answered = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(text):
        answered.add(1)
        return len(json.loads(text))

    got = querystate.projected(calls, none, none, flights, shown=length).collect()
    assert sorted((r.event_id, r.seen) for r in got) == [(i, 50) for i in range(300)]
    assert 1 <= answered.value <= 4


def test_what_reads_see(spark):
    day = {"origin": "A", "destination": "C", "date": "2024-05-10"}
    calls = [
        ("get_user_details", {"user_id": "u1"}, "s"),
        ("get_user_details", {"user_id": "u1"}, "t"),
        ("get_user_details", {"user_id": "none"}, "s"),
        ("get_user_details", {"user_id": 7}, "s"),
        ("get_reservation_details", {"reservation_id": "R1"}, "s"),
        ("get_flight_status", {"flight_number": "F6", "date": "2024-05-10"}, "s"),
        ("get_flight_status", {"flight_number": "F6", "date": "2024-05-12"}, "s"),
        ("search_direct_flight", day, "s"),
        ("search_direct_flight", day | {"origin": "Z"}, "s"),
        ("search_onestop_flight", day, "s"),
        ("search_onestop_flight", day | {"destination": "Z"}, "s"),
        ("calculate", {"expression": "1+1"}, "s"),
        ("book_reservation", {"user_id": "u1"}, "s"),
        ("calculate", {}, None),
        ("search_direct_flight", {"origin": "A"}, "s"),
    ]
    _, got = seen(spark, calls)
    assert got[0] == ("airline:users:u1", {"name": "A"}) and got[1][1] == {"name": "B"} and got[2] == ("airline:users:none", None)
    assert got[4] == ("airline:reservations:R1", {"bags": 1})
    assert got[5] == ("airline:flight-status:F6:2024-05-10", {"status": "delayed"}) and got[6][1] is None
    assert got[7][0] == "airline:search_direct_flight:A:C:2024-05-10" and [f["flight_number"] for f in got[7][1]] == ["F7", "F8"] and got[8][1] == []
    assert [(c["first"]["flight_number"], [x["flight_number"] for x in c["second"]]) for c in got[9][1]] == [("F1", ["F2"]), ("F4", ["F5"])]
    assert got[10][1] == [] and got[11] == ("airline:static:calculate", {"native_semantics": "duplicate-query-v1"})
    assert set(got) == {0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11}


def test_evidence_names_state_tool_and_arguments(spark):
    calls = [("get_user_details", {"user_id": "u1"}, "s"), ("get_user_details", {"user_id": "u1"}, "s"), ("get_user_details", {"user_id": "u1"}, "t"), ("get_reservation_details", {"reservation_id": "R1"}, "s")]
    made, _ = seen(spark, calls)
    views = spark.createDataFrame([(str(i), s, v) for i, (s, v) in enumerate([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")])], "event_id string, scope string, seen string")
    got = {r.event_id: r.query_state for r in querystate.evidence(made, views).collect()}
    body = {"version": "duplicate-query-v1", "tool": "get_user_details", "arguments": {"user_id": "u1"}, "scope": "a", "state": 1}
    assert got["0"] == got["1"] == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert len(set(got.values())) == 3


def test_reads_are_duplicates_only_with_proof(spark):
    kind = "trajectory_id int, event_id string, sequence int, name string, args string, success boolean, result string, error_kind string, execution_status string, db_hash_before string, db_hash_after string, query_state_before string, query_state_after string, query_state_scope string, query_state_version string, duplicate_query boolean, duplicate_of_event_id string"
    whole = ("h", "h", "q", "q", "sc", "duplicate-query-v1")
    base = lambda i, flag=None, of=None, proof=whole, ok=True, status=None, name="calculate": (1, f"e{i}", i, name, "{}", ok, "r", None, status, *proof, flag, of)
    data = [base(0), base(1, True, "e0"), base(2, proof=("h", "h", "q", "other", "sc", "duplicate-query-v1")), base(3, ok=False), base(4, status="termination_control"), base(5, name="book_reservation"), base(6, False, None), base(7, True, "e1")]
    ev = spark.createDataFrame(data, kind)
    missing = {r.event_id: r.m for r in ev.withColumn("m", querystate.missing_proof()).collect()}
    assert missing["e2"] == ["stable_read_state"] and missing["e0"] == []
    key = ["trajectory_id", "name", "args", "query_state_scope", "query_state_version", "query_state_before"]
    out = events.duplicate_queries(ev, key, querystate.reads(), F.size(querystate.missing_proof()) == 0)
    assert {r.event_id: r.query_status for r in out.collect()} == {"e0": "first_success", "e1": "duplicate", "e2": "unresolved", "e3": "failed_read", "e4": "excluded", "e5": "excluded", "e6": "duplicate", "e7": "duplicate"}
    assert {r.event_id for r in querystate.flag_differences(ev, out).collect()} == {"e6", "e7"}


def test_retries(spark):
    e = lambda kind, status=None, errno=None, phase=None, retryable=None: (kind, status, errno, phase, retryable)
    cases = [
        ("model_generation", [e("HTTPStatusError", 503)], True, False),
        ("model_generation", [e("HTTPStatusError", 400)], False, False),
        ("model_generation", [e("ValueError")], False, False),
        ("model_generation", [], False, False),
        ("model_generation", [e("RuntimeError"), e("ConnectError")], True, False),
        ("model_generation", [e("RuntimeError")], False, False),
        ("tau2_tool_step", [e("RolloutInfrastructureError", phase="token_alignment"), e("ConnectError")], False, False),
        ("tau2_tool_step", [e("RolloutInfrastructureError", phase="model_generation"), e("OSError", errno="EPIPE")], True, False),
        ("token_alignment", [e("ConnectError")], False, False),
        ("model_generation", [e("ReadError"), e("EndOfStream")], True, False),
        ("model_generation", [e("EndOfStream")], False, False),
        ("model_generation", [e("TimeoutError"), e("CancelledError")], True, False),
        ("model_generation", [e("ConnectError"), e("CancelledError")], False, False),
        ("judge", [e("JudgeServiceFailure", retryable=True)], False, True),
        ("judge", [e("JudgeServiceFailure", retryable=False)], False, False),
        ("turn_labels", [e("ReadTimeout")], False, True),
        ("reward_scoring", [e("PolicyAttributionPending")], False, True),
        ("reward_scoring", [e("ReadTimeout")], False, False),
        (None, None, False, False),
    ]
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _, _) in enumerate(cases)], f"i int, phase string, chain {failures.CHAIN}")
    got = {r.i: (r.a, r.b) for r in df.select("i", failures.interaction_retryable(F.col("phase"), F.col("chain")).alias("a"), failures.scoring_retryable(F.col("phase"), F.col("chain")).alias("b")).collect()}
    for i, (_, _, a, b) in enumerate(cases):
        assert got[i] == (a, b), cases[i]
    reports = spark.createDataFrame([("u", "judge", "KeyError", None)], "uid string, phase string, error_type string, message string")
    with pytest.raises(Exception, match="fatal rollout in group u, phase judge: KeyError"):
        failures.raise_fatal(reports).collect()
    assert failures.raise_fatal(reports.limit(0)).count() == 0


def test_initial_prompts(spark, tmp_path):
    data = spark.createDataFrame([("1", 10), ("1", 99), ("2", 100), ("3", 101), ("4", None)], "task_id string, initial_prompt_tokens int")
    out = prompts.inspected(data, 99, 100)
    got = {(r.task_id, r.initial_prompt_tokens): (list(r.violations), r.status) for r in out.collect()}
    assert got["1", 99] == ([], "ok") and got["2", 100] == ([prompts.OVER_LIMIT, prompts.OVER_CONTEXT], "rejected") and got["4", None][1] == "failed"
    tasks = spark.createDataFrame([("1",), ("4",), ("9",)], "task_id string")
    r = prompts.report(out, tasks).first()
    assert (r.measured_samples, r.least, r.p50, r.p95, r.greatest, r.missing_tasks, r.failed_samples, r.all_requested_samples_passed) == (4, 10, 99, 101, 101, 2, 3, False)
    assert not sinks.prompt_report(out, tasks, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exist"):
        sinks.prompt_report(out, tasks, str(tmp_path / "r"))
    fine = out.where("status = 'ok'")
    assert prompts.report(fine, tasks.where("task_id = '1'")).first().all_requested_samples_passed
    assert not prompts.report(out.limit(0), tasks).first().all_requested_samples_passed
    with pytest.raises(ValueError, match="positive"):
        prompts.inspected(data, 0, 5)


MESSAGES = "trajectory_id int, policy string, task_guidance string, messages array<struct<role:string,content:string,raw_generated_text:string,tool_calls:array<struct<name:string,arguments:string>>>>"


def test_judge_requests(spark):
    m = [("system", "Follow: be kind. Always.", None, None), ("user", "hi", None, None), ("assistant", "hello", None, None), ("user", "book", None, None), ("assistant", None, None, [("book", "{}")]), ("assistant", "done", "raw done", None)]
    df = spark.createDataFrame([(1, "be kind.", None, m), (2, "p", "g", [("user", "x", None, None)])], MESSAGES)
    out = judging.turn_requests(df)
    got = {r.turn_index: r for r in out.collect()}
    assert [(t, got[t].target_message_index, len(got[t].history), got[t].target_text) for t in sorted(got)] == [(0, 2, 2, "hello"), (1, 4, 4, '[{"arguments": "{}", "name": "book"}]'), (2, 5, 5, "raw done")]
    assert all(r.violations == [] for r in checked(out, judging.request_rules(out), "flag").collect())
    bad = out.withColumn("history", F.reverse("history"))
    assert {v for r in checked(bad, judging.request_rules(bad), "flag").collect() for v in r.violations} == {"history_order"}
    request = json.loads(judging.request_json(out).where("turn_index = 1").first().request)
    assert list(request)[:2] == ["request_version", "policy"] and request["history"][0]["message"]["content"] == f"Follow: {judging.ELIDED} Always." and request["history"][1]["message"]["content"] == "hi"
    assert list(request)[3:] == sorted(list(request)[3:]) and request["target_message_index"] == 4
    decisions = spark.createDataFrame([(1, 0, True, False, [("t", "cancel")]), (1, 1, True, True, [("t", "x")])], "trajectory_id int, turn_index int, correct_refusal boolean, bad_turn boolean, refusal_requests array<struct<target:string,operation:string>>")
    prior = {r.turn_index: [p.turn_index for p in r.previous_refusals] for r in judging.turn_requests(df, decisions, "simple-turn-v1").collect()}
    assert prior == {0: [], 1: [0], 2: [0]}
    assert all(not r.previous_refusals for r in judging.turn_requests(df, decisions).collect())


def python_request(policy, guidance, messages, at, turn_index):
    """The request as plain Python builds it."""
    clean = lambda m: {k: v for k, v in m.items() if k != "turn_idx" and not (k in judging.OPTIONAL and v is None)}
    current = {"message_index": at, "message": clean(messages[at])}
    m = current["message"]
    text = m.get("raw_generated_text") or ""
    if not text.strip():
        parts = [m["content"]] if (m["content"] or "").strip() else []
        parts += [json.dumps(m["tool_calls"], ensure_ascii=False, sort_keys=True)] if m.get("tool_calls") else []
        text = "\n".join(parts) or json.dumps(m, ensure_ascii=False, sort_keys=True)
    digest = hashlib.sha256(json.dumps({"judge_version": judging.REQUEST_VERSION, "current_generation": current}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    history = [{"message_index": i, "message": clean(x)} for i, x in enumerate(messages[:at])]
    for h in history:
        if h["message"]["role"] == "system" and policy and isinstance(h["message"]["content"], str):
            h["message"]["content"] = h["message"]["content"].replace(policy, judging.ELIDED)
    view = {"request_version": judging.REQUEST_VERSION, "turn_index": turn_index, "target_message_index": at, "current_generation": current, "target_generation_sha256": digest, "target_generation_text": text, "history": history, "policy": policy, "previous_refusals": [], "final_turn_rule": judging.INDEPENDENT}
    view |= {"task_guidance": guidance} if guidance else {}
    plain = json.loads(json.dumps(view, ensure_ascii=False, sort_keys=True))
    lead = {k: plain[k] for k in judging.LEADING if k in plain}
    return json.dumps(lead | {k: v for k, v in plain.items() if k not in lead}, ensure_ascii=False)


def test_requests_byte_for_byte(spark):
    call = {"name": "book", "arguments": {"n": 1, "x": 0.5, "who": "é \"q\""}, "id": None}
    message = lambda role, content, raw=None, calls=None, turn=None: {"role": role, "content": content, "raw_generated_text": raw, "tool_calls": calls, "turn_idx": turn}
    talks = [
        ("be kind.", None, [message("system", "Follow: be kind. be kind.\n"), message("user", "hi"), message("assistant", None, turn=3), message("tool", None), message("assistant", "\u00a0", calls=[call, call]), message("assistant", "said", calls=[call]), message("assistant", "x", raw=" raw \n"), message("assistant", "", calls=[])]),
        ("", "check\tthis", [message("assistant", "alone", turn=0), message("system", None), message("assistant", "two")]),
    ]
    kind = "struct<role:string,content:string,raw_generated_text:string,tool_calls:array<struct<name:string,arguments:struct<n:int,x:double,who:string>,id:string>>,turn_idx:int>"
    frame = spark.createDataFrame([(k, *t) for k, t in enumerate(talks)], f"trajectory_id int, policy string, task_guidance string, messages array<{kind}>")
    out = judging.request_json(judging.turn_requests(frame))
    want = {}
    for k, (policy, guidance, messages) in enumerate(talks):
        for turn, at in enumerate(i for i, m in enumerate(messages) if m["role"] == "assistant"):
            want[k, turn] = python_request(policy, guidance, messages, at, turn)
    assert {(r["trajectory_id"], r["turn_index"]): r["request"] for r in out.collect()} == want
    assert all(r.violations == [] for r in checked(out, judging.request_rules(out), "flag").collect())


def test_coverage_and_audits(spark):
    groups = spark.createDataFrame([("a", 8, 8, False), ("b", 8, 5, True)], "uid string, rollout_n int, completed int, failed boolean")
    assert tuple(integrity.validation_coverage(groups).first()) == (16, 13, 3, 1, 13 / 16, 0)
    assert tuple(integrity.validation_coverage(groups.limit(0)).first()) == (0, 0, 0, 0, 0.0, 1)
    make = lambda *data: spark.createDataFrame(data, "uid string, report string")
    assert rows(integrity.changed_audits(make(("u", "1"), ("v", "2")), make(("u", "1"), ("v", "3"), ("w", "4")))) == [("v",)]


def test_saved_groups(spark):
    kind = "uid string, members array<string>, failed array<int>, decision string"
    groups = spark.createDataFrame([("u", ["u_0_0", "u_2_0"], [1], "has_signal"), ("v", ["v_0_0"], [1, 2], "has_signal"), ("w", ["w_1_0", "w_0_0", "w_2_0"], [], "all_zero_advantage")], kind)
    credit = spark.createDataFrame([("u", "a", [0.5], [0.5]), ("u", "b", [0.0], [0.0]), ("v", "c", [0.0, 0.1], [0.0, 0.0]), ("w", "d", [0.0], [0.0]), ("w", "d", None, [0.0])], "uid string, trajectory_id string, saved array<double>, advantage array<double>")
    assert rows(integrity.group_faults(groups, credit, 3)) == [("v", "advantages"), ("v", "decision"), ("w", "advantages"), ("w", "inputs"), ("w", "members"), ("w", "repeated_trajectory")]


def test_optimizer_metrics(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], [1.0, 2.0]), (2, [0.1], [1.0, float("nan")]), (3, [0.1, float("inf")], [1.0, None])], "i int, loss array<double>, grad_norm array<double>")
    got = {r.i: list(r.violations) for r in checked(df, integrity.optimizer_metric_rules(2), "flag").collect()}
    assert got == {1: [], 2: ["grad_norm_finite", "loss_count"], 3: ["grad_norm_finite", "loss_finite"]}


def broken(spark, rules, sound, kind, changes):
    """The rules that each change of a sound row breaks."""
    names = [c.strip().split(" ", 1)[0] for c in kind.split(";")]
    data = [tuple(sound)] + [tuple(v if n == name else old for n, old in zip(names, sound, strict=True)) for name, v in changes]
    df = spark.createDataFrame(data, kind.replace(";", ",")).coalesce(1)
    out = [set(r.violations) for r in checked(df, rules, "flag").collect()]
    assert out[0] == set(), out[0]
    return out[1:]


def test_progress_traces(spark):
    kind = "version string; checks array<struct<check_id:string,initial:boolean,included:boolean>>; check_values array<array<boolean>>; phi array<double>; turns int"
    checks = [("db", False, True), ("req:a", False, False), ("c", True, False), ("d", False, True)]
    values = [[False, False, True, False], [True, False, True, False], [True, True, True, True]]
    sound = ["progress-v2", checks, values, [0.0, 0.5, 1.0], 2]
    got = broken(spark, integrity.progress_trace_rules(), sound, kind, [("version", "progress-v3"), ("phi", [0.0, 0.4, 1.0]), ("check_values", values[:2]), ("check_values", [values[1], *values[1:]]), ("turns", 3)])
    assert got[0] == {"included"} and got[1] == {"fractions"} and "states" in got[2] and {"initial", "fractions"} <= got[3] and {"states", "phi"} <= got[4]


def test_subgoal_traces(spark):
    kind = "goal_ids array<string>; initial array<boolean>; check_values array<array<boolean>>; phi array<double>; positive array<array<string>>; negative array<array<string>>; turn_credits array<double>; violating array<int>; wrong_writes array<int>; turns int"
    sound = [["a", "b"], [False, False], [[False, False], [True, False], [False, True]], [0.0, 0.5, 0.5], [["a"], ["b"]], [[], ["a"]], [0.25, 0.0], [], [], 2]
    changes = [("violating", [0]), ("positive", [["a"], ["a"]]), ("turn_credits", [0.25, 0.25]), ("phi", [0.0, 0.5, 1.0]), ("positive", [["b"], []]), ("negative", [[], ["z"]]), ("turns", 1)]
    got = broken(spark, integrity.subgoal_trace_rules(), sound, kind, changes)
    assert got[0] == {"blocked"} and {"once", "came_true"} <= got[1] and got[2] == {"credits"} and got[3] == {"phi"} and "came_true" in got[4] and got[5] == {"known_goals"} and {"states", "phi", "lengths"} <= got[6]


def test_completion_traces(spark):
    kind = "official array<boolean>; db array<boolean>; regressions array<int>; first_success int; first_safe boolean; floor_turn int; bonus array<double>; db_positive double; violating array<int>; turns int"
    sound = [[False, True, False, False], [False, True, False, False], [2], 1, True, 1, [0.25, 0.0, 0.0], 0.25, [], 3]
    changes = [("db", [False, False, False, False]), ("first_success", 2), ("floor_turn", None), ("regressions", [3]), ("bonus", [0.0, 0.2, 0.0]), ("db_positive", 0.5), ("violating", [0]), ("official", [False, True, False])]
    got = broken(spark, integrity.completion_trace_rules(), sound, kind, changes)
    assert {"db_of_success", "regressions"} <= got[0] and "first_success" in got[1] and {"floor", "bonus"} <= got[2] and got[3] == {"regressions"} and got[4] == {"bonus"} and got[5] == {"budget"} and {"safe", "bonus"} <= got[6] and "lengths" in got[7]


def test_credit_rows_and_their_checks(spark):
    members = spark.createDataFrame([("t", "1", 7, 1.25, True, 1.0, 1.0), ("s", "1", 7, 0.0, False, 0.0, 0.75)], "trajectory_id string, task_id string, policy_version long, score double, valid boolean, terminal double, multiplier double")
    progress = spark.createDataFrame([("t", [0.0, 0.5, 0.5], "k"), ("s", [0.0], "k")], "trajectory_id string, phi array<double>, checkset string")
    policy = spark.createDataFrame([("t", [1], True)], "trajectory_id string, violating array<int>, attributed boolean")
    costs = spark.createDataFrame([("t", [0.0, 0.05])], "trajectory_id string, turn_costs array<double>")
    mapping = spark.createDataFrame([("t", [0, -1, 1]), ("s", [-1])], "trajectory_id string, response_turn_ids array<int>")
    got = {r.trajectory_id: r for r in integrity.credit_rows(members, progress, policy, costs, mapping).collect()}
    assert (got["t"].turns, got["t"].violating, got["t"].turn_costs, got["t"].phi_last) == (2, [1], [0.0, 0.05], 0.5)
    assert (got["s"].turns, got["s"].violating, got["s"].turn_costs, got["s"].attributed) == (0, [], [], True)
    kind = "local_only boolean; gates boolean; terminal double; progress double; phi_last double; multiplier double; process_penalty double; train_reward double; checkset string; saved_checkset string; violating array<int>; attributed boolean; policy_rewards array<double>; mapping array<int>; turns int; process_total double; turn_costs array<double>"
    sound = [True, False, 1.0, 0.5, 0.5, 1.0, 0.0, 1.25, "k", "k", [1], True, [0.0, -1.0], [0, -1, 1], 2, 0.05, [0.0, 0.05]]
    changes = [("train_reward", 1.2), ("saved_checkset", "x"), ("violating", [0, 1]), ("mapping", [0, 0, 2]), ("turn_costs", [0.05]), ("process_penalty", 0.05), ("attributed", False), ("local_only", False)]
    found = broken(spark, integrity.credit_row_rules(), sound, kind, changes)
    assert found[:3] == [{"train_reward"}, {"checkset"}, {"policy_rewards"}] and {"mapping", "violations_own_tokens"} <= found[3] and found[4] == {"turn_costs"} and found[5] == {"process_total"} and found[6] == {"attribution"} and {"train_reward", "process_total"} <= found[7]


def test_summaries(spark):
    groups = spark.createDataFrame([(8, 0.0, True), (7, 0.5, True), (8, 0.0, False)], "members int, score_std double, has_signal boolean")
    tokens = spark.createDataFrame([([1.0, 0.0, 0.0], [1, 1, 0]), ([0.0], [1])], "advantages array<double>, mask array<int>")
    assert tuple(integrity.credit_metrics(groups, tokens).first()) == (3, 1, 1, 3, 1 / 3)
    kind = "official array<boolean>, regressions array<int>, bonus array<double>, floor_turn int, db_positive double, final_reward double"
    traces = spark.createDataFrame([([False, True, False], [2], [0.25, 0.0], 1, 0.5, 1.0), ([True, False], [1], [0.0], None, 0.0, 0.0), ([False], [], [], None, 0.0, 1.0)], kind)
    assert tuple(integrity.completion_summary(traces).first()) == (3, 2, 2, 1, 1, 1, 1, 1)


def test_replays(spark):
    saved = spark.createDataFrame([(1, 0, False), (1, 1, True)], "trajectory_id int, prefix int, value boolean")
    again = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, True)], "trajectory_id int, prefix int, value boolean")
    assert rows(integrity.prefix_differences(saved, again)) == [(1, 1, True, False), (1, 2, None, True)]
    kind = "trajectory_id int, event_id string, sequence int, name string, success boolean, result string, db_effect boolean, error_kind string, execution_status string, db_hash_before string, db_hash_after string"
    w = "book_reservation"
    ev = spark.createDataFrame([(1, "a", 0, w, True, "x", True, None, None, "0", "1"), (1, "b", 1, w, True, "x", False, None, None, "1", "1"), (1, "c", 2, w, False, "x", None, "schema_invalid", None, "9", "9"), (1, "d", 3, w, True, "x", True, None, None, "9", "9"), (1, "e", 4, "calculate", True, "x", None, None, None, "9", "9")], kind)
    replayed = spark.createDataFrame([("a", True, "x", True), ("b", False, "y", True)], "event_id string, ok boolean, result string, changed boolean")
    assert rows(integrity.replay_differences(ev, replayed)) == [("b", "db_effect"), ("b", "success"), ("d", "not_replayed")]
    assert rows(integrity.broken_states(ev)) == [(1, "c", True, False), (1, "d", False, True)]


def test_screens_and_splits(spark):
    text = '{"a":1}'
    good = hashlib.sha256(text.encode()).hexdigest()
    df = spark.createDataFrame([("t", text, good, "v1", text), ("s", text, "x", None, "{}")], "trajectory_id string, inputs string, inputs_sha256 string, filter_version string, again string")
    assert rows(integrity.screen_faults(df, F.col("again"), "v1")) == [("s", "conversation"), ("s", "hash"), ("s", "version")]
    assert rows(integrity.fingerprint_differences(df, {"inputs_sha256": F.sha2("inputs", 256)}, "trajectory_id")) == [("s", "inputs_sha256")]
    verdicts = spark.createDataFrame([(True, [], 2), (False, [(1, "said so")], 2), (True, [(2, " ")], 2)], "user_sim_valid boolean, violations array<struct<reply_index:int,evidence:string>>, n_replies int")
    assert [list(r.violations) for r in checked(verdicts.withColumnRenamed("violations", "v").withColumnRenamed("v", "violations"), integrity.verdict_rules(), "flag").select("violations").collect()] == [[], [], ["consistent", "replies", "evidence"]]
    splits = spark.createDataFrame([("1", "train"), ("1", "test"), ("2", "train")], "task_id string, split string")
    assert rows(integrity.overlapping(splits)) == [("1", ["test", "train"])]
