from pyspark.sql import functions as F

from rollmill.operators import records
from rollmill.operators.common import checked


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_official_scores(spark):
    infos = ['{"reward_basis": ["db"], "db_check": {"db_reward": 0.0}, "communicate_checks": [{"met": true}, {"met": false}]}', '{"reward_basis": ["COMMUNICATE"], "reward_breakdown": {"COMMUNICATE": 1.0}}', "nope", None]
    got = [r.s for r in spark.createDataFrame([(i,) for i in infos], "i string").select(records.official_scores(F.lit(1.0), F.col("i")).alias("s")).collect()]
    assert tuple(got[0]) == (1.0, True, 0.0, True, 0.5, False)
    assert tuple(got[1]) == (1.0, False, None, True, 1.0, True)
    assert tuple(got[2]) == tuple(got[3]) == (1.0, False, None, False, None, None)


def test_compaction_uses_each_visible_message_once(spark):
    kind = "trajectory_id int, message_index int, role string, content string, tool_calls array<string>"
    native = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "user", "hi", None), (1, 2, "tool", "x", None)], kind)
    visible = spark.createDataFrame([(1, 5, "user", "hi", None)], kind)
    got = records.compacted(native, visible).orderBy("message_index").collect()
    assert [(r.content, r.visible_message_index) for r in got] == [(None, 5), ("hi", None), ("x", None)]


def test_policy_attribution(spark):
    failed = spark.createDataFrame([(1, "r1", [2], []), (1, "r2", [], ["e1"]), (1, "7:policy:transfer_scope_and_message", [], []), (1, "r3", [], [])], "trajectory_id int, rule_id string, blamed_turns array<int>, event_ids array<string>")
    events = spark.createDataFrame([(1, "e1", 4)], "trajectory_id int, event_id string, turn_id int")
    moved = spark.createDataFrame([(1, 6)], "trajectory_id int, turn_id int")
    blamed, unresolved = records.policy_attribution(failed, events, moved)
    assert {(r.rule_id, r.turn) for r in blamed.collect()} == {("r1", 1), ("r2", 3), ("7:policy:transfer_scope_and_message", 5), ("invalid_transfer", 5)}
    assert rows(unresolved) == [(1, "r3")]


def test_active_rules(spark):
    kind = "trajectory_id int, name string, success boolean, db_effect boolean, error_kind string, arguments string"
    data = [(1, "book_reservation", False, None, "schema_invalid", "{}"), (2, "book_reservation", True, True, None, '{"total_baggages": 1, "insurance": "yes"}'), (3, "cancel_reservation", False, False, "model_caused_execution_error", "{}")]
    got = {}
    for t, rule in rows(records.active_rules(spark.createDataFrame(data, kind))):
        got.setdefault(t, set()).add(rule)
    assert got[1] == {"information_grounding", "single_action_turn"}
    assert {"baggage_pricing", "insurance_timing", "user_identity", "booking_cabin"} <= got[2]
    assert "cancellation_reason" in got[3] and "refund_destination" not in got[3]


def test_contradictions(spark):
    cases = [("Fine. This is a bad turn.", False, False, True), ("'This is a bad turn' is a quote.", False, False, False), ("it fails, making it a bad turn", False, False, True), ("if it fails, making it a bad turn", False, False, False), ("x", True, True, True), ("x", True, False, False)]
    df = spark.createDataFrame(cases, "reason string, bad boolean, refusal boolean, want boolean")
    assert all(r.c == r.want for r in df.withColumn("c", records.contradicts(F.col("reason"), F.col("bad"), F.col("refusal"))).collect())


def test_decisions(spark):
    kind = "target_message_index int, evidence_message_indices array<int>, refusal_keys array<string>, correct_refusal boolean, revoked_turns array<int>, bad_turn boolean, turn_index int"
    df = spark.createDataFrame([(3, [1, 3], ["k"], True, [], False, 2), (3, [1, 1, 4], [], True, [2], False, 2)], kind)
    got = [list(r.violations) for r in checked(df, records.decision_rules(), "flag").collect()]
    assert got == [[], ["evidence_distinct", "evidence_causal", "evidence_target", "refusal_flag", "revocation"]]


def test_restored_responses(spark):
    turn = "array<struct<assistant_turn_index:int,prompt_token_ids:array<int>,output_token_ids:array<int>,output_old_log_probs:array<double>>>"
    turns = [(0, [1, 2], [3, 4], [-0.1, -0.2]), (1, [1, 2, 3, 4, 9], [5], [-0.3])]
    df = spark.createDataFrame([(turns, [0, 0, -1, 1, -1], [0.5, 0.5, 0.0, 1.0, 0.0]), (turns, [0, 0, 0, 1, -1], [0.5, 0.5, 0.0, 1.0, 0.0])], f"token_turns {turn}, response_turn_ids array<int>, token_advantages array<double>")
    a, b = records.restored(df).collect()
    assert (a.response_ids, a.mask, a.old_log_probs, a.advantages, a.padding, a.aligned) == ([3, 4, 9, 5], [1, 1, 0, 1], [-0.1, -0.2, 0.0, -0.3], [0.5, 0.5, 0.0, 1.0], 1, True)
    assert not b.aligned
    assert records.batch_padding(df.select("response_turn_ids"), 8).where("not real").count() == 6


def test_selection_and_annotations(spark):
    tasks = spark.createDataFrame([("1",), ("2",)], "task_id string")
    checks = spark.createDataFrame([("1", True, False), ("2", True, True)], "task_id string, included boolean, initial boolean")
    assert rows(records.training_selection(tasks, checks)) == [("1", True, "verified_unmet_progress"), ("2", False, "no_unmet_progress")]
    assert rows(records.training_selection(tasks, checks, "task_or_local_credit"))[1] == ("2", True, "task_or_local_credit")
    actions = spark.createDataFrame([("1", "a", "f", "x"), ("1", "b", "g", "y")], "task_id string, action_id string, name string, args_key string")
    gaps = records.annotation_gaps(actions, actions.where("action_id = 'a'"), spark.createDataFrame([("1", "a", "c"), ("1", "b", "b")], "task_id string, before string, after string"), spark.createDataFrame([("1", "train"), ("1", "test")], "task_id string, split string"))
    assert rows(gaps) == [("action", "1", "b"), ("dependency", "1", "b"), ("dependency", "1", "c"), ("split", "1", "test")]


def test_evidence_and_criteria(spark):
    checks = spark.createDataFrame([(1, "c", [0, 9], [2])], "trajectory_id int, criterion_id string, evidence_turn_ids array<int>, violation_assistant_turn_ids array<int>")
    turns = spark.createDataFrame([(1, 0), (1, 1)], "trajectory_id int, turn int")
    assert rows(records.unknown_evidence(checks, turns, turns).select("kind", "turn")) == [("blame", 2), ("evidence", 9)]
    verdicts = spark.createDataFrame([("t", "a", False), ("t", "x", True)], "task string, criterion_id string, applicable boolean")
    rubric = spark.createDataFrame([("t", "a", True), ("t", "b", False)], "task string, criterion_id string, active boolean")
    assert rows(records.criterion_gaps(verdicts, rubric, ["task", "criterion_id"])) == [("t", "a", "active_but_inapplicable"), ("t", "b", "not_answered"), ("t", "x", "not_asked")]


def test_baggage_follows_the_latest_receipt(spark):
    kind = "trajectory_id int, reservation_id string, sequence int, name string, success boolean, db_effect boolean, result string, arguments string, state_before string"
    data = [(1, "r", 0, "get_reservation_details", True, False, '{"total_baggages": 2}', "{}", None), (1, "r", 1, "update_reservation_baggages", True, True, None, '{"total_baggages": 3}', None), (1, "r", 2, "update_reservation_baggages", False, False, None, '{"total_baggages": 1}', None), (2, "r", 0, "update_reservation_baggages", True, True, None, '{"total_baggages": 0}', '{"total_baggages": 1}')]
    assert rows(records.baggage_changes(spark.createDataFrame(data, kind))) == [(1, "baggage_pricing"), (2, "baggage_removal")]


def test_bookings_do_not_depend_on_order(spark):
    kind = "trajectory_id int, reservation_id string, payments array<struct<id:string,amount:int>>"
    df = spark.createDataFrame([(1, "A", [("y", 1), ("x", 2)]), (1, "B", [("z", 1)]), (2, "C", [("z", 1)]), (2, "D", [("x", 2), ("y", 1)])], kind)
    got = {(r.trajectory_id, r.canonical_id): r.payments for r in records.canonical_bookings(df).collect()}
    assert all(got[1, f"new-booking:{i}"] == got[2, f"new-booking:{i}"] for i in range(2))
