import itertools
import math

import pytest
from pyspark.sql import functions as F

from rollmill.functions import canon, jsonrules, scalars


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_pass_hat_k_against_all_subsets(spark):
    cases = [(n, c, k) for n in range(0, 8) for c in range(n + 1) for k in range(1, 6)]
    rows = spark.createDataFrame(cases, "n int, c int, k int")
    got = {}
    for k in range(1, 6):
        got |= {(r.n, r.c, k): r.p for r in rows.where(f"k = {k}").select("n", "c", scalars.pass_hat_k(F.col("n"), F.col("c"), k).alias("p")).collect()}
    for n, c, k in cases:
        if n < k:
            assert got[n, c, k] is None
            continue
        draws = list(itertools.combinations(range(n), k))
        share = sum(all(i < c for i in d) for d in draws) / len(draws)
        assert math.isclose(got[n, c, k], share, abs_tol=1e-12)


def test_pass_hat_k_rejects_bad_counts(spark):
    assert one(spark, scalars.pass_hat_k(F.lit(4), F.lit(5), 1), scalars.pass_hat_k(F.lit(4), F.lit(-1), 1)) == [None, None]


def test_success_has_two_definitions(spark):
    near = F.lit(1 - 5e-7)
    assert one(spark, scalars.official_success(near), scalars.exact_success(near)) == [True, False]
    assert one(spark, scalars.official_success(F.lit(float("nan"))), scalars.official_success(F.lit(None).cast("double"))) == [False, False]


@pytest.mark.parametrize(("reason", "cut"), [("hard_turn_limit", True), ("max_steps", True), ("user_stop", False), (None, False)])
def test_truncation(spark, reason, cut):
    r = F.lit(reason).cast("string")
    assert one(spark, scalars.truncated(r), scalars.truncation_multiplier(r), scalars.zero_truncated(F.lit("zero"), r)) == [cut, 0.75 if cut else 1.0, cut]


def test_transform_advantage(spark):
    f = lambda a, bad, ok: scalars.transform_advantage(F.lit(a), F.lit(bad), F.lit(ok))
    assert one(spark, f(0.5, True, False), f(-3.0, True, True), f(-0.4, False, True), f(0.7, False, True), f(0.2, False, False)) == [-1.0, -3.0, 1.0, 1.7, 0.2]


def test_seeds_and_keys(spark):
    assert one(spark, scalars.replacement_seed(F.lit(2**31 - 2), F.lit(1)))[0] == (2**31 - 2 + 10_000_019) % (2**31 - 1)
    assert tuple(one(spark, scalars.queue_key(F.lit("ab_3_11")))[0]) == ("ab", 3, 11)
    assert one(spark, scalars.queue_key(F.lit("ab_3")))[0] is None
    assert one(spark, scalars.trailing_int(F.lit("dialog_x_17")))[0] == 17


def test_think_tags_and_tool_turns(spark):
    tags = [F.lit(t) for t in ("a <THINK mode='x'> b", "</think>", "<thinker>", None)]
    assert one(spark, *[scalars.has_think_tag(t) for t in tags]) == [True, True, False, False]
    call = "<tool_call>{}</tool_call>"
    f = lambda text, n, **k: scalars.tool_turn_error(F.lit(text), F.lit(n), **k)
    assert one(spark, f(call, 1), f(call, 0), f("hi " + call, 1), f(call + call, 2, allow_many=False), f("plain", 0)) == [None, "parse_error", "mixed_content_and_tool_call", "multiple_tool_calls", None]


def test_next_day_is_a_string(spark):
    assert one(spark, scalars.leg_day(F.lit("01:00+1"), F.lit("2024-05-31")), scalars.leg_day(F.lit("23:00"), F.lit("2024-05-31"))) == ["2024-05-32", "2024-05-31"]


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": [true, null, "é"]}', "not json", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canon.canonical_json("t").alias("c")).collect()
    assert [r.c for r in rows] == ['{"a":[true,null,"é"],"b":1.0}', None, None]


def test_reasoning_rules_differ_on_empty_values():
    assert not jsonrules.reasons({"thinking": ""}, False)
    assert jsonrules.reasons({"thinking": ""}, True)
    assert jsonrules.reasons([{"content": "x <think> y"}], False)


def test_arguments_compare_by_meaning():
    key = lambda x, **k: jsonrules.canonical(jsonrules.normal_arguments(x, **k))
    assert key({"amount": "50"}) == key({"amount": 50.0}) != key({"amount": True})
    assert key({"n": 1}) != key({"n": 1.0})
    loose = {"unordered": frozenset({("ids",)})}
    assert key({"ids": ["b", "a"]}, **loose) == key({"ids": ["a", "b"]}, **loose) != key({"ids": ["a", "a"]}, **loose)


def test_patterns_and_quotes():
    assert jsonrules.pattern_holds('{"a": {"eq": 1}}', '{"a": 1, "b": 2}')
    assert not jsonrules.pattern_holds('{"a": {"eq": 1}}', '{"a": true}')
    assert jsonrules.quoted("the **very same** words", "x the very  same words y")
    assert not jsonrules.quoted("short", "short text")


def test_affirmatives_say_nothing_else(spark):
    replies = ["Yes.", "yes, please go ahead!", "YES book it please", "Yes, but cancel B instead", "ok", None]
    assert one(spark, *[scalars.is_affirmative(F.lit(r).cast("string")) for r in replies]) == [True, True, True, False, False, False]


def test_model_inputs_keep_their_fields():
    f = lambda text: jsonrules.arguments_string("book_reservation", text, jsonrules.UNORDERED, jsonrules.MODEL_INPUTS)
    assert f('{"passengers": [{"first_name": "A", "x": 1}, {"first_name": "B"}]}') == f('{"passengers": [{"first_name": "B"}, {"first_name": "A"}]}')
    assert f('{"flights": [{"date": "1"}, {"date": "2"}]}') != f('{"flights": [{"date": "2"}, {"date": "1"}]}')


def test_reasoning_keys_in_any_case_and_by_emptiness():
    assert jsonrules.reasons({"a": [{"Reasoning": "x"}]}, False) and jsonrules.reasons({"THINKING": None}, True)
    assert [jsonrules.reasons({"thinking": v}, False) for v in (0, False, [0], {"a": None}, None, "", [], {})] == [True] * 4 + [False] * 4
    assert not jsonrules.reasons(["thinking", {"x": "reasoning"}, None, 3], True)


def test_patterns_compare_as_arguments_do():
    holds = jsonrules.pattern_holds
    assert not holds('{"eq": {"a": 1}}', '{"a": true}') and holds('{"eq": {"a": [1, "b"]}}', '{"a": [1, "b"]}')
    assert holds('{"a": {"eq": {"amount": 2}}}', '{"a": {"amount": "2.0"}, "b": 1}') and not holds('{"a": {"eq": {"amount": "x"}}}', '{"a": {"amount": "x"}}')
    assert holds('{"l": [{"k": 1}, {}]}', '{"l": [{"k": 1, "m": 2}, {"n": 3}]}') and not holds('{"l": [1]}', '{"l": [1, 2]}')
    assert not holds('{"l": {"0": 1}}', '{"l": [1]}') and not holds('{"a": {"eq": null}}', "{}") and holds('{"a": {"eq": null}}', '{"a": null}')
    assert holds("{}", '{"a": 1}') and not holds("{}", "[1]") and not holds('{"a": 1}', '{"a": 1.0}')


def test_what_is_no_number_equals_nothing():
    f = lambda text: jsonrules.arguments_string("t", text, {}, {})
    assert f('{"amount": "never"}') is None and f('{"x": NaN}') is None and f('{"amount": true}') is None
    assert f('{"amount": "1e2"}') == f('{"amount": 100}') == f('{"amount": 100.0}') != f('{"amount": 10}')
    assert f('{"amount": 0}') == f('{"amount": -0.0}') == f('{"amount": "0e5"}')
    assert f('{"amount": "1234567890123456789012345678901"}') != f('{"amount": "1234567890123456789012345678902"}')


def test_quotes():
    q = jsonrules.quoted
    assert q("Done.", "Done.") and not q("Don", "Done.") and not q("a quote that is not there", "some other text, longer")
    assert q("the total is right", "**the total** is\n right<|im_end|>\n") and not q("a_b and c_d are names", "ab and cd are names, yes")
    assert q("a long enough text<|im_end|>", "a long enough text <|im_end|><|endoftext|>")
    call = '[{"name": "book", "arguments": {"total_baggages": 20, "user": "x y"}}]'
    assert not q('{"total_baggages": 2', call, True) and not q('"name": "book", "arguments": {"total_baggages": 2', call, True)
    assert q('{"total_baggages":20, "user"', call, True) and q('{"total_baggages": 20', call, True) and q('"arguments" : {"total_baggages": 20}', call, True)
    assert q('"a summary of what was done"', '[{"s": "well, a summary of what was done today"}]', True)
    assert q("", "<|im_end|>") and not q("", "", True) and not q("x", "") and not q(None, "x")


def test_prose_and_tokens(spark):
    texts = ["a_b > *x* **bold  words** __under__ `c`", "x\u00a0 y\x1cz"]
    assert one(spark, *[scalars.plain_prose(F.lit(t)) for t in texts]) == [jsonrules.prose(t) for t in texts] == ["a_b > *x* bold words under `c`", "x y z"]
    assert one(spark, scalars.without_end(F.lit("done <|im_end|> <|endoftext|>\n")), scalars.without_end(F.lit("a <|im_end|> b"))) == ["done", "a <|im_end|> b"]
    assert one(spark, scalars.json_tokens(F.lit('{"a b": -1.5e3, x:[true]}')))[0] == ["{", '"a b"', ":", "-1.5e3", ",", "x", ":", "[", "true", "]", "}"]
    f = lambda text, n: scalars.tool_turn_error(F.lit(text), F.lit(n))
    assert one(spark, f("<tool_call>{}</tool_call><|im_end|>", 1), f("</tool_call>x<tool_call>", 1)) == [None, "parse_error"]


def test_terminations(spark):
    f = lambda reason, moved: scalars.termination(F.lit(reason).cast("string"), F.lit(moved).cast("boolean"))
    assert one(spark, f("max_steps", True), f("user_stop", True), f("user_stop", None), f("other", False), f(None, True)) == ["max_steps", "human_transfer", "user_stop", "environment_terminated", "human_transfer"]
    s = lambda reason, used, limit, train: tuple(one(spark, scalars.truncation_state(F.lit(reason), F.lit(used), F.lit(limit), F.lit(train), F.lit("zero")))[0])
    assert s("max_steps", 1, 2, True) == (True, "max_steps", "zero", 1, 2, True, False)
    assert s("max_steps", 2, 2, True)[-2:] == (False, True) and s("max_steps", 0, 2, False)[-3:] == (0, False, False) and s("user_stop", 0, 2, True)[:2] == (False, None)


def test_calls_against_schemas(spark):
    schemas = {
        "book": {
            "type": "object",
            "properties": {"user": {"type": "string", "minLength": 2}, "n": {"$ref": "#/$defs/count"}, "legs": {"type": "array", "items": {"enum": ["out", "back"]}, "uniqueItems": True}},
            "required": ["user"],
            "additionalProperties": False,
            "$defs": {"count": {"anyOf": [{"type": "integer", "minimum": 1}, {"type": "null"}]}},
        },
        "any": {},
    }
    cases = [
        ("book", '{"user": "ab", "n": 2.0, "legs": ["out", "back"]}', None),
        ("book", '{"user": "ab", "n": null}', None),
        ("any", '{"x": [1]}', None),
        ("book", '{"n": 1}', "arguments: 'user' is a required property"),
        ("book", '{"user": "a"}', 'user: "a" is too short, at least 2'),
        ("book", '{"user": "ab", "n": 0}', "n: fits none of anyOf"),
        ("book", '{"user": "ab", "n": true}', "n: fits none of anyOf"),
        ("book", '{"user": "ab", "legs": ["out", "up"]}', 'legs.1: "up" is not one of ["out", "back"]'),
        ("book", '{"user": "ab", "x": 1}', "arguments: 'x' is an additional property"),
        ("book", "[1]", "arguments must be an object"),
        ("other", "{", "invalid JSON"),
        ("other", "{}", "unknown tool: other"),
        (None, None, "invalid JSON"),
    ]
    rows = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(cases)], "i int, n string, a string")
    got = {r.i: r.e for r in rows.select("i", canon.call_error(schemas)("n", "a").alias("e")).collect()}
    for i, (_, _, detail) in enumerate(cases):
        kind = None if detail is None else "unknown_tool" if detail.startswith("unknown") else "schema_invalid"
        assert tuple(got[i]) == (kind, detail), cases[i]
