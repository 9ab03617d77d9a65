import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from rollmill import schemas
from rollmill.functions import configs
from rollmill.operators.common import checked
from rollmill.sources import readers, sinks


def test_trajectory_files(spark, tmp_path):
    good = {"trajectory_id": "t1", "task_id": "3", "termination_reason": "user_stop", "token_turns": [{"assistant_turn_index": 0, "prompt_token_ids": [1], "output_token_ids": [2, 3], "output_old_log_probs": [-0.1, -0.2]}], "judge_checks": [], "custom_reward": {"components": {"db": {"applicable": True, "value": 1.0}}}, "metadata": '{"a": 1}'}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert readers.trajectories(spark, str(tmp_path)).first().file_name == "a.json"
    good["token_turns"][0]["output_old_log_probs"] = [-0.1]
    (tmp_path / "b.json").write_text(json.dumps(good))
    with pytest.raises(Exception, match="token_lengths"):
        readers.trajectories(spark, str(tmp_path)).count()
    flagged = readers.trajectories(spark, str(tmp_path), "flag").orderBy("file_name").collect()
    assert [list(r.violations) for r in flagged] == [[], ["token_lengths"]]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"metadata": {"source_dialog_id": "d_1"}}\n\n{"metadata": {"source_dialog_id": "d_2"}}\n')
    assert [r.source_dialog_id for r in readers.dialog_ids(readers.json_lines(spark, str(path))).collect()] == ["d_1", "d_2"]
    path.write_text("[1]\n")
    with pytest.raises(Exception, match="json_object"):
        readers.json_lines(spark, str(path)).collect()


def test_cleanup_sets_must_keep_their_count(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"set_name": "s", "count": 2, "dialog_ids": ["a", "b"]}, {"set_name": "t", "count": 3, "dialog_ids": ["a"]}]))
    assert readers.cleanup_set(spark, str(path), "s").count() == 2
    with pytest.raises(Exception, match="rule broken: count"):
        readers.cleanup_set(spark, str(path), "t").count()


def test_keyed_lists(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps([{"task_id": "1", "v": 1}, {"id": "2", "v": 2}]))
    assert sorted(r.task_id for r in readers.keyed_list(spark, str(path), "task_id string, id string, v int", "task_id", "id").collect()) == ["1", "2"]
    path.write_text(json.dumps([{"task_id": "1"}, {"id": "1"}]))
    with pytest.raises(ValueError, match="duplicate"):
        readers.keyed_list(spark, str(path), "task_id string, id string", "task_id", "id")


def test_bundles(spark, tmp_path):
    def pack(name, member):
        with tarfile.open(tmp_path / name, "w") as tar:
            data = b'{"x": 1}'
            info = tarfile.TarInfo(member)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        return str(tmp_path / name)

    assert readers.bundle(spark, pack("a.tar", "r/x.json")).first().text == '{"x": 1}'
    with pytest.raises(Exception, match="unsafe member"):
        readers.bundle(spark, pack("b.tar", "../x.json")).count()


def test_results_inline_or_in_files(spark, tmp_path):
    ddl = "id string, reward double"
    (tmp_path / "results.json").write_text(json.dumps({"simulations": [{"id": "a", "reward": 1.0}]}))
    assert readers.results(spark, str(tmp_path), ddl).first().id == "a"
    (tmp_path / "results.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "simulations").mkdir()
    (tmp_path / "simulations/0.json").write_text(json.dumps({"id": "b", "reward": 0.0}))
    assert readers.results(spark, str(tmp_path), ddl).first().id == "b"


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = sinks.write_once(df, str(tmp_path / "t"), ["k"])
    assert sinks.write_once(df, str(tmp_path / "t"), ["k"]) == path
    assert sinks.write_once(df.where("k = 1"), str(tmp_path / "t"), ["k"]) != path


def test_lines_lose_their_ends(spark, tmp_path):
    """The digest is the SHA-256 of the one file, so equal lines count and the order does."""
    df = spark.createDataFrame([("a\r\n",), ("b",), (None,), ("é\n\n",)], "value string").coalesce(1)
    n, digest = sinks.write_lines(df, str(tmp_path / "l"))
    (part,) = (tmp_path / "l").glob("part-*")
    assert part.read_bytes() == "a\nb\n\né\n".encode() and n == 4 and digest == hashlib.sha256(part.read_bytes()).hexdigest()
    twice = [sinks.write_lines(spark.createDataFrame([(x,), (x,)], "value string"), str(tmp_path / "l")) for x in "ab"]
    assert twice[0] != twice[1] and twice[0][0] == 2
    assert sinks.write_lines(df.limit(0), str(tmp_path / "l")) == (0, hashlib.sha256().hexdigest())
    many = df.union(df).repartition(3)
    n, digest = sinks.write_lines(many, str(tmp_path / "m"), one_file=False)
    files = [p.read_bytes() for p in sorted((tmp_path / "m").glob("part-*"))]
    assert n == 8 and sorted(b"".join(files)) == sorted("a\nb\n\né\n".encode() * 2)
    assert digest == hashlib.sha256("".join(hashlib.sha256(f).hexdigest() for f in files if f).encode()).hexdigest()


def test_a_failed_write_leaves_the_old_lines(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("old",)], "value string"), str(tmp_path / "l"))
    with pytest.raises(Exception, match="no more"):
        sinks.write_lines(spark.range(3).selectExpr("raise_error('no more') AS value"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["old"] and not list(tmp_path.glob("*.old-*"))


def test_write_once_compares_both_ways(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = sinks.write_once(df, str(tmp_path / "t"), ["k"])
    assert sinks.content_name(df.union(df)) != sinks.content_name(df) == sinks.content_name(df.select("v", "k").repartition(3))
    spark.createDataFrame([(3, "c")], "k int, v string").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(df, str(tmp_path / "t"), ["k"])
    with pytest.raises(ValueError, match="several rows"):
        sinks.write_once(df.union(df), str(tmp_path / "t"), ["k"])


def test_audits_are_saved_once(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "uid string, report string")
    path = str(tmp_path / "a")
    assert sinks.save_audits(make(("u", "{}"), ("v", "1")), path) == 2
    assert sinks.save_audits(make(("u", "{}"), ("w", "2")), path) == 1 and sinks.read_audits(spark, path).count() == 3
    with pytest.raises(ValueError, match="changed"):
        sinks.save_audits(make(("v", "other")), path)


def test_bundles_must_not_share_keys(spark, tmp_path):
    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task_id string")
    sinks.split_bundles({"train": part("1", "2"), "test": part("3"), "smoke": part("1")}, str(tmp_path / "b"), "task_id", ("smoke",))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4
    with pytest.raises(ValueError, match="two bundles"):
        sinks.split_bundles({"train": part("1"), "dev": part("1")}, str(tmp_path / "c"), "task_id")


def test_runs_in_bundles(spark, tmp_path):
    files = {"x/run/base_model_identity.json": "{}", "x/run/trajectories/a.json": '{"a": 1}', "x/run/other/b.json": "{}", "x/run/trajectories/deep/c.json": "{}", "x/d.json": "{}"}

    def pack(name, names):
        with tarfile.open(tmp_path / name, "w") as tar:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = len(files.get(n, "{}"))
                tar.addfile(info, io.BytesIO(files.get(n, "{}").encode()))
        return str(tmp_path / name)

    want = {("base_model_identity.json", "{}"), ("trajectories/a.json", '{"a": 1}')}
    assert {tuple(r) for r in readers.bundle(spark, pack("a.tar", files), run=True).collect()} == want
    for n, text in files.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(text)
    assert {tuple(r) for r in readers.bundle(spark, str(tmp_path / "x"), run=True).collect()} == want
    with pytest.raises(ValueError, match="2 runs"):
        readers.bundle(spark, pack("b.tar", [*files, "y/base_model_identity.json"]), run=True)
    with pytest.raises(ValueError, match="no runs"):
        readers.bundle(spark, pack("c.tar", ["x/d.json"]), run=True)
    with pytest.raises(Exception, match="unsafe"):
        readers.bundle(spark, pack("d.tar", ["x\\y.json"])).count()


def test_guidance_and_dependencies(spark, tmp_path):
    path = tmp_path / "g.json"
    tasks = spark.createDataFrame([("1",), ("2",)], "task_id string")
    path.write_text(json.dumps([{"task_id": "1", "guidance": "x"}, {"id": "2", "guidance": "y"}]))
    assert readers.judge_guidance(spark, str(path), tasks).count() == 2
    with pytest.raises(ValueError, match="differ"):
        readers.judge_guidance(spark, str(path), tasks.where("task_id = '1'"))
    path.write_text(json.dumps([{"task_id": "1", "guidance": "x"}, {"id": "2", "guidance": " "}]))
    with pytest.raises(Exception, match="rule broken: guidance"):
        readers.judge_guidance(spark, str(path), tasks).collect()
    path.write_text(json.dumps([{"task_id": "1", "dependencies": [["a", "b"], ["b", "c"]]}, {"task_id": "2", "dependencies": []}]))
    assert sorted(map(tuple, readers.dependencies(spark, str(path)).collect())) == [("1", "a", "b"), ("1", "b", "c")]


def test_prompts_and_policies(spark):
    good = f"Mind <policy> tags. {readers.ONE_CALL}.\n<policy>\nBe kind.\n</policy>\nEnd."
    prompts = [good, good.replace("Be kind.", " "), good + "\n<policy>\nx\n</policy>", "no policy", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").select("i", readers.policy_of(F.col("p")).alias("policy")).orderBy("i")
    assert [r.policy for r in rows.collect()] == ["Be kind.", None, None, None, None]
    tools = spark.createDataFrame([("b", '{"n": 2}'), ("a", '{"n": 1}')], "name string, schema string")
    out = readers.exported_context(good, tools).first()
    assert out.tools == ['{"n": 1}', '{"n": 2}'] and out.system_prompt_sha256 == hashlib.sha256(good.encode()).hexdigest()
    rules = readers.system_prompt_rules(out.system_prompt_sha256)
    made = spark.createDataFrame([(good, out.system_prompt_sha256), (good + f" {readers.MANY_CALLS}", "x")], "system_prompt string, system_prompt_sha256 string")
    assert [list(r.violations) for r in checked(made, rules, "flag").collect()] == [[], ["pinned", "one_tool_call"]]


def test_configurations():
    sound = """
credit: {mode: procredit_turn, version: procredit-turn-v4, gamma: 1.0, turn_centering: none, trajectory_std: population, process_penalty_in_turn_return: false, progress_credit: immediate_delta_v1, final_turn_rule: simple-turn-v2, unresolved_policy_credit: retry_frozen, violation_sign: strictly_negative, process_credit: uncapped_local_additive}
reward: {mode: turn_local_v1, mandatory_policy_gate: false, task_safety_gate: false, truncation_policy: zero-trajectory-v1, truncation_multiplier: 0, progress_version: progress-v3, task_score_mode: official_semantic_progress_v1, score_floor: 0, penalty_placement: turn_only}
judge: {enabled: true, mode: trajectory_once_v1, calls_per_trajectory: 1}
slot_recovery: {on_exhaustion: salvage_group, max_resamples: 2, max_scoring_retries: 3}
training_selection: {mode: task_or_local_credit}
precision: {model_dtype: bfloat16, param_dtype: bfloat16, rollout_dtype: bfloat16, reduce_dtype: float32, buffer_dtype: float32}
dynamic_sampling: {criterion: final_advantage_nonzero}
model: "${MODEL:-base}"
"""
    config = readers.load_config(sound, {"MODEL": "mine"})
    assert config["model"] == "mine" and configs.broken_rules({}) == []
    for name, value, rule in [
        ("reward.truncation_multiplier", 0.75, "zero_truncation_multiplier"),
        ("credit.version", "procredit-turn-v3", "local_mode"),
        ("credit.gamma", 0.9, "gamma"),
        ("reward.process_penalty_cap", 0.2, "trajectory_caps"),
        ("reward.normal_weights", {}, "legacy_weights"),
        ("credit.violation_penalty", True, "violation_penalty"),
        ("credit.db_subgoal_credit", "db_subgoal_local_v1", "immediate_alone"),
        ("judge.calls_per_trajectory", 2, "judge_once"),
        ("slot_recovery.max_resamples", True, "retries"),
        ("slot_recovery.max_truncation_resamples", 3, "truncation_resamples"),
        ("precision.lora_master_dtype", "float16", "precision"),
        ("profile_status", "current", "precision"),
        ("rollout.max_tool_calls_per_turn", 2, "tool_calls_per_turn"),
        ("reward.mandatory_policy_gate", True, "gates"),
    ]:
        changed = json.loads(json.dumps(config))
        *path, last = name.split(".")
        here = changed
        for part in path:
            here = here.setdefault(part, {})
        here[last] = value
        assert rule in configs.broken_rules(changed), name
    with pytest.raises(ValueError, match="gamma"):
        readers.load_config(sound.replace("gamma: 1.0", "gamma: 2"), {})
    with pytest.raises(ValueError, match="mapping"):
        readers.load_yaml("[1]")
    with pytest.raises(KeyError):
        readers.expand("FIX_EXACT_MODEL", {})
    with pytest.raises(KeyError):
        readers.expand("${X}", {"X": ""})
    assert readers.load_config("judge: {enabled: false, model: x}", {}) == {"judge": {"enabled": False}}


def test_values_and_names():
    assert configs.override([True, 1, ["a", 0.5]]) == "[true,1,[a,0.5]]"
    assert configs.safe_name(" my run/1 é.") == "my-run-1"
    with pytest.raises(ValueError):
        configs.safe_name("///")
    assert configs.same_preparation({"seed": 1, "input": "a"}, {"seed": 2, "input": "a", "size": 3}, False) == ["seed", "size", "outputs"]


def test_expand_and_profile():
    assert readers.expand({"a": ["${X:-1}", "${Y}"]}, {"Y": "2"}) == {"a": ["1", "2"]}
    with pytest.raises(KeyError):
        readers.expand("${Z}", {})
    assert readers.profile({"profiles": [{"n": 1}, {"n": 2, "current": True}]})["n"] == 2


def test_credit_rules(spark):
    row = ("u", 0, "t", [0.0, 0.5], [0, -1], [0.0], 1.0)
    df = spark.createDataFrame([row, ("u", 1, "s", [0.5, 0.5], [1], [0.0], 0.5)], "uid string, session int, trajectory_id string, phi array<double>, response_turn_ids array<int>, turn_costs array<double>, multiplier double")
    got = checked(df, schemas.credit_rules(), "flag").orderBy("session").collect()
    assert [list(r.violations) for r in got] == [[], ["phi_start", "mapping", "multiplier"]]


def test_archives_by_offset(spark, tmp_path):
    """Members of an archive in several tasks, long names and empty ones among them; unsafe ones are refused before any is read."""
    import io
    import tarfile

    from rollmill.sources import archives

    def pack(name, members):
        with tarfile.open(tmp_path / name, "w") as tar:
            for path, raw in members:
                item = tarfile.TarInfo(path)
                item.size = len(raw)
                tar.addfile(item, io.BytesIO(raw))
        return str(tmp_path / name)

    members = [(f"run/{'deep/' * (k % 40)}{k}.json", (f'{{"é": {k}}}' * (k % 50)).encode()) for k in range(300)] + [("run/other.txt", b"no")]
    source = pack("many.tar", members)
    frame = archives.read_tar(spark, source, 1 << 20, task_bytes=4096)
    assert frame.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, frame.collect())) == sorted((p, r.decode()) for p, r in members if p.endswith(".json"))
    assert sorted(map(tuple, readers.bundle(spark, source).collect())) == sorted(map(tuple, frame.collect()))
    assert archives.read_tar(spark, pack("none.tar", []), 10).collect() == []
    reader = archives.TarReader({"path": pack("bad.tar", [*members[:5], ("run/../../x.json", b"{}")]), "suffix": ".json"})
    reader.read = None
    with pytest.raises(ValueError, match="unsafe member"):
        reader.partitions()
    with pytest.raises(Exception, match="member too large"):
        readers.bundle(spark, source, limit=100).count()
    assert archives.reachable(source) and not archives.reachable("viewfs://store/in/x.tar") and not archives.reachable(str(tmp_path / "absent.tar"))


def test_seeded_samples_are_exact(spark):
    """The ids that Python's own sampling names, in their order, at sizes that take both of its ways."""
    import random

    from pyspark.sql import functions as F

    from rollmill.operators import curation

    for n, k, seed in ((1, 1, 0), (40, 7, 3), (1000, 20, 42), (1000, 990, 42), (3000, 5, -1), (10, 0, 1)):
        rows = spark.range(n).select((F.col("id") * 3).alias("id"), F.lit("x").alias("place")).repartition(5)
        got = [(r["id"], r["place"]) for r in curation.seeded_sample(rows, k, seed, ["id"]).collect()]
        assert got == [(3 * i, i) for i in sorted(random.Random(seed).sample(range(n), k))]
    with pytest.raises(ValueError, match="without replacement"):
        curation.seeded_sample(spark.range(3), 4, 1, ["id"])


def test_two_writers_at_once(spark, tmp_path):
    """Of writers of one key one is first, and the others fail; keys of their own all get in; a job that fails leaves nothing."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    path = str(tmp_path / "audits")
    assert sinks.read_audits(spark, path) is None

    def write(k):
        try:
            return sinks.save_audits(spark.createDataFrame([("same", f"by {k}"), (f"own {k}", "x")], "uid string, report string"), path)
        except ValueError as e:
            return str(e)

    def alone(k):
        return sinks.save_audits(spark.createDataFrame([(f"alone {k}", "y"), ("alike", "z")], "uid string, report string"), path)

    with ThreadPoolExecutor(6) as pool:
        said = list(pool.map(write, range(3)))
        ns = list(pool.map(alone, range(3)))
    assert sorted(map(str, said))[0] == "2" and sum("changed" in str(x) for x in said) == 2
    assert sum(ns) == 4
    rows = {(r["uid"], r["report"]) for r in sinks.read_audits(spark, path).collect()}
    winner = said.index(2)
    assert rows == {("same", f"by {winner}"), (f"own {winner}", "x"), ("alike", "z"), *((f"alone {k}", "y") for k in range(3))}
    bad = spark.range(3).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise("r").alias("report"))
    with pytest.raises(Exception, match="broken"):
        sinks.save_audits(bad, path)
    assert sinks.read_audits(spark, path).count() == len(rows)
    assert len(list((tmp_path / "audits" / "data").glob("*"))) == len(list((tmp_path / "audits" / "log").glob("0*")))
