import math
import random

import pytest
from pyspark.sql import functions as F

from rollmill.operators import credit

MEMBER = "group string, trajectory_id int, score double, terminal double, multiplier double, complete boolean"
TURN = "trajectory_id int, turn int, phi_before double, phi_after double, bad boolean, refusal boolean, cost double, present boolean"


def plain(group, version, labels):
    """The rules once more, on lists, for one group of (member, turns)."""
    scores = [m["score"] for m, _ in group]
    mean = math.fsum(scores) / len(scores)
    std = math.sqrt(math.fsum((s - mean) ** 2 for s in scores) / len(scores))
    returns = []
    for m, turns in group:
        out = []
        for t, x in enumerate(turns):
            step = x["after"] - x["before"]
            if version == "v4":
                out.append(0.5 * step)
            elif version == "v1":
                out.append(m["multiplier"] * (m["terminal"] + 0.5 * (turns[-1]["after"] - x["before"])))
            else:
                ahead = math.fsum(min(y["after"] - y["before"], 0) if y["bad"] else y["after"] - y["before"] for y in turns[t:])
                out.append(m["multiplier"] * (m["terminal"] + 0.5 * ahead) if m["complete"] and not x["bad"] else 0.0)
        returns.append(out)
    counted = [r for (m, turns), rs in zip(group, returns) for x, r in zip(turns, rs) if m["complete"] and x["present"]]
    centre = math.fsum(counted) / len(counted) if counted else 0.0
    result = {}
    for (m, turns), rs in zip(group, returns):
        for t, (x, r) in enumerate(zip(turns, rs)):
            if m["multiplier"] == 0:
                result[m["id"], t] = 0.0
                continue
            base = (m["score"] - mean) / (std + 1e-6)
            if version == "v4":
                a = base + (r if x["present"] else 0.0) - (1.0 if x["bad"] else 0.0) - x["cost"]
                if x["bad"]:
                    a = min(a, -1 - x["cost"])
                if labels:
                    a = min(a, -1) if x["bad"] else max(a + 1, 1) if x["refusal"] else a
            else:
                local = r - centre if m["complete"] and x["present"] else 0.0
                penalty = {"v1": 0, "v2": float(x["bad"]), "v3": max(float(x["bad"]), x["cost"])}[version]
                a = base + (min(local, 0) - penalty if penalty else local)
            result[m["id"], t] = a
    return result


@pytest.mark.parametrize(("version", "labels"), [("v1", False), ("v2", False), ("v3", False), ("v4", False), ("v4", True)])
def test_against_plain_rules(spark, version, labels):
    rng = random.Random(hash((version, labels)) % 1000)
    members, turns, expected = [], [], {}
    for g in range(6):
        group = []
        for i in range(rng.randrange(2, 5)):
            m = {"id": g * 10 + i, "multiplier": rng.choice([0, 0.75, 1]), "terminal": rng.choice([0.0, 1.0]), "complete": rng.random() < 0.8}
            m["score"] = 0.0 if m["multiplier"] == 0 else rng.random()
            phi = [0.0] + [rng.randrange(5) / 4 for _ in range(rng.randrange(1, 5))]
            own = [{"before": a, "after": b, "bad": rng.random() < 0.3, "refusal": rng.random() < 0.3, "cost": rng.choice([0.0, 0.05]), "present": rng.random() < 0.9} for a, b in zip(phi, phi[1:])]
            group.append((m, own))
            members.append((str(g), m["id"], m["score"], m["terminal"], float(m["multiplier"]), m["complete"]))
            turns += [(m["id"], t, x["before"], x["after"], x["bad"], x["refusal"], x["cost"], x["present"]) for t, x in enumerate(own)]
        expected |= plain(group, version, labels)
    got = credit.assign(spark.createDataFrame(turns, TURN), spark.createDataFrame(members, MEMBER), version, labels=labels)
    found = {(r.trajectory_id, r.turn): r.advantage for r in got.collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], v, abs_tol=1e-9) for k, v in expected.items())


def test_guards_keep_their_order(spark):
    f = lambda *a: spark.range(1).select(credit.guarded(*a)).first()[0]
    no, yes = F.lit(False), F.lit(True)
    assert f(F.lit(-2.0), no, F.lit(0.1), F.lit(0.05)) == 0.05  # floor
    assert f(F.lit(3.0), yes, F.lit(0.1), F.lit(0.05)) == -1.1  # the policy ceiling beats the floor
    assert f(F.lit(3.0), no, F.lit(0.1), F.lit(0.05), yes) == -1.1


def test_tokens_take_their_turns_value(spark):
    tokens = spark.createDataFrame([(1, [0, 0, -1, 1, -1])], "trajectory_id int, response_turn_ids array<int>")
    values = spark.createDataFrame([(1, 0, 0.5), (1, 1, -1.0)], "trajectory_id int, turn int, advantage double")
    out = credit.broadcast_tokens(tokens, values)
    assert out.first().token_advantages == [0.5, 0.5, 0.0, -1.0, 0.0]
    assert out.select(credit.masked(F.col("token_advantages"), F.lit(True)).alias("z")).first().z == [0.0] * 5


def test_a_turn_without_progress_changes_no_other(spark):
    members = spark.createDataFrame([("g", 1, 0.5, 0.0, 1.0, True), ("g", 2, 1.0, 1.0, 1.0, True)], MEMBER)
    base = [(1, 0, 0.0, 0.5, False, False, 0.0, True), (2, 0, 0.0, 1.0, False, False, 0.0, True)]
    a = credit.assign(spark.createDataFrame(base, TURN), members)
    b = credit.assign(spark.createDataFrame([*base, (1, 1, 0.5, 0.5, False, False, 0.0, True)], TURN), members)
    find = lambda df: {(r.trajectory_id, r.turn): r.advantage for r in df.collect()}
    assert find(a).items() <= find(b).items()


def test_tasks_grow_with_turns(spark, monkeypatch):
    """Turns are dealt over more tasks as there are more of them, whatever number of shuffle partitions is set."""
    from rollmill.plans import bridges as b

    root = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{root}/lineitem.parquet").count()
    monkeypatch.setattr(b, "TASK_ROWS", n // 20)
    rows = b.turns(spark, root).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= 15 and sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) < n / 8
