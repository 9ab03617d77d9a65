"""Barriers whose state ends, and refills that are killed and started again, against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rollmill.streaming import expiry, refill


def run(spark, frame, folder, **options):
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = expiry.expiring_barrier(stream, **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


ROWS = "uid string, session int, status string, reward double, at long"


def frame_of(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("at", F.timestamp_seconds("at"))


def test_groups_leave_and_state_ends(spark, tmp_path):
    """Many groups over many micro-batches: whole ones once, with exact sums; open ones by their timer; state stays small."""
    rng, rows, want = random.Random(1), [], {}
    batches = []
    for k in range(12):
        own = []
        for g in range(30):
            uid, start = f"{k}-{g}", 1_000_000 + k * 7200 + g
            settles = rng.random() < 0.6
            done = []
            for s in range(3):
                status = rng.choice(["finished", "finished", "failed"]) if settles or s < 2 else "open"
                reward = rng.choice([0.1, 0.2, 0.7, 1e16])
                own.append((uid, s, status, reward, start + 10 * s))
                done.append((status, reward))
                if rng.random() < 0.3:  # delivered again
                    own.append((uid, s, status, reward, start + 10 * s))
            good = [r for status, r in done if status == "finished"]
            want[uid] = (len(good), sum(s == "failed" for s, _ in done), math.fsum(good), not settles)
        rng.shuffle(own)
        batches.append(own)
    for k, own in enumerate(batches):
        # a whole group again, long after it left: late, so nothing comes of it
        again = [r for r in batches[k - 3] if r[0].endswith("-0")] if k >= 3 else []
        frame_of(spark, own + again).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = run(spark, frame_of(spark, batches[0]), tmp_path, size=3, wait="30 minutes", late="5 minutes")
    got = spark.read.schema(expiry.OUT).parquet(str(tmp_path / "out")).collect()
    assert len(got) == len({r["uid"] for r in got})
    found = {r["uid"]: tuple(r)[1:] for r in got}
    last = {u for u in want if u.startswith("11-")}
    assert {u: v for u, v in found.items() if u not in last} == {u: v for u, v in want.items() if u not in last}
    assert {u for u in last if not want[u][3]} <= set(found)  # open ones of the last batch may still wait
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held[-6:]) <= max(held[:6]) + 60 and max(held) < 30 * 12 * 3


def test_expiring_groups_share_a_bucket(spark, tmp_path):
    """State is as many rows as buckets, not groups; whole and open groups of a bucket leave at their own times, over several micro-batches."""
    batches = [[(f"{k}-{g}", s, "finished", 1.0, 1_000_000 + 10_000 * k + g + s) for g in range(40) for s in range(2 if g % 4 else 1)] for k in range(4)]
    for own in batches:
        frame_of(spark, own).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = run(spark, frame_of(spark, batches[0]), tmp_path, size=2, wait="30 minutes", late="5 minutes", buckets=3)
    got = {r.uid: tuple(r)[1:] for r in spark.read.schema(expiry.OUT).parquet(str(tmp_path / "out")).collect()}
    want = {f"{k}-{g}": (2, 0, 2.0, False) if g % 4 else (1, 0, 1.0, True) for k in range(4) for g in range(40) if g % 4 or k < 3}
    assert got == want
    # a state row and its two timer rows for each bucket
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 9


def test_the_earliest_word_on_a_session_holds(spark, tmp_path):
    rows = [("a", 0, "finished", 1.0, 50), ("a", 0, "failed", 0.0, 20), ("a", 1, "finished", None, 60), ("b", 0, "finished", 1.0, 10), ("b", 0, "failed", 1.0, 10), ("b", 1, "finished", 2.0, 10)]
    frame = frame_of(spark, rows)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, frame, tmp_path, size=2)
    assert sorted(map(tuple, spark.read.schema(expiry.OUT).parquet(str(tmp_path / "out")).collect())) == [("a", 1, 1, 0.0, False), ("b", 1, 1, 2.0, False)]


def outcome(uid):
    """What becomes of a group, by its name alone."""
    rng = random.Random(uid)
    return rng.choice(["finished"] * 5 + ["failed"]), rng.random() < 0.55, rng.random() < 0.05


def simulated(rules, steps):
    """Steps one after another: batches, waves and counts."""
    batches, asked_all, totals = [], [], {}
    add = lambda **c: totals.update({k: totals.get(k, 0) + v for k, v in c.items()})
    for step in range(steps):
        asked, wave = [], 0
        want = rules.wave_groups
        while True:
            wave += 1
            asked += [f"{step}-{k}" for k in range(len(asked), len(asked) + want)]
            good = [u for u in asked if outcome(u)[0] == "finished" and outcome(u)[1] and not outcome(u)[2]]
            if len(good) >= rules.target or wave >= rules.waves:
                break
            want = min(rules.wave_groups, rules.target - len(good))
        asked_all += asked
        taken = good[: rules.target] if len(good) >= rules.target or rules.use_remainder else []
        if taken:
            batches.append(taken)
        add(asked=len(asked), batches=int(bool(taken)), selected=len(taken), surplus=len(good) - len(taken) if taken else 0, abandoned=0 if taken else len(good), capped=int(len(good) < rules.target), remainder=int(0 < len(taken) < rules.target))
    return batches, sorted(asked_all), totals


def produce(spark, run_, folder, sent):
    """Settles what was asked for, part by part, with rows that must not count."""
    new = [r for r in run_.read("requests").orderBy("uid").collect() if r["uid"] not in sent]
    rows = []
    for r in new:
        status, mixed, stale = outcome(r["uid"])
        number = int(r["uid"].split("-")[1])
        rows.append((r["uid"], r["policy_version"] - int(stale), status, mixed, number))
        rows.append((r["uid"], r["policy_version"], "failed", False, number + 1000))  # a later word
        sent.add(r["uid"])
    rows.append(("99-5", 99, "finished", True, 0))
    spark.createDataFrame(rows, refill.GROUP).repartition(2).write.mode("append").parquet(str(folder / "in"))
    return bool(new)


@pytest.mark.parametrize("remainder", [False, True])
def test_a_run_that_is_killed_goes_on(spark, tmp_path, remainder, monkeypatch):
    """Killed after its tables and before its commit, and after its commit; it ends with the batches of a run that was not."""
    rules, steps, sent = refill.Rules(4, 5, 3, remainder), 4, set()
    made = refill.Refill(spark, str(tmp_path / "run"), rules, steps)
    made.start()
    kills, commit, folds = iter([True, False, True, False, False, True] + [False] * 100), refill.Refill._commit, []

    def dies(self, epoch, state):
        if next(kills):
            raise RuntimeError("killed before the commit")
        commit(self, epoch, state)
        folds.append(epoch)
        if len(folds) == 3:
            raise RuntimeError("killed after the commit")

    monkeypatch.setattr(refill.Refill, "_commit", dies)
    died = 0
    for _ in range(40):
        done = made.last()[1].done
        if done:
            break
        if not produce(spark, made, tmp_path, sent):
            pass
        stream = spark.readStream.schema(refill.GROUP).parquet(str(tmp_path / "in"))
        for _ in range(3):
            query = refill.Refill(spark, str(tmp_path / "run"), rules, steps).writer(stream, str(tmp_path / "at")).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                break
            except Exception as e:  # noqa: BLE001
                assert "killed" in str(e)
                died += 1
    batches, asked, totals = simulated(rules, steps)
    assert died >= 3 and made.last()[1].done
    got = {}
    for r in made.read("batches").collect():
        got.setdefault(r["policy_version"], []).append((r["arrived"], r["uid"]))
    assert [[u for _, u in sorted(v)] for _, v in sorted(got.items())] == batches
    assert sorted(r["uid"] for r in made.read("requests").collect()) == asked
    end = made.last()[1].totals
    assert {k: end.get(k, 0) for k in totals} == totals
    assert json.dumps(end)


def test_two_runs_cannot_commit_the_same_batch(spark, tmp_path):
    rules = refill.Rules(2, 2)
    one = refill.Refill(spark, str(tmp_path / "run"), rules, 1)
    one.start()
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        one._commit(-1, refill.Step())
    with pytest.raises(RuntimeError, match="comes before"):
        one.fold(spark.createDataFrame([], refill.GROUP), 5)
    with pytest.raises(ValueError):
        refill.Rules(0, 1)
