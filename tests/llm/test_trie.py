"""The prefix trie against brute force over all prefixes."""

import hashlib
import math
import random
import re
import zlib

import pytest

from rollmill.llm import prefixtrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURN = "conv_id long, turn long, role string, text string, key string, depth int, path string, n int, block string"


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())
            turns.setdefault(c, []).append((order, (role, text)))
    own = {c: [x[1] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in under if p)
        ended = ",".join(map(str, sorted(c for c in members if built[c] == list(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=70, hot=True):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 130), n):
        hot_path = [("user", "common first turn"), ("bot", "second one"), ("user", f"x {c % 3}")] if hot and rng.random() < 0.5 else []
        path = hot_path + [(rng.choice(["user", "bot", None]), rng.choice(["a b", "", None, "c", "é \x1c ü", "d e f"])) for _ in range(rng.randrange(1, 5))]
        rows += [(c, None if rng.random() < 0.05 else k, role, text) for k, (role, text) in enumerate(path)]
    rows += [(200, k, "user", f"t {k}") for k in range(60)] + [(211, 0, "user", "t 0"), (None, 0, "user", "lost"), (212, 1, "u", "same"), (212, 1, "u", "same"), (212, 1, "u", "other")]
    return rows


@pytest.mark.parametrize("seed, most", [(1, 10_000), (2, 12), (3, 3)])
def test_nodes(spark, seed, most):
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, *"kdpnb"[:1], 1, "p", 2, "b") for r in rows], TURN).repartition(3)
    got = sorted(map(tuple, prefixtrie.trie(frame, max_turns=most).collect()), key=str)
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], TURN)
    assert prefixtrie.trie(empty).collect() == []
    lone = [(9, 0, "user", "dropped")]  # h is 2 and its block has no first conversation: a member of the root alone
    assert zlib.crc32(b"9") % 4 > 0
    frame = spark.createDataFrame([(*r, "k", 1, "p", 2, "b") for r in lone], TURN)
    assert [tuple(r) for r in prefixtrie.trie(frame).collect()] == brute(lone) == [(9, 0, None, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())]


def test_ids_meet_in_runs(spark, monkeypatch):
    """A hot sequence's ids come as many rows of text and hash as one."""
    monkeypatch.setattr(prefixtrie, "RUN_BYTES", 40)
    rows = [(20 * c, 0, "user", "all the same") for c in range(300)]
    frame = spark.createDataFrame([(*r, "k", 1, "p", 2, "b") for r in rows], TURN)
    got = {r["depth"]: r for r in prefixtrie.trie(frame).collect()}
    full = [20 * c for c in range(300)]
    assert got[1]["n_convs"] == 300 and got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, full)).encode()).hexdigest()
    assert got[1]["saved_tokens"] == 299 * 3 == got[0]["saved_tokens"]
