"""Suffix-order deduplication and its kernels against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rollmill.llm import prefixfree, suffixdedup


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (doc, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, no in zip(raw, gone, strict=False) if not no)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((doc, len(raw), int(gone.sum()), int(spans), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def edited(rng, text):
    """A near copy: some letters changed, a part cut, a part put in front."""
    out = list(text)
    for _ in range(rng.randrange(0, 4)):
        out[rng.randrange(len(out))] = rng.choice("xyzé")
    a = rng.randrange(len(out))
    return rng.choice(["", "new begin ", "ü"]) + "".join(out[a // 3 : len(out) - rng.randrange(30)])


@pytest.mark.parametrize("seed, length, reach, most", [(1, 40, 12, 1 << 14), (2, 40, 24, 1 << 14), (3, 60, 20, 2), (4, 33, 9, 1 << 14), (5, 48, 16, 3)])
def test_rows(spark, make, words, odd, seed, length, reach, most):
    rng = random.Random(seed)
    base = [words(seed * 100 + k, 40) for k in range(6)]
    rows = [(k, rng.choice(base)) for k in range(15)] + [(20 + k, edited(rng, rng.choice(base))) for k in range(40)] + [(r[0], r[1]) for r in odd if len(r[1] or "") < 2000]
    rows += [(100, "a" * 150), (101, "ab" * 90), (102, "a" * 70 + "b" * 70), (103, base[0][:length]), (104, base[0][: length - 1]), (105, words(9, 30) + " " + base[1][10 : 10 + length] + " " + words(10, 20)), (106, "é" * 60)]
    got = suffixdedup.deduplicate(make(rows), length=length, reach=reach, max_stretches=most, chunk_rows=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_hot_core(spark, make, words):
    """One passage, nearly as long as a window, in most rows: its windows are counted by their hashes, others are sorted."""
    passage = words(3, 30)[:110]
    rows = [(k, f"{words(1000 + k, 12)} {passage}{' and on' if k % 3 else ' and other'} {words(2000 + k, 12)}") for k in range(120)] + [(500, "tiny")]
    for most in (5, 1 << 14):
        got = suffixdedup.deduplicate(make(rows), length=115, reach=40, max_stretches=most, chunk_rows=16)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 115)


def test_long_texts_in_blocks(monkeypatch, words):
    """A text over the size of a block has other stretches, but each window in just one, with the anchor it names."""
    text = np.frombuffer((words(4, 3000) + "z" * 500).encode(), np.uint8)
    offsets = np.array([0, 0, 5, len(text), len(text)])
    for size in (700, 1 << 20):
        found = prefixfree.stretches(text, offsets, 60, 20, size)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last, strict=True)])
        assert np.array_equal(starts, np.arange(5, len(text) - 60 + 1))
        anchors = np.repeat(found.anchor, found.last - found.first + 1)
        assert ((anchors >= starts) & (anchors < starts + 20)).all()
        seen = {}
        for i, t in zip(starts.tolist(), anchors.tolist(), strict=True):
            assert seen.setdefault(text[i : i + 60].tobytes(), t - i) == t - i


def test_order(words):
    """The order of the parse is the order of the texts, and what neighbours share is what they begin with."""
    rng = random.Random(8)
    base = words(7, 120, 12)
    texts = sorted({base[: rng.randrange(30, 500)][k % 7 :] + rng.choice(["", "x", "zz q", words(k, 9, 5)]) for k in range(120)})
    raws = [t.encode() for t in texts]
    mixed = raws[:]
    rng.shuffle(mixed)
    rank, shared = prefixfree.order_of_parse(mixed)
    assert [mixed[k] for k in np.argsort(rank)] == sorted(raws)
    for k in range(1, len(raws)):
        x, y = sorted(raws)[k - 1 : k + 1]
        assert shared[k] == next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    lefts = [r[:40] for r in raws[:30]]
    rank = prefixfree.ranks_of_suffixes(np.frombuffer(b"".join(lefts), np.uint8), np.cumsum([len(x) for x in lefts]))
    suffixes = [x[i:] for x in lefts for i in range(len(x))]
    assert [sorted(set(suffixes)).index(s) for s in suffixes] == rank.tolist()


def test_no_rows(spark, make):
    assert suffixdedup.deduplicate(make([])).collect() == []
    with pytest.raises(ValueError):
        suffixdedup.deduplicate(make([]), length=100, reach=90)
    kept = suffixdedup.deduplicate(make([(1, "abc" * 100), (2, "x" + "abc" * 50)]), length=60, reach=20, keep_bytes=True)
    assert {r["doc_id"]: bytes(r["kept"]) for r in kept.collect()} == {1: b"", 2: b"x"}
