"""Jaccard join, substring deduplication, tiling and text kernels, against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollmill.llm import components, jaccard, substring, textkernel, tiling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.text(alphabet="ab \n\té\x1c ", max_size=12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    got = []
    seen = {}
    for g in textkernel.word_groups(pa.array(texts, pa.string()), group_bytes=7):
        hashes = g.word_hashes()
        for d in range(len(g.rows)):
            own = [w.decode() for w in g.word_bytes(d)]
            got.append(own)
            assert len(own) == g.counts[d]
            for w, h in zip(own, hashes[g.first[d] : g.last[d]], strict=True):
                assert seen.setdefault(w, h) == h
    assert got == [WORD.findall(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows):
    tokens = [tuple(WORD.findall(t or "")) for _, t in rows]
    by = defaultdict(list)
    for i, w in enumerate(tokens):
        if w:
            by[w].append(i)
    texts = list(by)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in texts]
    links, parent = Counter(), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    heads = defaultdict(list)
    for i, w in enumerate(texts):
        heads[root(i)] += [rows[k][0] for k in by[w] if rows[k][0] is not None]
    out = []
    for i, w in enumerate(texts):
        out += [(rows[k][0], min(heads[root(i)], default=None), links[i], len(by[w])) for k in by[w]]
    return Counter(out + [(rows[k][0], rows[k][0], 0, 1) for k, w in enumerate(tokens) if not w])


def near_rows(words):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(25):
        base = words(g, rng.randrange(20, 200)).split()
        for c in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(0 if c == 0 else rng.randrange(4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies(make, words, odd, block):
    rows = near_rows(words) + [(1000 + (r[0] or 0), r[1]) for r in odd] + [(None, "a null id and its text")]
    got = Counter(map(tuple, jaccard.classes(make(rows), block=block).collect()))
    assert got == brute_classes(rows)


def test_later_rounds_find_what_the_first_misses(make, words, monkeypatch):
    rows = near_rows(words)
    got = Counter(map(tuple, jaccard.classes(make(rows), target_recall=1.1).collect()))  # never enough: all rounds run
    assert got == brute_classes(rows)


def test_prefixes_are_shortened_until_the_target_is_met(make, words, monkeypatch):
    """Default parameters start deep and go on; each round adds what the one before missed, and none is lost."""
    depths, plain = [], jaccard.recall_at
    monkeypatch.setattr(jaccard, "recall_at", lambda found, at, depth, threshold: (depths.append(at), plain(found, at, depth, threshold))[1])
    rows = near_rows(words)
    assert Counter(map(tuple, jaccard.classes(make(rows)).collect())) == brute_classes(rows)
    assert depths[0] == jaccard.DEPTH and len(set(depths)) > 1
    depths.clear()
    jaccard.classes(make(rows), target_recall=0.9).count()
    assert set(depths) == {jaccard.DEPTH}  # enough at once


def test_chances_of_meeting():
    rng = np.random.default_rng(3)
    same = rng.random((40_000, jaccard.TREES, jaccard.OWN)) < 0.8
    same = same[same.mean((1, 2)) >= 0.6]
    for depth in (8, 7, 5, 3):
        got = jaccard._matched(same, depth).any(1).mean()
        assert abs(got - jaccard.met(0.8, depth, 0.6)[0]) < 0.006


def test_a_hot_prefix(make, words):
    """A third of all rows in one group of near copies, whose tries' runs are cut into many blocks."""
    base = words(77, 120).split()
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(70)] + [(100 + i, words(300 + i, 60)) for i in range(140)]
    assert Counter(map(tuple, jaccard.classes(make(rows), block=8).collect())) == brute_classes(rows)


def test_one_of_each_class_stays(make, words, odd):
    rows = near_rows(words) + [(1000 + i, r[1]) for i, r in enumerate(odd)] + [(2000, "a row that comes again")] * 3
    docs = make(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k[1] for k in brute_classes(rows)})  # blank texts are classes of their own


def test_no_documents(make):
    for out in (jaccard.classes(make([])), jaccard.keep_one(make([])), substring.deduplicate(make([]))):
        assert out.count() == 0


def brute_dedup(rows, length):
    tokens = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + length]) for w in tokens for k in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, tokens, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "period"), [(35, 21), (12, 7), (6, 3), (5, 4)])
def test_repeated_passages(make, words, odd, length, period):
    rng = random.Random(length)
    passages = [words(1000 + k, length + k) for k in range(6)]
    rows = [(r[0], r[1]) for r in odd]
    for i in range(60):
        parts = [words(i, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            parts += [" ".join(p[rng.randrange(3) :]), words(rng.random(), rng.randrange(9))]
        rows.append((100 + i, "\n".join(parts)))
    rows += [(900, "a " * 100), (901, words(77, 300)), (902, words(77, 300))]
    got = substring.deduplicate(make(rows), length, period)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_dedup(rows, length)


def test_a_saturated_filter_changes_nothing(make, words):
    rows = [(i, words(i % 7, 90) + words(i, 20)) for i in range(30)]
    a, b = (sorted(map(tuple, substring.deduplicate(make(rows), bits=k).collect()), key=repr) for k in (16, 27))
    assert a == b == brute_dedup(rows, 35)


def test_kept_text(make, words):
    p = words(5, 40)
    got = {r.doc_id: r.kept_text for r in substring.deduplicate(make([(1, "x " + p), (2, p + " y"), (3, None)]), keep_text=True).collect()}
    assert got == {1: "x", 2: "y", 3: ""}


@pytest.mark.parametrize("period", range(2, 24))
def test_difference_covers(period):
    cover = substring.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_tiles(p, t, least):
    """Greedy string tiling by trying all starts."""
    done_p, done_t, out = [False] * len(p), [False] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not done_p[i + k] and not done_t[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return sorted(out)
        for k in range(best[2]):
            done_p[best[0] + k] = done_t[best[1] + k] = True
        out.append(best)


@pytest.mark.parametrize("seed", range(25))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    p, t = ([rng.choice("abc") for _ in range(n)] for n in (18, 30))
    seeds = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i : i + 3] == t[j : j + 3]]
    if seeds:
        i, j = (np.array(x) for x in zip(*seeds, strict=True))
        assert sorted(tiling.tile(i, j, 3, len(p), 3)) == brute_tiles(p, t, 3)
    else:
        assert brute_tiles(p, t, 3) == []


@pytest.mark.parametrize("pairs", [3, 50])
def test_seeds_some_at_a_time(words, monkeypatch, pairs):
    rng = random.Random(6)
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [few(30), few(12), "a " * 20, words(3, 25), "b c"]
    texts = pa.array([few(200), "a " * 90, items[3] + " " + few(50), None, "b c a"])
    block = tiling.block_of(list(range(len(items))), items)
    whole = sorted(tiling.matches(texts, block, 0.3))
    monkeypatch.setattr(tiling, "PAIRS", pairs)
    assert sorted(tiling.matches(texts, block, 0.3)) == whole and len(whole) > 5
    tokens = [t.split() if t else [] for t in texts.to_pylist()]
    for d, t in enumerate(tokens):
        for k, item in enumerate(items):
            p = item.split()
            tiles = brute_tiles(p, t, min(5, len(p))) if t else []
            share = sum(n for _, _, n in tiles) / len(p)
            assert ((d, k) in {(r[0], r[1]) for r in whole}) == (share >= 0.3)


def test_one_word_again_and_again():
    """400 KB of one word against an item of a thousand of it: a seed for each pair of places, a run for each diagonal."""
    tracemalloc.start()
    got = list(tiling.matches(pa.array(["word " * 80_000]), tiling.block_of([1], ["word " * 1000]), 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, 1.0, 1, 1000)] and peak < 200e6


def test_contaminated_documents(spark, make, words, odd):
    items = [(1, words(900, 30)), (2, words(901, 12)), (3, "tiny item"), (4, None), (5, ""), (6, words(902, 20))]
    a, b = items[0][1].split(), items[5][1].split()
    rows = [(r[0], r[1]) for r in odd]
    rows += [(100, words(1, 50) + " " + items[0][1].upper().replace(" ", ", ") + " " + words(2, 50)), (101, " ".join(a[15:] + ["then"] + a[:15])), (102, " ".join(a[:10])), (103, "a tiny item!"), (104, items[1][1] + " " + " ".join(b)), (105, words(7, 3000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in tiling.contaminated(make(rows), bench).collect()}
    assert got == {(100, 1): (1.0, 1), (101, 1): (1.0, 2), (103, 3): (1.0, 1), (104, 2): (1.0, 1), (104, 6): (1.0, 1)}
    kept = tiling.decontaminate(make(rows), bench)
    assert kept.columns == make(rows).columns and len(kept.collect()) == len(rows) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.contaminated(make(rows), none).count() == 0 and tiling.decontaminate(make(rows), none).count() == len(rows)
    assert tiling.contaminated(make([]), bench).count() == 0


def test_benchmarks_beyond_a_broadcast(spark, make, words, odd, monkeypatch):
    """Joined by seeds, a benchmark gives the same pairs and the same documents."""
    items = [(i, words(500 + i, 25)) for i in range(12)] + [(100, "two words"), (101, None), (102, ""), (103, "a b a b a b a b")]
    rows = [(i, words(i, 30) + " " + t) for i, t in items[:12]] + [(r[0], r[1]) for r in odd] + [(300, "a b " * 30), (300, "a b " * 30)]
    docs, bench = make(rows), spark.createDataFrame(items, "item_id int, text string")
    order = lambda out: sorted(map(tuple, out.collect()), key=repr)
    whole, kept = order(tiling.contaminated(docs, bench)), order(tiling.decontaminate(docs, bench))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 400)
    assert order(tiling.contaminated(docs, bench)) == whole and len(whole) > 15
    assert order(tiling.decontaminate(docs, bench)) == kept
    assert tiling.contaminated(make([]), bench).count() == 0


