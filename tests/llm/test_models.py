"""Perplexity rules, line CRF and language model."""

import itertools
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollmill.llm import grulm, linecrf, perplexity, textkernel

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {i for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for i in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(hit)


def test_base_rules(make, odd, words):
    rows = odd + [(30, "a b c\na b c\n\n\na b c d %% <x>\r\n a b c", "en"), (31, "α β " * 40, "el"), (32, words(4, 200) + "\n" + words(4, 200), "en"), (33, "###", None)]
    rows = [(i, r[1], r[2] if len(r) > 2 else None, None) for i, r in enumerate(rows)]
    for r in perplexity.judge(make(rows)).collect():
        base = brute_base(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
    assert perplexity.judge(make([])).count() == 0


def symbols(text):
    plain = re.sub(r"[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", text or ""))
    return "\x02" * (perplexity.ORDER - 1) + plain + "\x03"


def grams_of(text):
    t, n = symbols(text), perplexity.ORDER
    return [t[k : k + n] for k in range(len(t) - n + 1)]


def test_ngrams_are_counted(make):
    rows = [(1, "ab  ab", "en"), (2, "ab\t1\n 2", None), (3, "", "en"), (4, None, "en"), (5, "日本語 のテキスト", "ja"), (6, "Ωμέγα και 7𝔘", "el"), (7, "ab", "en")]
    got = {(r.lang, r.gram): r.n for r in perplexity.count_ngrams(make(rows)).collect()}
    assert got == dict(Counter((lang, g) for _, text, lang in rows for g in grams_of(text)))


def test_copies_are_counted_once(make, words, odd):
    rows = [(r[0], r[1], r[2]) for r in odd] * 2 + [(i, words(i % 7, 20), "en" if i % 2 else "de") for i in range(60)]
    got = {(r.lang, r.gram): r.n for r in perplexity.count_distinct(make(rows, 5)).collect()}
    assert got == dict(Counter((lang, g) for text, lang in {(r[1], r[2]) for r in rows} for g in grams_of(text)))


def brute_model(counts):
    """Interpolated modified Kneser-Ney over a Counter of n-grams: n-gram -> probability, from the definition."""
    levels = [counts]
    for _ in range(perplexity.ORDER - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    below = {}
    for level in levels:
        n = [sum(c == k for c in level.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        cut = [0.5, 0.75, 0.9] if min(n[1:]) == 0 else [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, mass = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[min(c, 3) - 1]
        below = {g: max(c - cut[min(c, 3) - 1], 0) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * (below[g[1:]] if below else 1 / len(level)) for g, c in level.items()}
    return below


@pytest.mark.parametrize("lang", [None, "en"])
def test_kneser_ney_against_its_definition(make, words, lang):
    rows = [(i, words(i, 60, 30), lang) for i in range(20)]
    got = {r.gram: r.log2p for r in perplexity.kneser_ney(perplexity.count_ngrams(make(rows))).collect()}
    counts = Counter(g for _, text, _ in rows for g in grams_of(text))
    want = brute_model(counts)
    assert got.keys() == want.keys() and all(math.isclose(2 ** got[g], want[g], rel_tol=1e-9) for g in want)
    by_context = Counter()
    for g, p in want.items():
        by_context[g[:-1]] += p
    assert all(0 < p <= 1 + 1e-9 for p in by_context.values())  # what unseen n-grams of a context would have is the rest


def test_verdicts_against_the_definition(make, words):
    """Bits, band and verdict of every row, worked out text by text."""
    rng = random.Random(9)
    rows = [(i, words(i % 40, 60 + i % 40 * 3, 50), "en" if i % 3 else "el") for i in range(120)]
    rows += [(200, " ".join("".join(rng.choice("xyzqj") for _ in range(7)) for _ in range(80)), "en"), (201, words(3, 10), "en"), (202, None, None)]
    got = {r.doc_id: r for r in perplexity.judge(make(rows)).collect()}
    bits, spread, length = {}, {}, {}
    for lang in ("en", "el", None):
        texts = {t for _, t, x in rows if x == lang}
        model = brute_model(Counter(g for t in texts for g in grams_of(t)))
        for t in texts:
            b = [-math.log2(model[g]) for g in grams_of(t)]
            bits[lang, t], spread[lang, t], length[lang, t] = sum(b) / len(b), float(np.std(b)), len(b)
    failed = {(lang, t): brute_base(t)[0] < 50 or 100 * brute_base(t)[4] > 50 * brute_base(t)[0] for _, t, lang in rows}

    def median(values, step):
        """The middle of the bin that holds the (upper) median."""
        bins = sorted(math.floor(v / step) for v in values)
        return (bins[(len(bins) + 1) // 2 - 1] + 0.5) * step

    for lang in ("en", "el"):
        good = [k for k in bits if k[0] == lang and not failed[k]]
        mid = median([bits[k] for k in good], 1e-4)
        scale = {k: math.sqrt(1 / (1 / 4000 + 1 / length[k])) for k in bits}
        off = {k: (bits[k] - mid) * scale[k] for k in good}
        least = median([spread[k] for k in good], 1e-3) * perplexity.LEAST_SHARE
        sides = [max(1.4826 * median([s * d for d in off.values() if s * d >= 0], 1e-3), least) for s in (-1, 1)]
        for i, t, x in rows:
            if x != lang:
                continue
            r, k = got[i], (lang, t)
            low, high = (mid + s * perplexity.SPREADS * side / scale[k] for s, side in zip((-1, 1), sides, strict=True))
            assert math.isclose(r.bits, bits[k], rel_tol=1e-5) and math.isclose(r.low, low, abs_tol=2e-3) and math.isclose(r.high, high, abs_tol=2e-3)
            assert r.base_failed == failed[k]
            if min(abs(bits[k] - low), abs(bits[k] - high)) > 3e-3:
                assert r.kept == (not failed[k] and low <= bits[k] <= high)
    assert not got[200].kept and got[201].base_failed and got[202].base_failed


@pytest.mark.parametrize("script", ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会"])
def test_scripts(make, script):
    """Text of another script is judged by its own letters: a scrambled one leaves the band of ordered ones."""
    rng = random.Random(len(script))
    syllables = [a + b for a in script[:14] for b in script[14:20]][:40]
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(80, 300)))
    mixed = lambda: " ".join("".join(rng.choices(script, k=5)) for _ in range(150))
    rows = [(i, prose(), "x") for i in range(150)] + [(500, mixed(), "x")]
    got = {r.doc_id: r.kept for r in perplexity.judge(make(rows)).collect()}
    assert not got[500] and sum(got[i] for i in range(150)) >= 145


def test_languages_in_blocks(make, words, monkeypatch):
    rows = [(i, words(i, 80), "en" if i % 2 else "de", None) for i in range(30)]
    whole = sorted(map(tuple, perplexity.judge(make(rows)).collect()))
    monkeypatch.setattr(perplexity, "MODEL_ENTRIES", 10)
    assert sorted(map(tuple, perplexity.judge(make(rows)).collect())) == whole


def test_odd_texts_leave_the_band(make):
    rng = random.Random(2)
    syllables = ["ba", "ke", "lo", "mi", "nu", "sa", "ti"]
    prose = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60, 300)))
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(120))
    rows = [(i, prose(), "en", None) for i in range(150)] + [(999, noise, "en", None)]
    got = {r.doc_id: r for r in perplexity.judge(make(rows)).collect()}
    assert not got[999].kept
    assert sum(r.kept for i, r in got.items() if i < 900 and not r.base_failed) >= 0.98 * sum(not r.base_failed for i, r in got.items() if i < 900)


@pytest.mark.parametrize("copies", [150, 300])
def test_copies_that_hold_half_of_a_language(make, copies):
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda: " ".join(rng.choices(lexicon, k=rng.randrange(150, 400)))
    hot = prose()
    rows = [(i, prose(), "en", None) for i in range(150)] + [(1000 + i, hot, "en", None) for i in range(copies)]
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(200))
    got = {r.doc_id: r for r in perplexity.judge(make([*rows, (9999, noise, "en", None)])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(150)) >= 147
    assert all(got[1000 + i].kept for i in range(copies)) and not got[9999].kept


@pytest.mark.parametrize("seed", range(5))
def test_marginals_against_all_labellings(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, 4)
    bounds = np.append(0, np.cumsum(sizes))
    energy, moves = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    marginal, pairs = linecrf.forward_backward(energy, bounds, moves, pairs=True)
    for d, (a, b) in enumerate(itertools.pairwise(bounds)):
        z, one, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = math.exp(sum(energy[a + i] for i in range(b - a) if y[i]) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1)))
            z += p
            one += p * np.array(y)
            for i in range(b - a - 1):
                joint[y[i], y[i + 1]] += p
        assert np.allclose(marginal[a:b], one / z) and np.allclose(pairs[d], joint / z)


def test_classifier_on_held_out_rows(spark, make, words):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.7
        lines = [words(rng.random(), rng.randrange(4, 12)) + ("." if good else " $$$ |") for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "x")]
    labels += [(None, 1), (3, None), (7777, 0)]
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in linecrf.classify(docs, linecrf.train(docs, table)).collect()}
    assert len(got) == len(rows)
    truth = dict(labels[:240])
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert linecrf.classify(make([]), linecrf.fit([], [])).count() == 0
    alone = linecrf.classify(docs, linecrf.train(docs, table.where("quality = 1")))
    assert len({r.score for r in alone.collect()}) == 1
    kept = linecrf.keep_good(docs, linecrf.train(docs, table))
    assert kept.columns == docs.columns and 100 < kept.count() < len(rows)


def test_long_texts_in_segments_and_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["\n".join("aB 1.,x"[: rng.integers(0, 8)] * int(rng.integers(0, 3)) for _ in range(n)) for n in (1, 40, 7, 700, 3)] + [None, ""]
    (_, data, offsets), = linecrf.groups(pa.array(texts))
    weights, moves = rng.normal(size=linecrf.FEATURES), rng.normal(size=(2, 2))
    x, _, bounds = linecrf.line_features(data, offsets)
    whole = linecrf.forward_backward(x @ weights, bounds, moves, pairs=True)
    monkeypatch.setattr(linecrf, "SEGMENT", 5)
    monkeypatch.setattr(linecrf, "BLOCK_LINES", 11)
    energy, _, again = linecrf.line_energies(data, offsets, weights)
    assert (again == bounds).all() and np.allclose(energy, x @ weights) and np.allclose(linecrf.line_features(data, offsets)[0], x)
    parts = linecrf.forward_backward(energy, bounds, moves, pairs=True)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


@pytest.mark.parametrize("text", ["\n" * 1_000_000, "a b\n" * 250_000, "x" * 1_000_000])
def test_degenerate_texts_take_bounded_memory(text):
    rng = np.random.default_rng(5)
    crf = linecrf.Crf(rng.normal(size=linecrf.FEATURES) * 0.1, rng.normal(size=(2, 2)), (1.0, 0.0), 0.5)
    column = pa.array([text])
    textkernel.forget()
    tracemalloc.start()
    began = time.perf_counter()
    score = linecrf.predict(column, crf)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 100e6 and took < 20


def test_the_sample_is_bounded(make, words, monkeypatch):
    rows = [(i, words(i, 30) if i % 3 else "\n" * 5000) for i in range(60)]
    labels = make([]).sparkSession.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    seen, plain = [], linecrf.fit
    monkeypatch.setattr(linecrf, "fit", lambda texts, y: seen.append((texts, y)) or plain(texts, y))
    monkeypatch.setattr(linecrf, "TRAIN_BYTES", 2000)
    linecrf.train(make(rows), labels)
    texts, y = seen[0]
    assert 0 < len(texts) < 40 and sum(len(t) + 400 * t.count("\n") for t in texts) <= 2000 and set(y) == {1}


def tokens_of(text):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    return [*WORD.findall((text or "").translate(lower)), None]


def brute_scores(rows):
    seen = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10:
            seen.update(tokens_of(text))
    n, v = sum(seen.values()), len(seen)
    out = []
    for doc_id, text in rows:
        t = tokens_of(text)
        out.append((doc_id, len(t), sum(seen[x] > 0 for x in t), n, round(sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)))
    return sorted(out, key=repr)


def test_language_model(make, words, odd):
    rows = [(r[0], r[1]) for r in odd] + [(100 + i, f"{'x y z ' * 12}{words(i, 40, 60)}".title()) for i in range(150)]
    got = grulm.score_documents(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute_scores(rows)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert grulm.score_documents(make([])).count() == 0


def small():
    lexicon = grulm.Lexicon(np.sort(np.arange(1, 71, dtype=np.uint64) << np.uint64(40)), np.arange(70), np.arange(70, 0, -1), np.full(64, 3), np.full(64, 2), 5000, 200)
    return lexicon, grulm.Gru(lexicon, hidden=4)


def test_all_training_texts_are_learned_from(spark, make, words, monkeypatch, tmp_path):
    rows = [(i, words(i, 7 + i % 90, 200)) for i in range(400)]
    lexicon, _ = small()
    plain = grulm.Gru.learn

    def learn(self, codes, fresh, streams, *rest):
        with open(tmp_path / f"{os.getpid()}.txt", "a") as f:
            f.write(f"{len(codes) // streams * streams} {int(fresh.sum())}\n")
        return plain(self, codes, fresh, streams, *rest)

    tune = grulm._tune

    def counted(batches, sent, streams):
        grulm.Gru.learn = learn
        try:
            yield from tune(batches, sent, streams)
        finally:
            grulm.Gru.learn = plain

    monkeypatch.setattr(grulm, "_tune", counted)
    grulm.train(make(rows).selectExpr("doc_id AS id", "text"), lexicon, shard_tokens=500)
    mine = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    figures = [tuple(map(int, line.split())) for path in tmp_path.glob("*.txt") for line in path.read_text().splitlines()]
    assert sum(n for n, _ in figures) == sum(len(tokens_of(t)) for t in mine)
    assert sum(n for _, n in figures) == len(mine)


def test_scores_do_not_depend_on_partitions(make, words, odd):
    rows = [(r[0], r[1]) for r in odd] + [(100 + i, words(i, 5 + i % 200, 300)) for i in range(120)]
    runs = [{(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in grulm.score_documents(make(rows, n), hidden=8, shard_tokens=900).collect()} for n in (2, 7)]
    assert runs[0].keys() == runs[1].keys() and len(grulm.Rounds.of(15_000, 900).shards) == 4 and max(grulm.Rounds.of(15_000, 900).shards) > grulm.FAN
    assert all(math.isclose(runs[0][k], runs[1][k], rel_tol=1e-5) for k in runs[0])


def test_scores_against_loops(make, words, monkeypatch):
    """The trained network's scores, computed again unit by unit from its weights, the texts and the definition."""
    rows = [(i, words(i, 3 + i % 30, 90)) for i in range(60)] + [(200, None), (201, "never seen words")]
    train, kept = grulm.train, []
    monkeypatch.setattr(grulm, "train", lambda source, lexicon, *rest: kept.append((lexicon, train(source, lexicon, *rest))) or kept[0][1])
    got = {r.doc_id: r.score for r in grulm.score_documents(make(rows), hidden=5).collect()}
    lexicon, model = kept[0]
    seen = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 10 for t in tokens_of(text))
    X, U, Wc, bc, Wo, bo = (getattr(model, k).tolist() for k in model.NAMES)
    sigmoid = lambda a: 1 / (1 + math.exp(-a))

    def log_softmax(logits, k):
        return logits[k] - math.log(sum(map(math.exp, logits)))

    for doc_id, text in rows:
        (_, hashes, _) = next(grulm.tokens(pa.array([text], pa.string())))
        codes, state, before, total = lexicon.code(hashes).tolist(), [0.0] * 5, model.start, 0.0
        for token, code, ending in zip(tokens_of(text), codes, grulm.class_of(hashes).tolist(), strict=True):
            a = [sum(state[i] * U[i][j] for i in range(5)) for j in range(15)]
            z, r = ([sigmoid(X[before][k + j] + a[k + j]) for j in range(5)] for k in (0, 5))
            c = [math.tanh(X[before][10 + j] + r[j] * a[10 + j]) for j in range(5)]
            state = [(1 - z[j]) * c[j] + z[j] * state[j] for j in range(5)]
            head = code < model.heads * 64
            cls = code // 64 if head else model.heads + ending
            total += log_softmax([sum(state[i] * Wc[i][k] for i in range(5)) + bc[k] for k in range(model.heads + 64)], cls)
            if head:
                total += log_softmax([sum(state[i] * Wo[cls][i][k] for i in range(5)) + bo[cls][k] for k in range(64)], code % 64)
            else:
                total += math.log((seen[token] + 0.1) / (lexicon.rest_tokens[ending] + 0.1 * (lexicon.rest_types[ending] + 1)))
            before = code
        assert math.isclose(got[doc_id], total / math.log(10), rel_tol=1e-4)


def test_outputs_are_a_distribution():
    _, model = small()
    state = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    codes = np.append(np.arange(70), np.arange(64) + model.heads * grulm.CLASS_WORDS)
    ln, _ = model.outputs(np.repeat(state, len(codes), 0), codes)
    assert math.isclose(np.exp(ln).sum(), 1, abs_tol=1e-4)


def test_softmaxes_go_by_blocks(monkeypatch):
    """Some rows at a time give what all at once give, and never hold the logits of all."""
    rng = np.random.default_rng(4)
    _, model = small()
    codes = rng.integers(0, 70, 20_000).astype(np.int32)
    codes[::3] = model.heads * grulm.CLASS_WORDS + rng.integers(0, 64, len(codes[::3]))
    states = np.tanh(rng.normal(size=(len(codes), 4))).astype(np.float32)
    runs = []
    for size in (len(codes), 512, 7):
        monkeypatch.setattr(grulm, "BLOCK", size)
        grads = {}
        runs.append((*model.outputs(states[:3000], codes[:3000], grads), *(grads[k] for k in ("Wc", "bc", "Wo", "bo"))))
    for run in runs[1:]:
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(runs[0], run, strict=True))
    monkeypatch.setattr(grulm, "BLOCK", 512)
    tracemalloc.start()
    model.outputs(states, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(codes) * (model.heads + grulm.ENDINGS) * 4


def test_state_is_carried_through_whole_texts():
    _, model = small()
    rng = np.random.default_rng(1)
    sizes = [200, 1, 90, 33]
    codes = rng.integers(0, 70, sum(sizes)).astype(np.int32)
    bounds = np.append(0, np.cumsum(sizes))
    together = model.log_likelihood(codes, bounds)
    for a, b in itertools.pairwise(bounds):
        state, before = np.zeros((1, 4), np.float32), np.array([model.start])
        for t in range(a, b):
            state = model.step(model.X[before], state)[0]
            before = codes[t : t + 1]
            assert math.isclose(model.outputs(state, before)[0][0], together[t], abs_tol=1e-4)


def test_gradients(monkeypatch):
    _, model = small()
    rng = np.random.default_rng(2)
    for k in model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    codes = rng.integers(0, 70, 24).astype(np.int32)
    fresh = np.zeros(24, bool)
    fresh[[0, 9]] = True
    grads = {}
    monkeypatch.setattr(model, "_ascend", lambda name, where, grad, *_: grads.__setitem__(name, (where, grad.copy())))
    model.learn(codes, fresh, 1, {})
    bounds = np.array([0, 9, 24])
    for name, place in [("U", (1, 2)), ("U", (0, 9)), ("Wc", (2, 1)), ("bc", (0,)), ("Wo", (0, 1, int(codes[3]) % 64)), ("X", (model.start, 5)), ("X", (int(codes[4]), 0))]:
        table = getattr(model, name)
        old, step, values = table[place], 1e-4, []
        for sign in (1, -1):
            table[place] = old + sign * step
            values.append(model.log_likelihood(codes, bounds).sum())
        table[place] = old
        where, grad = grads[name]
        own = grad[place] if not isinstance(where, np.ndarray) else grad[np.searchsorted(where, place[0]), place[1]]
        assert math.isclose((values[0] - values[1]) / (2 * step), own, rel_tol=0.03, abs_tol=0.03), name


def test_tokens_of_batches():
    column = pa.array(["Ab cd\tAB", None, "", "é Z"])
    out = [(h.tolist(), b.tolist()) for _, h, b in grulm.tokens(column)]
    (hashes, bounds), = out
    assert bounds == [0, 4, 5, 6, 9] and hashes[0] == hashes[2] and hashes[3] == hashes[4] == int(grulm.END_HASH)
