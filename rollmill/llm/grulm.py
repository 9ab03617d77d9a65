"""Scoring by a gated recurrent language model.

Tokens are words in ASCII lower case, and an end token closes each text. The HEAD most frequent
training tokens have inputs and outputs of their own; all others are told apart by the class of
their ending. The output is factored: a softmax over classes (runs of head words in the order of
frequency, and the ending classes), times a softmax over a head class's words, or, in an ending
class, the smoothed share of the token's count, with one place for all unknown tokens.

1. Chunks of rows send the distinct tokens they hold, with training counts, to buckets of hashes;
   the buckets add up and answer each chunk, which gives every token's count over all training
   documents without a table of the vocabulary in any one place.
2. The network starts from the unigram model and learns by truncated backpropagation through time
   with Adagrad, once from every training text and to its last token. Hashes of id and text deal the
   texts into rounds that grow by four, and a round's texts into shards of about SHARD_TOKENS; the
   shards learn side by side, each in the order of the hashes, from where the last round ended, and
   their weights, averaged by tokens in a fixed order, begin the next. Neither partitions nor the
   order of the input matter. Rows equal in id and text go to one shard, which streams them.
3. Each chunk, joined with its answers, is scored with all its documents side by side, in windows
   whose last state begins the next, so a document's log-likelihood is that of all of it.

Nulls count as empty texts, which consist of the end token alone. Null ids belong to the fold of
the empty string. Repeated rows are learned from and scored row by row. An empty table gives an
empty result; without training tokens every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.chunks import PACKED, chunked, digest, pack, unpack
from rollmill.llm.cluster import buckets_for, checkpointed, id_fold, shuffle_partitions, text_bytes
from rollmill.llm.textkernel import BYTE_BASE, SPACE, _BYTE_VALUE, groups, mix, places, span_hashes, spans
from rollmill.llm.tidy import one_thread, release, tidy

FOLDS = 10
HIDDEN = 20
HEAD, CLASS_WORDS, ENDINGS = 2048, 64, 64
WINDOW = 32
#: Training texts are dealt into PARTS by hash; a round learns from the parts up to its end, in shards of about so many tokens.
PARTS, ROUND_ENDS, SHARD_TOKENS = 64, (1, 4, 16, 64), 1 << 22
#: Parallel streams of a shard in each round, tokens of a stream before the shard is cut anew, and shards whose weights one task adds up.
STREAMS, STREAM_TOKENS, FAN = (24, 96, 192, 384), 2048, 8
RATE = 0.25
#: Rows that go through a softmax at once, whose logits then stay near the processor.
BLOCK = 512
#: Bytes of text whose tokens are told at once.
GROUP_BYTES = 1 << 18
CHUNK = {"max_rows": 1 << 16, "max_bytes": 8 << 20}
ALPHA = 0.1
#: The ending class is the tail of a token's hash.
CLASS_MASK = np.uint64(63)
#: Hash of the end token, of class 0.
END_HASH = np.uint64(0x1D << 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & CLASS_MASK).astype(np.int32)


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, bounds) of groups of texts, end tokens included."""
    for rows, data, offsets in groups(column, GROUP_BYTES):
        data = _LOWER[data]
        starts, ends = spans(data, offsets, SPACE[data])
        hashes = span_hashes(_BYTE_VALUE[data], BYTE_BASE, starts, ends)
        tail = mix(data[ends - 1].astype(np.uint64) << np.uint64(16) | np.where(ends - 2 >= starts, data[ends - 2], 0).astype(np.uint64) << np.uint64(8) | np.minimum(ends - starts, 9).astype(np.uint64) // np.uint64(3)) if len(starts) else np.zeros(0, np.uint64)
        count = np.diff(np.searchsorted(starts, offsets))
        bounds = np.append(0, np.cumsum(count + 1))
        all_hashes = np.full(bounds[-1], END_HASH)
        words = np.ones(bounds[-1], bool)
        words[bounds[1:] - 1] = False
        all_hashes[words] = hashes & ~CLASS_MASK | tail % np.uint64(ENDINGS)
        yield rows, all_hashes, bounds


@dataclass
class Lexicon:
    """Head tokens by hash and rank, and what the ending classes hold besides."""

    hashes: np.ndarray  # sorted
    rank: np.ndarray
    head_counts: np.ndarray  # by rank
    rest_tokens: np.ndarray  # by ending class
    rest_types: np.ndarray
    n_tokens: int
    n_types: int

    @property
    def head_classes(self) -> int:
        return -(-len(self.hashes) // CLASS_WORDS)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of a head token, or the number of head places plus the ending class."""
        out = self.head_classes * CLASS_WORDS + class_of(hashes)
        if len(self.hashes):
            at = places(self.hashes, hashes)
            return np.where(self.hashes[at] == hashes, self.rank[at], out).astype(np.int32)
        return out


class Gru:
    """The network's weights and its forward and backward passes."""

    NAMES = ("X", "U", "Wc", "bc", "Wo", "bo")

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h, self.heads = hidden, lexicon.head_classes
        heads = self.heads * CLASS_WORDS
        self.start = heads + ENDINGS
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.X, self.U = draw(self.start + 1, 3 * hidden), draw(hidden, 3 * hidden)
        self.Wc, self.Wo = draw(hidden, self.heads + ENDINGS), draw(self.heads, hidden, CLASS_WORDS)
        counts = np.zeros(heads)
        counts[: len(lexicon.head_counts)] = lexicon.head_counts
        by_class = counts.reshape(self.heads, CLASS_WORDS)
        self.bo = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / np.maximum(by_class.max(1, keepdims=True), 1e-9)), -60).astype(np.float32)
        total = np.append(by_class.sum(1), lexicon.rest_tokens + ALPHA * (lexicon.rest_types + 1))
        self.bc = np.log(np.maximum(total, 1e-9) / max(total.sum(), 1e-9)).astype(np.float32)

    def all(self, memory: dict[str, np.ndarray]) -> np.ndarray:
        """The weights and what the optimiser remembers of each, in one run."""
        return np.concatenate([x.ravel() for k in self.NAMES for x in (getattr(self, k), memory.get(k, np.ones_like(getattr(self, k))))])

    def load_all(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Takes the weights from such a run; gives back the memory."""
        at, memory = 0, {}
        for k in self.NAMES:
            old = getattr(self, k)
            new, memory[k] = (flat[at + i * old.size : at + (i + 1) * old.size].reshape(old.shape).astype(np.float32) for i in range(2))
            setattr(self, k, new)
            at += 2 * old.size
        return memory

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what the way back needs: update and reset gates, candidate, and its recurrent part.

        Rows are texts, but the arrays are held unit by unit, so that each gate is one run of memory.
        """
        n, x = self.h, np.asfortranarray(x)
        a = (self.U.T @ h.T).T
        zr = x[:, : 2 * n] + a[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :n], zr[:, n:]
        c = r * a[:, 2 * n :]
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, a[:, 2 * n :]

    @staticmethod
    def _levels(weights: np.ndarray) -> np.ndarray:
        """Whether a row's greatest value must be taken away, as some row's may be too great or too small to exponentiate (states are within 1); the last weights are biases."""
        return np.abs(weights[..., :-1, :]).sum(-2).max(-1) + np.abs(weights[..., -1, :].max(-1)) > 60

    @staticmethod
    def _softmax(rows: np.ndarray, weights: np.ndarray, own: np.ndarray, level: bool, grad: np.ndarray | None, back: np.ndarray | None) -> np.ndarray:
        """ln P of each row's own place, some rows at a time; their gradients are added to ``grad`` (by weight) and ``back`` (by row)."""
        out, width = np.empty(len(rows), rows.dtype), weights.shape[1]
        ones, room = np.ones(width, rows.dtype), np.empty((min(BLOCK, len(rows)), width), rows.dtype)
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            logits = np.matmul(part, weights, out=room[: len(part)])
            if level:
                logits -= logits.max(1, keepdims=True)
            flat, at = logits.ravel(), np.arange(0, logits.size, width)
            at += own[a : a + BLOCK]
            mine = flat.take(at)
            np.exp(logits, out=logits)
            total = logits @ ones
            out[a : a + BLOCK] = mine - np.log(total)
            if grad is not None:
                flat[at] -= total  # now -total times the gradient
                share = (1 / total)[:, None]
                grad -= (logits.T @ (part * share)).T
                back[a : a + BLOCK] -= (logits @ weights[:-1].T) * share
        return out

    def outputs(self, states: np.ndarray, codes: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of the class, and of the word in a head class; with ``grads``, also the gradient by state."""
        words, n = self.heads * CLASS_WORDS, self.h
        cls = np.where(codes < words, codes // CLASS_WORDS, codes - words + self.heads)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(cls, minlength=self.heads)[: self.heads])).tolist()
        cls, codes = cls[order], codes[order]
        rows = np.ones((len(order), n + 1), np.result_type(states, self.Wc))  # the last place is the biases'
        rows[:, :n] = states.take(order, axis=0)
        by_class, by_word = np.concatenate([self.Wc, self.bc[None]]), np.concatenate([self.Wo, self.bo[:, None]], 1)
        back, grad, word_grads = None, None, [None] * self.heads
        if grads is not None:
            back, grad, word_grads = np.zeros((len(order), n), rows.dtype), np.zeros_like(by_class), np.zeros_like(by_word)
            grads["Wc"], grads["bc"], grads["Wo"], grads["bo"] = grad[:n], grad[n], word_grads[:, :n], word_grads[:, n]
        out = self._softmax(rows, by_class, cls, self._levels(by_class), grad, back)
        levels = self._levels(by_word)
        for k in range(self.heads):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                out[a:b] += self._softmax(rows[a:b], by_word[k], codes[a:b] - k * CLASS_WORDS, levels[k], word_grads[k], None if back is None else back[a:b])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return out[place], None if back is None else back.take(place, axis=0)

    def learn(self, codes: np.ndarray, fresh: np.ndarray, streams: int, memory: dict[str, np.ndarray], rate: float = RATE) -> None:
        """Truncated backpropagation over one long run of tokens (fresh: the first of a text), cut into streams."""
        length = len(codes) // streams
        if not length:
            return
        codes, fresh = codes[: length * streams].reshape(streams, length).T, fresh[: length * streams].reshape(streams, length).T
        before = np.empty(codes.shape, np.int64)
        before[1:], before[0] = codes[:-1], self.start
        before[fresh] = self.start
        goes_on = (~fresh).astype(np.float32)
        n = self.h
        state = np.zeros((n, streams), np.float32)  # units by streams, as all that follows
        for t0 in range(0, length, WINDOW):
            t1 = min(t0 + WINDOW, length)
            trace, states = [], np.empty((t1 - t0, streams, n), np.float32)
            for t in range(t0, t1):
                old = state * goes_on[t]
                new, *gates = self.step(self.X.take(before[t], axis=0), old.T)
                state = new.T
                trace.append((old, *(x.T for x in gates)))
                states[t - t0] = new
            grads: dict[str, np.ndarray] = {}
            _, back = self.outputs(states.reshape(-1, n), codes[t0:t1].ravel(), grads)
            back = back.reshape(states.shape)
            dx = np.empty((3 * n, t1 - t0, streams), np.float32)
            dU = np.zeros_like(self.U)
            dh = np.zeros((n, streams), np.float32)
            da = np.empty((3 * n, streams), dU.dtype)
            for t in range(t1 - 1, t0 - 1, -1):
                old, z, r, c, un = trace[t - t0]
                dh = dh + back[t - t0].T
                rest = 1 - z
                dc = dh * rest
                dc *= 1 - c * c
                dz = old - c
                dz *= dh
                dz *= z
                np.multiply(dz, rest, out=da[:n])
                np.multiply(dc, r, out=da[2 * n :])
                dr = da[2 * n :] * un
                np.multiply(dr, 1 - r, out=da[n : 2 * n])
                dx[: 2 * n, t - t0], dx[2 * n :, t - t0] = da[: 2 * n], dc
                dU += (da @ old.T).T
                dh *= z
                dh += self.U @ da
                dh *= goes_on[t]
            grads["U"] = dU
            at = before[t0:t1].ravel()
            order = np.argsort(at.astype(np.uint16) if self.start < 1 << 16 else at, kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            rows = np.ascontiguousarray(np.add.reduceat(dx.reshape(3 * n, -1).take(order, axis=1), cuts, axis=1).T)
            for k in ("U", "Wc", "bc", "Wo", "bo"):
                self._ascend(k, slice(None), grads[k], memory, rate)
            self._ascend("X", at[cuts], rows, memory, rate)

    def _ascend(self, name: str, where, grad: np.ndarray, memory: dict[str, np.ndarray], rate: float) -> None:
        seen = memory.setdefault(name, np.full_like(getattr(self, name), 1.0))
        np.clip(grad, -20, 20, out=grad)
        seen[where] += grad * grad
        getattr(self, name)[where] += rate * grad / np.sqrt(seen[where])

    def log_likelihood(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """ln P of each token (of its class, and of its word in a head class), all texts side by side."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        start, sizes = bounds[:-1][order], sizes[order]
        out = np.empty(len(codes), np.float64)
        state = np.zeros((self.h, len(sizes)), np.float32).T
        before = np.full(len(sizes), self.start, np.int32)
        held, at, rows = [], [], 0
        longer = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left").tolist()
        for t, n in enumerate(longer):  # texts longer than t
            state, before = state[:n], before[:n]
            state = self.step(self.X.take(before, axis=0), state)[0]
            here = start[:n] + t
            held.append(state)
            at.append(here)
            before = codes[here]
            rows += n
            if rows >= 1 << 15:
                where = np.concatenate(at)
                out[where] = self.outputs(np.concatenate(held), codes[where])[0]
                held, at, rows = [], [], 0
        if rows:
            where = np.concatenate(at)
            out[where] = self.outputs(np.concatenate(held), codes[where])[0]
        return out


def _fold(ids: list) -> np.ndarray:
    import zlib
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids], np.int64)


REQUEST = "bucket long, chunk long, digest long, hashes binary, counts binary"
ANSWER = "kind int, chunk long, digest long, hashes binary, counts binary, n long, v long, c int"


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    ordered = np.sort(hashes)
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[cuts], np.diff(np.append(cuts, len(ordered)))


@tidy
def _ask(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    for chunk, ids, texts in chunked(batches, **CHUNK):
        parts = []
        train = _fold(ids) != 0
        for rows, hashes, bounds in tokens(pa.array(texts, pa.large_string())):
            own = np.repeat(train[rows], np.diff(bounds))
            parts.append((hashes[own], hashes[~own]))
        (hashes, counts), (others, _) = (_runs(np.concatenate(some)) for some in zip(*parts, strict=True))
        hashes, counts = np.append(hashes, others), np.append(counts, np.zeros(len(others), np.int64))
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        counts, hashes = np.add.reduceat(counts, new), hashes[new]
        bucket = (hashes >> np.uint64(64 - bucket_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(hashes))
        same = np.full(len(cuts), chunk, np.int64)
        mark = np.full(len(cuts), digest(ids, texts), np.int64)
        blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (hashes, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(same), pa.array(mark), *blobs], names=["bucket", "chunk", "digest", "hashes", "counts"])


def _answer(table: pa.Table, tops: int) -> pa.Table:
    blobs = [x.as_py() for x in table["hashes"]]
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), np.int64)
    values, where = np.unique(hashes, return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(values)).astype(np.int64)
    cls = class_of(values)
    cuts = np.append(0, np.cumsum([len(b) // 8 for b in blobs]))
    every = total[where]
    replies = [(0, c, d, b, every[x:y].tobytes(), 0, 0, 0) for c, d, b, x, y in zip(table["chunk"].to_pylist(), table["digest"].to_pylist(), blobs, cuts[:-1], cuts[1:], strict=True)]
    n, v = np.bincount(cls, weights=total, minlength=ENDINGS), np.bincount(cls[total > 0], minlength=ENDINGS)
    sums = [(1, 0, 0, None, None, int(n[k]), int(v[k]), k) for k in range(ENDINGS) if v[k]]
    best = np.lexsort((values, -total))[:tops]
    words = [(2, int(values[k].view(np.int64)), 0, None, None, int(total[k]), 0, int(cls[k])) for k in best if total[k] > 0]
    names = ["kind", "chunk", "digest", "hashes", "counts", "n", "v", "c"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    return pa.table({k: pa.array(x, t) for k, x, t in zip(names, zip(*(replies + sums + words), strict=True), kinds, strict=True)})


def lexicon_of(answers: DataFrame) -> Lexicon:
    head = answers.where("kind = 2").orderBy(F.desc("n"), "chunk").limit(HEAD).select("chunk", "n", "c").collect()
    rest = np.zeros((2, ENDINGS), np.int64)
    for c, n, v in answers.where("kind = 1").groupBy("c").agg(F.sum("n"), F.sum("v")).collect():
        rest[:, c] = n, v
    total = rest.sum(1)
    hashes = np.array([r["chunk"] for r in head], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in head], np.int64)
    for r in head:
        rest[:, r["c"]] -= r["n"], 1
    order = np.argsort(hashes, kind="stable")
    return Lexicon(hashes[order], order.astype(np.int64), counts, rest[0], rest[1], int(total[0]), int(total[1]))


ENCODED = "round int, shard int, place long, codes binary"
LEARNED = "shard int, n long, w binary"


@dataclass(frozen=True)
class Rounds:
    """How training texts are dealt out, by the hash of id and text and the number of training tokens alone."""

    shards: tuple[int, ...]

    @staticmethod
    def of(n_tokens: int, shard_tokens: int) -> Rounds:
        cuts = (0, *ROUND_ENDS)
        return Rounds(tuple(max(1, -(-n_tokens * (b - a) // (PARTS * shard_tokens))) for a, b in itertools.pairwise(cuts)))

    def deal(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(round, shard) of texts by their hashes."""
        spread = mix(place.view(np.uint64))
        turn = np.searchsorted(ROUND_ENDS, (spread % np.uint64(PARTS)).astype(np.int64), "right")
        return turn.astype(np.int32), (spread // np.uint64(PARTS) % np.array(self.shards, np.uint64)[turn]).astype(np.int32)


@tidy
def _encode(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """One row for each training text: its tokens' codes, and where they are learned."""
    lexicon, rounds = sent.value
    kind = np.uint16 if lexicon.head_classes * CLASS_WORDS + ENDINGS < 1 << 16 else np.uint32
    for batch in batches:
        order = batch.column("place").to_numpy()
        for rows, hashes, bounds in tokens(batch.column("text")):
            codes = lexicon.code(hashes).astype(kind)
            turn, shard = rounds.deal(order[rows])
            blobs = pa.array([codes[a:b].tobytes() for a, b in itertools.pairwise(bounds)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(turn), pa.array(shard), pa.array(order[rows]), blobs], names=["round", "shard", "place", "codes"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(shard, its texts' codes as a stream) of rows sorted by shard."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            yield from zip(batch.column("shard").to_pylist(), batch.column("codes").to_pylist(), strict=True)

    for shard, part in itertools.groupby(rows(), lambda row: row[0]):
        yield shard, (row[1] for row in part)


def learn_shard(model: Gru, texts: Iterator[np.ndarray], streams: int, memory: dict[str, np.ndarray], rate: float = RATE) -> int:
    """Learns from all tokens of texts, one after the other; gives back how many they were.

    Tokens are cut into parallel streams of one length; those that are left over begin the next cut,
    and the last few are a stream of their own.
    """
    seen, held, size = 0, [], 0

    def learn(streams: int) -> None:
        nonlocal held, size
        codes, fresh = map(np.concatenate, zip(*held, strict=True))
        whole = len(codes) // streams * streams
        model.learn(codes[:whole], fresh[:whole], streams, memory, rate)
        held, size = ([(codes[whole:], fresh[whole:])] if whole < len(codes) else []), len(codes) - whole

    for codes in texts:
        fresh = np.zeros(len(codes), bool)
        fresh[:1] = True
        held.append((codes, fresh))
        size, seen = size + len(codes), seen + len(codes)
        if size >= streams * STREAM_TOKENS:
            learn(streams)
    if size:
        learn(min(streams, max(1, size // (4 * WINDOW))))
    if size:
        learn(1)
    return seen


@tidy
def _tune(batches: Iterator[pa.RecordBatch], sent, streams: int) -> Iterator[pa.RecordBatch]:
    """The weights and the optimiser's memory after each shard, and the shard's tokens."""
    lexicon, hidden, flat = sent.value
    kind = np.uint16 if lexicon.head_classes * CLASS_WORDS + ENDINGS < 1 << 16 else np.uint32
    for shard, blobs in _shards(batches):
        model = Gru(lexicon, hidden)
        memory = model.load_all(flat)
        seen = learn_shard(model, (np.frombuffer(blob, kind).astype(np.int32) for blob in blobs), streams, memory)
        if seen:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [seen], "w": [model.all(memory).tobytes()]})


def _mean(parts: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens and mean weights of (shard, tokens, weights), added up in the order of shards, so that they round alike wherever they come from."""
    n, total = 0, 0.0
    for _, k, w in sorted(parts):
        n, total = n + k, total + np.frombuffer(w, np.float32).astype(np.float64) * k
    return n, (total / n).astype(np.float32)


def _added(table: pa.Table) -> pa.Table:
    """The mean of up to FAN shards."""
    n, mean = _mean([tuple(row.values()) for row in table.select(["shard", "n", "w"]).to_pylist()])
    return pa.table({"shard": pa.array([table["shard"][0].as_py() // FAN], pa.int32()), "n": [n], "w": [mean.tobytes()]})


def train(source: DataFrame, lexicon: Lexicon, hidden: int = HIDDEN, shard_tokens: int = SHARD_TOKENS) -> Gru:
    """``source``: id and text; learns once from every row outside the held-out fold."""
    model = Gru(lexicon, hidden)
    flat = model.all({})
    context = source.sparkSession.sparkContext
    rounds = Rounds.of(lexicon.n_tokens, shard_tokens)
    learned = source.where(id_fold(F.col("id"), FOLDS) != 0).select("text", F.xxhash64("id", "text").alias("place"))
    sent = context.broadcast((lexicon, rounds))
    encoded = checkpointed(learned.mapInArrow(partial(_encode, sent=sent), ENCODED))
    for turn, shards in enumerate(rounds.shards):
        weights = context.broadcast((lexicon, hidden, flat))
        mine = encoded.where(F.col("round") == turn).select("shard", "place", "codes")
        dealt = mine.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "codes")
        tuned = dealt.mapInArrow(partial(_tune, sent=weights, streams=STREAMS[turn]), LEARNED)
        while shards > FAN:
            tuned, shards = tuned.groupBy(F.floor(F.col("shard") / FAN)).applyInArrow(_added, LEARNED), -(-shards // FAN)
        rows = [tuple(row) for row in tuned.collect()]  # at most FAN
        if rows:
            _, flat = _mean(rows)
    model.load_all(flat)
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hidden: int = HIDDEN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    hidden: units of the network; shard_tokens: training tokens that one task learns from in a round.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bucket_bits = max(1, (buckets_for(spark, text_bytes(docs, text_col) // 2) - 1).bit_length())
    tops = HEAD // (1 << bucket_bits) + 12 * int((HEAD / (1 << bucket_bits)) ** 0.5 + 1) + 16
    answers = checkpointed(source.mapInArrow(partial(_ask, bucket_bits=bucket_bits), REQUEST).groupBy("bucket").applyInArrow(lambda table: _answer(table, tops), ANSWER))
    lexicon = lexicon_of(answers)
    model = train(source, lexicon, hidden, shard_tokens)
    sent = spark.sparkContext.broadcast((lexicon, model))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        one_thread()
        table = unpack(left, right["digest"].to_pylist())
        lexicon, model = sent.value
        known = np.frombuffer(b"".join(x.as_py() for x in right["hashes"]), np.uint64)
        counts = np.frombuffer(b"".join(x.as_py() for x in right["counts"]), np.int64)
        order = np.argsort(known, kind="stable")
        known, counts = known[order], counts[order]
        parts = list(tokens(table["text"]))
        hashes = np.concatenate([p[1] for p in parts])
        sizes = np.concatenate([np.diff(p[2]) for p in parts])
        bounds = np.append(0, np.cumsum(sizes))
        # what depends on the token alone is worked out once for each distinct token
        at = places(known, hashes)
        ending = class_of(known)
        total = lexicon.n_tokens + ALPHA * (lexicon.n_types + 1)
        base = np.log10((counts + ALPHA) / total)[at]
        code = lexicon.code(known)
        rest = lexicon.rest_tokens + ALPHA * (lexicon.rest_types + 1)
        within = np.where(code >= model.heads * CLASS_WORDS, np.log((counts + ALPHA) / rest[ending]), 0.0)
        ln = model.log_likelihood(code[at], bounds) + within[at]
        c = counts[at]
        add = lambda x: np.add.reduceat(x, bounds[:-1])
        out = [table["id"], pa.array(_fold(table["id"].to_pylist()) == 0), pa.array(sizes.astype(np.int64)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), lexicon.n_tokens, np.int64)), pa.array(add(base)), pa.array(add(ln) / np.log(10))]
        release()
        return pa.table(out, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    packed = source.mapInArrow(partial(pack, **CHUNK), PACKED)
    replies = answers.where("kind = 0").select("chunk", "digest", "hashes", "counts")
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rate, schema)



