"""Quality classifier: a linear-chain conditional random field over a text's lines.

Each line (cut at newlines) is good or bad. A line's features are shares of character classes,
lengths, whether it repeats an earlier line, and the same figures of its neighbours. Training
maximises the likelihood of labelled documents (all lines of a document bear its label), with one
weight for a document whatever its length, by forward-backward and Adam in numpy. A document's
score is the mean of its lines' marginals of "good", weighted by their lengths in bytes, mapped to
the share of label 1 among labelled documents by a logistic curve fitted on the same sample.

The fit uses at most TRAIN_DOCUMENTS labelled rows, those of the least hashes of id that together
keep to TRAIN_BYTES; every document is scored, whole: its lines in blocks, the chain over a long
text in segments that carry their messages over. Labels, language, source and id are no inputs of a score.

Nulls and empty texts have one empty line, and so get a score too. Null labels and ids are not
learned from. Repeated rows get equal scores. With no usable labels, or labels of one kind, every
score is the smoothed share of label 1. Empty tables give empty results. Extra columns are ignored
by ``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.cluster import id_fold
from rollmill.llm.textkernel import BYTE_BASE, SPACE, _BYTE_VALUE, groups, mix, span_hashes, spans
from rollmill.llm.tidy import one_thread, tidy

FOLDS, THRESHOLD = 5, 0.3
#: Bound of the sample that the model is fitted on.
TRAIN_DOCUMENTS = 2500
STEPS, RATE, DECAY = 120, 0.08, 1e-3
GROUP = 1 << 20
#: Lines whose features are held at once, and lines of a segment of a long text.
BLOCK_LINES, SEGMENT = 1 << 14, 512
#: Bound of the sample's size: bytes of text, and LINE_BYTES more for each line break, as features take memory by the line.
TRAIN_BYTES, LINE_BYTES = 64 << 20, 400

_CLASSES = {
    "lower": [*range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "symbol": [ord(c) for c in "#*$%&|<>"],
    "bar": [ord("|")],
    "exclamation": [ord("!")],
    "stop": [ord(c) for c in ".,;:?"],
    "other_mark": [ord(c) for c in "@=_/\\+~^`{}[]()\"'-"],
    "non_ascii": [*range(128, 256)],
    "space": [32, 9, 10, 11, 12, 13],
}
_TABLES = []
for _bytes in _CLASSES.values():
    _table = np.zeros(256, bool)
    _table[_bytes] = True
    _TABLES.append(_table)
#: Own figures of a line: bias, class shares, log length, log words, bytes a word, repeated, ends in a stop, starts upper, stuttered words.
OWN = 1 + len(_TABLES) + 7
FEATURES = 3 * OWN
REPEATED = 1 + len(_TABLES) + 3


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds of each text's lines)."""
    newline = np.flatnonzero(data == 10)
    breaks = np.diff(np.searchsorted(newline, offsets))
    bounds = np.append(0, np.cumsum(breaks + 1))
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    first[bounds[:-1]] = last[bounds[1:] - 1] = True
    starts[first], ends[last] = offsets[:-1], offsets[1:]
    starts[~first], ends[~last] = newline + 1, newline
    return starts, ends, bounds


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own figures of some neighbouring lines, all but whether they repeat; hashes of the lines)."""
    data, starts, ends = data[starts[0] : ends[-1]], starts - starts[0], ends - starts[0]
    size = (ends - starts).astype(np.float64)
    own = np.zeros((len(starts), OWN))
    own[:, 0] = 1
    total = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    for k, table in enumerate(_TABLES, 1):
        np.cumsum(table[data], out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / np.maximum(size, 1)
    edges = np.unique(np.append(starts, len(data)))
    begins, stops = spans(data, edges, SPACE[data])
    at = np.searchsorted(begins, starts)
    words = np.searchsorted(begins, ends) - at
    values = _BYTE_VALUE[data]
    hashes = span_hashes(values, BYTE_BASE, begins, stops)
    same = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(hashes[1:] == hashes[:-1], out=same[2:])
    k = 1 + len(_TABLES)
    own[:, k + 6] = np.where(words > 1, same[at + words] - same[np.minimum(at + 1, len(hashes))], 0) / np.maximum(words, 1)
    own[:, k] = np.log1p(size) / 5
    own[:, k + 1] = np.log1p(words) / 4
    own[:, k + 2] = np.minimum(size / np.maximum(words, 1), 40) / 10
    some = np.flatnonzero(size > 0)
    if len(some):
        own[some, k + 4] = np.isin(data[ends[some] - 1], [46, 33, 63, 44])
        own[some, k + 5] = (data[starts[some]] >= 65) & (data[starts[some]] <= 90)
    return own, span_hashes(values, BYTE_BASE, starts, ends)


def line_blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines of bounded number and bytes (but for one longer line)."""
    a = 0
    while a < len(starts):
        b = min(a + BLOCK_LINES, max(a + 1, int(np.searchsorted(ends, starts[a] + GROUP, "right"))))
        yield a, b
        a = b


def repeated(hashes: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a line that is not empty equals an earlier one of its text."""
    some = np.flatnonzero(size > 0)
    out = np.zeros(len(size))
    if len(some):
        doc = np.searchsorted(bounds, some, "right") - 1
        again = np.ones(len(some), bool)
        again[np.unique(mix(hashes[some] ^ mix(doc.astype(np.uint64))), return_index=True)[1]] = False
        out[some] = again
    return out


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, lengths in bytes plus 1, bounds of each text's lines)."""
    starts, ends, bounds = line_spans(data, offsets)
    parts = [own_features(data, starts[a:b], ends[a:b]) for a, b in line_blocks(starts, ends)]
    own, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    own[:, REPEATED] = repeated(hashes, ends - starts, bounds)
    out = np.zeros((len(own), FEATURES))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN :] = own[1:]
    out[bounds[:-1], OWN : 2 * OWN] = 0
    out[bounds[1:] - 1, 2 * OWN :] = 0
    return out, (ends - starts + 1).astype(np.float64), bounds


def line_energies(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted sums of the lines' features, lengths in bytes plus 1, bounds), by blocks of lines, whose features are not kept."""
    starts, ends, bounds = line_spans(data, offsets)
    by_place = weights.reshape(3, OWN).T
    shares, hashes = np.empty((len(starts), 3)), np.empty(len(starts), np.uint64)
    for a, b in line_blocks(starts, ends):
        own, hashes[a:b] = own_features(data, starts[a:b], ends[a:b])
        shares[a:b] = own @ by_place
    shares += repeated(hashes, ends - starts, bounds)[:, None] * by_place[REPEATED]
    out = shares[:, 0].copy()
    before, after = shares[:, 1], shares[:, 2]
    before[bounds[1:] - 1] = 0
    out[1:] += before[:-1]
    after[bounds[:-1]] = 0
    out[:-1] += after[1:]
    return out, (ends - starts + 1).astype(np.float64), bounds


@dataclass
class Crf:
    weights: np.ndarray  # of "good" against "bad", by feature
    moves: np.ndarray  # 2 x 2 log potentials of neighbouring lines; 1 is good
    curve: tuple[float, float]  # logistic of the logit of the mean marginal
    share: float


def _sweep(up: np.ndarray, a: np.ndarray, start: np.ndarray, sizes: np.ndarray, state: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """Forward messages over segments side by side, from ``state`` (by segment, one row or several) to after each segment's last line."""
    order = np.argsort(-sizes, kind="stable")
    start, sizes, state = start[order], sizes[order], state[order]
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right") if len(sizes) else []):
        at = start[:n] + t
        f = state[:n] @ a
        f[..., 1] *= up[at][:, None]
        f /= f.sum((1, 2), keepdims=True)
        state[:n] = f
        if visit is not None:
            visit(at, f)
    out = np.empty_like(state)
    out[order] = state
    return out


def forward_backward(energy: np.ndarray, bounds: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" of every line, and the summed pair marginals of each text.

    All texts go at once, line by line. A text of more than SEGMENT lines is cut into segments that
    go side by side, too: what each does to any message is a 2 x 2 matrix, so the messages at the
    segments' edges are found segment by segment, and then those within.
    """
    up = np.exp(np.clip(energy, -40, 40))
    a = np.exp(moves)
    n_texts = len(bounds) - 1
    parts = -(-np.diff(bounds) // SEGMENT)
    first = np.append(0, np.cumsum(parts))
    text = np.repeat(np.arange(n_texts), parts)
    nth = np.arange(len(text)) - first[text]
    start = bounds[text] + nth * SEGMENT
    end = np.minimum(start + SEGMENT, bounds[text + 1])
    ahead, behind = np.empty((len(energy), 2)), np.empty((len(energy), 2))
    opening = np.ones((len(start), 1, 2))  # forward message at each segment's first line
    closing = np.ones((len(start), 2))  # backward message at each segment's last line
    many = np.flatnonzero(parts > 1)
    if len(many):
        inner = np.flatnonzero(parts[text] > 1)
        through = np.empty((len(start), 2, 2))
        # from the forward message at a segment's first line to that at its last
        through[inner] = _sweep(up, a, start[inner] + 1, end[inner] - start[inner] - 1, np.repeat(np.eye(2)[None], len(inner), 0))
        for k in range(int(parts.max())):
            here = first[many[parts[many] > k]] + k
            if k:
                opening[here] = opening[here - 1] @ through[here - 1] @ a
            opening[here, :, 1] *= up[start[here]][:, None]
            opening[here] /= opening[here].sum(2, keepdims=True)
        for k in range(int(parts.max()) - 1, 0, -1):
            here = first[many[parts[many] > k]] + k
            b = np.einsum("nij,nj->ni", through[here], closing[here])
            b[:, 1] *= up[start[here]]
            b = b @ a.T
            closing[here - 1] = b / b.sum(1, keepdims=True)
    single = np.flatnonzero(parts[text] == 1)
    opening[single, 0, 1] = up[start[single]]
    opening[single] /= opening[single].sum(2, keepdims=True)
    ahead[start] = opening[:, 0]
    _sweep(up, a, start + 1, end - start - 1, opening, lambda at, f: ahead.__setitem__(at, f[:, 0]))
    order = np.argsort(start - end, kind="stable")
    last, sizes = end[order] - 1, (end - start)[order]
    behind[last] = closing[order]
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(2, sizes[0] + 1), "right") if len(sizes) else [], 1):
        at = last[:n] - t
        b = behind[at + 1].copy()
        b[:, 1] *= up[at + 1]
        b = b @ a.T
        behind[at] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    marginal = both[:, 1] / both.sum(1)
    expected = np.zeros((n_texts, 2, 2))
    if pairs:
        inner = np.ones(len(energy), bool)
        inner[bounds[1:] - 1] = False
        at = np.flatnonzero(inner)
        right = behind[at + 1].copy()
        right[:, 1] *= up[at + 1]
        joint = ahead[at][:, :, None] * a[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        doc = np.repeat(np.arange(n_texts), np.diff(bounds))[at]
        np.add.at(expected, doc, joint)
    return marginal, expected


def document_scores(marginal: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(marginal * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[str | None], labels: list[int]) -> Crf:
    y = np.asarray(labels, np.float64)
    share = float((y.sum() + 1) / (len(y) + 2))
    crf = Crf(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, float(_logit(np.array(share)))), share)
    if len(set(labels)) < 2:
        return crf
    parts, sizes, lines = [], [], []
    for _, data, offsets in groups(pa.array(texts, pa.large_string()), GROUP):
        x, w, bounds = line_features(data, offsets)
        parts.append(x)
        sizes.append(w)
        lines.append(np.diff(bounds))
    x, w, n = np.concatenate(parts), np.concatenate(sizes), np.concatenate(lines)
    bounds = np.append(0, np.cumsum(n))
    spread = np.maximum(x.std(0), 1e-3)
    spread[0] = 1
    x = x / spread
    truth = np.repeat(y, n)
    each = np.repeat(1 / n, n) / len(y)
    kinds = np.where(y > 0, 3, 0)
    wanted = np.zeros((2, 2))
    np.add.at(wanted.reshape(-1), kinds, (n - 1) / n / len(y))
    state = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        moves = state[FEATURES:].reshape(2, 2)
        marginal, expected = forward_backward(x @ state[:FEATURES], bounds, moves, pairs=True)
        grad = np.append(x.T @ ((truth - marginal) * each), wanted - (expected / (n * len(y))[:, None, None]).sum(0)) - DECAY * state
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        state += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    moves = state[FEATURES:].reshape(2, 2).copy()
    marginal, _ = forward_backward(x @ state[:FEATURES], bounds, moves)
    z = _logit(document_scores(marginal, w, bounds))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-held logistic curve
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        move = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    return Crf(state[:FEATURES] / spread, moves, (max(a, 1e-3), b), share)


def predict(column: pa.Array, crf: Crf) -> np.ndarray:
    out = np.zeros(len(column))
    for rows, data, offsets in groups(column, GROUP):
        energy, w, bounds = line_energies(data, offsets, crf.weights)
        marginal, _ = forward_backward(energy, bounds, crf.moves)
        z = crf.curve[0] * _logit(document_scores(marginal, w, bounds)) + crf.curve[1]
        out[rows] = 1 / (1 + np.exp(-z))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCUMENTS) -> Crf:
    """Fits on at most ``limit`` labelled rows, of at most TRAIN_BYTES, whose id is outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)).where(id_fold(F.col("__id"), FOLDS) != 0)
    picked = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(limit)
    size = F.coalesce(F.octet_length(F.col(text_col)) + F.lit(LINE_BYTES) * F.regexp_count(F.col(text_col), F.lit("\n")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("__d"), F.xxhash64(F.col(text_col)).alias("__h"), size.alias("__size"), F.col(text_col).alias("__text"))
    rows = sized.join(F.broadcast(picked), F.col("__d") == F.col("__id"))
    order = [F.xxhash64("__d"), F.col("__d"), F.col("__h"), F.col("__y")]
    # sizes come first, for at most ``limit`` rows (repeated ids may give more rows than labels), then the texts that are within the bound
    first, room = [], TRAIN_BYTES
    for r in rows.select("__d", "__h", "__y", "__size").orderBy(*order).limit(limit).collect():
        if r["__size"] <= room:
            room -= r["__size"]
            first.append((r["__d"], r["__h"], r["__y"]))
    if not first:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(sorted(set(first)), rows.select("__d", "__h", "__y").schema)
    texts = {(r["__d"], r["__h"]): r["__text"] for r in rows.join(F.broadcast(wanted), ["__d", "__h", "__y"], "left_semi").select("__d", "__h", "__text").dropDuplicates(["__d", "__h"]).collect()}
    return fit([texts[d, h] for d, h, _ in first], [int(y) for _, _, y in first])


def classify(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        one_thread()
        return pa.array(predict(text, sent.value))

    scored = docs.select(F.col(id_col), (id_fold(F.col(id_col), FOLDS) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, crf: Crf, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those the classifier rejects; no exchange of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(predict(batch.column(text_col), sent.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
