"""Prefix-free parsing in numpy: stretches of windows that share an anchor, and the order of their suffixes from dictionary and parse.

An anchor is the place with the least rolling hash of ``TRIGGER`` bytes among ``reach`` places in a
row (the first of equals). Every window start has the anchor that its own window names, so equal
windows name the same one at the same distance, whatever stands around them. Starts in a row that
name one anchor are a stretch; only windows of stretches with equal bytes from the anchor on (the
core) can be equal.

``repeated`` puts all suffixes of many stretches in order. A stretch is its left phrase, up to the
end of the anchor, and the text from the anchor on, which is parsed: rolling hashes that are 0
modulo ``MODULUS`` are triggers, phrases run from one trigger to the end of the next, so no phrase
is the beginning of another. The suffix array of the dictionary of left phrases gives the order
first, that of the parse second. Neighbours of one class share their left part and as many bytes of
the rest as the least of the shared lengths between them in the parse's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from rollmill.llm.textkernel import _BYTE_VALUE, BYTE_BASE, mix, powers

TRIGGER, MODULUS = 16, 32
BLOCK = 1 << 20


class Prefixes:
    """Rolling hashes of any stretch of some bytes, by sums of prefixes modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * powers(BYTE_BASE, len(data)), out=self.total[1:])
        self.inverse = powers(pow(BYTE_BASE, -1, 1 << 64), len(data) + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of bytes starts..ends, never 0."""
        return np.maximum(mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), np.uint64(1))

    def least(self, reach: int) -> np.ndarray:
        """For each place, the anchor among the ``reach`` places from it on."""
        n = len(self.total) - TRIGGER
        if n < reach:
            return np.zeros(0, np.int64)
        hashes = (self.total[TRIGGER:] - self.total[:n]) * self.inverse[:n]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        best = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < reach:
            best = np.minimum(best[: width - reach], best[reach - width :])
        return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Stretches:
    """first, last: starts of windows; anchor: theirs; core: hash of the bytes from it on that any window with it holds; whole: hash of all bytes of the windows."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    core: np.ndarray
    whole: np.ndarray


def blocks(offsets: np.ndarray, length: int, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, first starts, one past the last starts): whole documents of about ``size`` bytes; a longer one comes in parts that overlap by all but one byte of a window."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[upto])
        if upto == at + 1 and end - begin > 2 * size:
            for a in range(begin, end - length + 1, size):
                b = min(a + size, end - length + 1)
                yield a, b + length - 1, np.array([a]), np.array([b])
        else:
            yield begin, end, offsets[at:upto], np.maximum(offsets[at + 1 : upto + 1] - length + 1, offsets[at:upto])
        at = upto


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, reach: int, size: int = BLOCK) -> Stretches:
    """All stretches of all windows of ``length`` bytes within documents."""
    parts = []
    for begin, end, first, stop in blocks(offsets, length, size):
        prefixes = Prefixes(data[begin:end])
        best = prefixes.least(reach)
        step = np.zeros(end - begin + 1, np.int32)
        np.add.at(step, first - begin, 1)
        np.add.at(step, stop - begin, -1)
        starts = np.flatnonzero(np.cumsum(step[: len(best)]) > 0)
        if not len(starts):
            continue
        anchor = best[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        low, high, at = starts[head], starts[np.append(head[1:], len(starts)) - 1], anchor[head]
        parts.append((low + begin, high + begin, at + begin, prefixes.of(at, at + length - reach + 1), prefixes.of(low, high + length)))
    if not parts:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.view(np.uint64), none.view(np.uint64))
    return Stretches(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int, size: int = BLOCK) -> np.ndarray:
    """Hashes of the windows at some starts, in ascending order, whichever bytes lie between."""
    out, k = [np.zeros(0, np.uint64)], 0
    while k < len(starts):
        upto = int(np.searchsorted(starts, starts[k] + size, "left"))
        here = starts[k:upto] - starts[k]
        out.append(Prefixes(data[starts[k] : starts[upto - 1] + length]).of(here, here + length))
        k = upto
    return np.concatenate(out)


def ranks_of_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every suffix text[i:end of its phrase]; equal suffixes share a rank. Doubling from seven symbols on.

    The length of a suffix is part of its order: shorter ones that are the beginning of others come first.
    """
    n = len(text)
    rest = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: n - k] += np.where(rest[: n - k] > k, text[k:].astype(np.int64) + 1, 0)
    rank = np.unique(key, return_inverse=True)[1]
    width, most = 7, int(rest.max()) if n else 0
    while width < most:
        key = rank * (n + 1)
        key[: n - width] += np.where(rest[: n - width] > width, rank[width:] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2
    return rank


def _sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _minima(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of low..high (inclusive, low <= high)."""
    depth = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for d in np.unique(depth).tolist():
        here = depth == d
        out[here] = np.minimum(levels[d][low[here]], levels[d][high[here] - (1 << d) + 1])
    return out


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def phrases(texts: list[bytes]) -> list[list[bytes]]:
    """Phrases of each text: from its start, or a trigger, to the end of the next trigger, or of the text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.diff(ends, prepend=0)
    n = max(0, len(data) - TRIGGER + 1)
    prefixes = Prefixes(data)
    hashes = mix((prefixes.total[TRIGGER:] - prefixes.total[:n]) * prefixes.inverse[:n]) if n else np.zeros(0, np.uint64)
    at = np.flatnonzero(hashes % np.uint64(MODULUS) == 0)
    of = np.searchsorted(ends, at, "right")
    inside = (at + TRIGGER <= ends[of]) & (at > begins[of])
    at, of = at[inside], of[inside]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    at = (at - begins[of]).tolist()
    out = []
    for k, text in enumerate(texts):
        own = at[cuts[k] : cuts[k + 1]]
        out.append([text[a : b + TRIGGER] for a, b in zip([0, *own], [*own, len(text)], strict=True)])
    return out


def order_of_parse(rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text among all, by its phrases, and the bytes that each text in order shares with the one before it.

    Phrases are ranked in the dictionary, texts by the ranks of their phrases. Two texts share the
    phrases they both begin with and what their first different phrases share.
    """
    parsed = phrases(rights)
    dictionary = {phrase: k for k, phrase in enumerate(sorted({p for own in parsed for p in own}))}
    spelled = [[dictionary[p] for p in own] for own in parsed]
    order = sorted(range(len(rights)), key=spelled.__getitem__)
    rank = np.empty(len(rights), np.int64)
    rank[order] = np.arange(len(rights))
    shared = np.zeros(len(rights), np.int64)
    for k in range(1, len(order)):
        x, y = order[k - 1], order[k]
        n, m = 0, min(len(spelled[x]), len(spelled[y]))
        while n < m and spelled[x][n] == spelled[y][n]:
            n += 1
        # a last phrase may be the beginning of another; no other phrase is
        shared[k] = sum(len(p) - TRIGGER for p in parsed[x][:n]) + _shared(parsed[x][n], parsed[y][n]) if n < m else min(len(rights[x]), len(rights[y]))
    return rank, shared


def repeated(texts: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """For distinct stretches, laid one after another: which of their windows stand in another of them, too."""
    lefts = [t[: int(k) + TRIGGER] for t, k in zip(texts, anchors, strict=True)]
    at_left: dict[bytes, int] = {}
    for left in lefts:
        at_left.setdefault(left, len(at_left))
    ends = np.cumsum([len(p) for p in at_left])
    suffix = ranks_of_suffixes(np.frombuffer(b"".join(at_left), np.uint8), ends)
    begin = np.concatenate([[0], ends[:-1]])[[at_left[left] for left in lefts]]
    rights = {t[int(k) :]: 0 for t, k in zip(texts, anchors, strict=True)}
    ranks, shared = order_of_parse(list(rights))
    place = dict(zip(rights, ranks.tolist(), strict=True))
    parse = np.array([place[t[int(k) :]] for t, k in zip(texts, anchors, strict=True)], np.int64)
    n = np.array([len(t) for t in texts], np.int64) - length + 1
    of = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = suffix[begin[of] + offset] * len(rights) + parse[of]
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = suffix[begin[of[a]] + offset[a]] == suffix[begin[of[b]] + offset[b]]
    a, b = a[same], b[same]
    low, high = parse[of[a]], parse[of[b]]
    # equal ranks in the parse: all of the rest is shared
    rest = np.array([len(t) for t in texts], np.int64) - anchors
    whole = rest[of[a]]
    equal = low == high
    levels = _sparse_minima(shared)
    whole[~equal] = _minima(levels, low[~equal] + 1, high[~equal])
    hit = anchors[of[a]] - offset[a] + whole >= length
    out = np.zeros(len(of), bool)
    out[a[hit]] = True
    out[b[hit]] = True
    return out
