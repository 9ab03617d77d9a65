"""Whole-batch text kernels in numpy: word spans, word hashes and hashes of runs of words.

Words are maximal runs of bytes other than space and 0x09-0x0D, which equals the pattern
``[^\\x20\\x09-\\x0D]+`` on UTF-8. Texts are handled whole; a batch is cut into groups of whole
documents of about ``GROUP_BYTES`` so that temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multipliers of the polynomial hashes modulo 2**64, and their inverses.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def forget() -> None:
    """Drops the kept powers."""
    _powers.clear()


def span_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal runs wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    out = (total[ends] - total[starts]) * inverse[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each 64-bit hash stands in ``known`` (sorted, distinct, evenly spread, not empty), as searchsorted has it but never past the end.

    The head of a hash names the few places where it can stand, which takes less time than halving.
    """
    bits = np.uint64(64 - max(1, len(known).bit_length() + 1))
    table = np.zeros((1 << (64 - int(bits))) + 1, np.int32 if len(known) < 1 << 31 else np.int64)
    np.cumsum(np.bincount((known >> bits).astype(np.int64), minlength=len(table) - 1), out=table[1:])
    at = table[(hashes >> bits).astype(np.int64)]
    last = len(known) - 1
    np.minimum(at, last, out=at)
    left = np.flatnonzero(known[at] < hashes)
    left = left[at[left] < last]
    while len(left):
        at[left] += 1
        left = left[(known[at[left]] < hashes[left]) & (at[left] < last)]
    return at


@dataclass
class Words:
    """Words of a group of documents.

    first, last: index of each document's first word and of one past its last, in starts/ends;
    starts, ends: byte spans in data; rows: the documents' places in the batch.
    """

    data: np.ndarray
    rows: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUE[self.data], BYTE_BASE, self.starts, self.ends)

    def word_bytes(self, doc: int) -> list[bytes]:
        a, b = self.offsets[doc], self.offsets[doc + 1]
        return self.data[a:b].tobytes().split()  # bytes.split() cuts at just these six bytes


def spans(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of uncut bytes that stay within a document."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~cut
    before = np.ones(len(data), bool)
    before[1:] = cut[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = cut[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without copying the text; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(column: pa.Array | pa.ChunkedArray, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, bytes, offsets) of runs of whole documents."""
    data, offsets = string_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, "right")) - 1)
        upto = min(upto, n)
        yield np.arange(at, upto), data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def word_groups(column: pa.Array | pa.ChunkedArray, group_bytes: int = GROUP_BYTES) -> Iterator[Words]:
    for rows, data, offsets in groups(column, group_bytes):
        starts, ends = spans(data, offsets, SPACE[data])
        first = np.searchsorted(starts, offsets[:-1], "left")
        last = np.searchsorted(starts, offsets[1:], "left")
        yield Words(data, rows, offsets, starts, ends, first, last)


def windows(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of ``length`` words within one document."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.arange(n) + length <= np.repeat(words.last, words.counts)[:n]
    starts = np.flatnonzero(ok)
    return starts, span_hashes(hashes, WORD_BASE, starts, starts + length)
