"""Exact substring deduplication by difference-cover anchors.

A window is ``length`` consecutive words. Anchors are hashes of ``length - period + 1`` words that
start at positions whose remainder modulo ``period`` is in a difference cover; for any two equal
windows some shift of less than ``period`` words brings both starts onto the cover, so the two
share an aligned anchor. Three passes over the texts:

1. anchors, sent by hash as packed arrays with one entry for each distinct anchor of a chunk, are
   counted; those that occur twice go into a bit filter of fixed size;
2. every window that holds an anchor which passes the filter is extended to its full length: its
   hash, again one entry for each distinct one of a chunk, is counted exactly; the hashes that
   occur twice go back to the chunks that asked;
3. each chunk, joined with its answers, marks the words its repeated windows cover.

A hash that a third of all documents share is one entry for each chunk, so no task gathers its
occurrences. The filter saturates on very large inputs, which sends more windows to be counted and
changes no result. Chunks are runs of rows of an input partition; passes 2 and 3 must see the same
rows in them, which a digest verifies, so that an input that is not read the same way twice is an
error and not a wrong result. Hashes have 64 bits.

Nulls and texts without words have no windows: n_words 0, nothing removed. Texts shorter than a
window keep all. Null ids, repeated ids and repeated rows are treated row by row (repeated rows
repeat each other's windows). Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.chunks import PACKED, chunked, digest, pack, unpack
from rollmill.llm.cluster import buckets_for, text_bytes
from rollmill.llm.filters import FILTER_BITS, bit_filter, passes
from rollmill.llm.textkernel import Words, windows, word_groups
from rollmill.llm.tidy import release, tidy

LENGTH, PERIOD = 35, 21
#: Anchors that a task gathers before it sends them.
SEND = 1 << 20


def difference_cover(period: int) -> list[int]:
    """The least set (first in order) whose differences are all residues modulo ``period``."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return list(chosen)
    raise AssertionError


class Anchors:
    def __init__(self, length: int, period: int):
        if not 0 < period < length:
            raise ValueError("the period must be shorter than the window")
        self.length, self.period, self.words = length, period, length - period + 1
        self.on = np.zeros(period, bool)
        self.on[difference_cover(period)] = True

    def of(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of the anchors of documents that hold a window."""
        starts, found = windows(words, hashes, self.words)
        doc = words.doc_of_word()[starts]
        keep = self.on[(starts - words.first[doc]) % self.period] & (words.counts[doc] >= self.length)
        return starts[keep], found[keep]

    def extended(self, words: Words, hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
        """Hashes of the windows that hold an anchor which passes the filter."""
        at, found = self.of(words, hashes)
        at = at[passes(bitmap, found, bits)]
        if not len(at):
            return np.zeros(0, np.uint64)
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(at - (self.period - 1), words.first[words.doc_of_word()[at]]), 1)
        np.add.at(edge, at + 1, -1)
        starts, full = windows(words, hashes, self.length)
        return full[np.cumsum(edge)[starts] > 0]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and whether each occurs twice or more."""
    ordered = np.sort(hashes)
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    where = np.flatnonzero(first)
    return ordered[where], np.diff(np.append(where, len(ordered))) > 1


def dealt(chunk: int, hashes: np.ndarray, bucket_bits: int) -> pa.RecordBatch | None:
    """One row for each bucket: bucket, chunk, packed hashes, packed marks."""
    values, twice = distinct(hashes)
    if not len(values):
        return None
    bucket = (values >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(values))
    marks = twice.astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts]),
            pa.array(np.full(len(cuts), chunk, np.int64)),
            pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([marks[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        ],
        names=["bucket", "chunk", "hashes", "marks"],
    )


REQUEST = "bucket long, chunk long, hashes binary, marks binary"


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, mark, row of the table), all entries of a bucket."""
    blobs = [x.as_py() for x in table["hashes"]]
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    marks = np.frombuffer(b"".join(x.as_py() for x in table["marks"]), np.uint8)
    return hashes, marks, np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])


def repeated(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which entries have a hash that stands in two entries or is marked."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.zeros(len(ordered), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(ordered), bool)
    out[order] = same
    return out | (marks != 0)


def _without(found: np.ndarray, answers: np.ndarray) -> np.ndarray:
    at = np.searchsorted(answers, found)
    at[at == len(answers)] = 0
    return answers[at] == found if len(answers) else np.zeros(len(found), bool)


def deduplicate(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (kept words joined by one space), and kept_text if asked for."""
    spark = docs.sparkSession
    rules = Anchors(length, period)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bucket_bits = max(1, (buckets_for(spark, text_bytes(docs, text_col) // 2) - 1).bit_length())

    @tidy
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for words in word_groups(batch.column("text")):
                held.append(rules.of(words, words.word_hashes())[1])
                n += len(held[-1])
                if n >= SEND:
                    yield dealt(0, np.concatenate(held), bucket_bits)
                    held, n = [], 0
        if n:
            yield dealt(0, np.concatenate(held), bucket_bits)

    def common(table: pa.Table) -> pa.Table:
        hashes, marks, _ = unpacked(table)
        return pa.table({"hash": pa.array(np.unique(hashes[repeated(hashes, marks)]).view(np.int64))})

    frequent = source.mapInArrow(anchors, REQUEST).groupBy("bucket").applyInArrow(common, "hash long")
    bitmap = spark.sparkContext.broadcast(bit_filter(frequent, "hash", bits))

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in chunked(batches):
            held = []
            for words in word_groups(pa.array(texts, pa.large_string())):
                hashes = words.word_hashes()
                held.append(rules.extended(words, hashes, bitmap.value, bits))
            out = dealt(chunk, np.concatenate(held), bucket_bits)
            if out is not None:
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(out), digest(ids, texts), np.int64))], names=[*out.schema.names, "digest"])

    def answer(table: pa.Table) -> pa.Table:
        hashes, marks, row = unpacked(table)
        yes = repeated(hashes, marks)
        hashes, row = hashes[yes], row[yes]
        cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
        rows = np.flatnonzero(np.diff(cuts))
        return pa.table({"chunk": table["chunk"].take(pa.array(rows)), "digest": table["digest"].take(pa.array(rows)), "hashes": pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary())})

    answers = source.mapInArrow(ask, REQUEST + ", digest long").groupBy("bucket").applyInArrow(answer, "chunk long, digest long, hashes binary")

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        table = unpack(left, right["digest"].to_pylist())
        known = np.unique(np.frombuffer(b"".join(x.as_py() for x in right["hashes"]), np.uint64))
        n_words, n_removed, kept_sha, kept_text = [], [], [], []
        for words in word_groups(table["text"]):
            gone = np.zeros(len(words.starts) + 1, np.int64)
            if len(known):
                starts, full = windows(words, words.word_hashes(), length)
                hit = starts[_without(full, known)]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + length, -1)
            covered = np.cumsum(gone)[:-1] > 0
            for d in range(len(words.rows)):
                a, b = words.first[d], words.last[d]
                here = covered[a:b]
                removed = int(here.sum())
                own = words.word_bytes(d)
                if removed:
                    own = list(itertools.compress(own, ~here))
                joined = b" ".join(own)
                n_words.append(int(b - a))
                n_removed.append(removed)
                kept_sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined if keep_text else None)
        out = {"doc_id": table["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept_sha, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept_text, pa.binary()).cast(pa.string())} if keep_text else {}))

    packed = source.mapInArrow(pack, PACKED)
    schema = f"{id_col} long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def named(left: pa.Table, right: pa.Table) -> pa.Table:
        out = cover(left, right)
        release()
        return out.rename_columns([id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(named, schema)



