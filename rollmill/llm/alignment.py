"""Alignment of two tokenizers' tokens over every whole text, and how usual each linked pair is.

Postings cogroup. A first pass encodes the texts, links tokens whose bytes overlap and writes, for
each chunk of documents, the documents' own figures and postings: each pair's multiplicity in each
document, by bucket of the second side's id. Totals of the pairs are summed in streams, sent ahead
of the postings of their bucket, and each task reads one sorted stream: first the totals, from
which it has every pair's count and each id's highest, then the postings, of which it holds one
row at a time. What it says of the documents is summed by document.

A pair's total is bounded by the two vocabularies, not by the corpus; postings of a bucket are
dealt over as many tasks as they need, so an id that stands in every third posting meets in no one
task. Chunks are rows of a written table, so nothing is encoded twice.

Neither tokenizer joins what a single space parts from what is before it, as the models are asked
to prove. So a text is cut there, each distinct piece of a chunk is encoded once, and a text of any
length is handled in blocks of links; a piece without such a space is encoded whole.

Nulls, empty texts and texts that either tokenizer does not give back byte for byte have no tokens:
zeros, and ``groups_sha256`` is ''. Null ids, repeated ids and repeated rows are treated row by
row. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.chunks import chunked
from rollmill.llm.cluster import shared_path, shuffle_partitions
from rollmill.llm.textkernel import _BYTE_VALUE, BYTE_BASE, span_hashes
from rollmill.llm.tidy import release, tidy

#: Buckets of the second side's ids, by remainder.
BUCKETS = 32
#: Postings of a task, links that are held at once, bytes that a tokenizer is given at once.
SLOT_POSTINGS, BLOCK_LINKS, ENCODE_BYTES = 1 << 23, 1 << 20, 1 << 15
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
MARK = "▁"

#: White space of more than one byte, by which no text is cut.
_WIDE_SPACES = ["\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]
_NARROW = np.zeros(256, bool)
_NARROW[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True

_aligners: dict[tuple[str, str], "Aligner"] = {}


class Aligner:
    """Two tokenizers and the bytes of their tokens; one per process."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # the spelling of a group: ids by commas, sides by a bar, groups by semicolons
        self.text_a, self.text_b = (np.array([[f"{i}," for i in range(len(t))], [f"{i}{end}" for i in range(len(t))]], object) for t, end in ((self.bytes_a, "|"), (self.bytes_b, ";")))
        # the first side splits before a space by its pattern, the second has no piece that holds one after anything else
        rules = json.loads(self.a.to_str())
        split = rules["normalizer"] is None and (rules["pre_tokenizer"] or {}).get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex")
        self.cuts = bool(split) and not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, pieces: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, pieces joined in order; those marked ``alone`` are given to the tokenizers by themselves."""
        runs, held, size = [], [], 0
        for piece, lone in zip(pieces, alone.tolist(), strict=True):
            if held and (lone or size > ENCODE_BYTES):
                runs.append(b"".join(held))
                held, size = [], 0
            if lone:
                runs.append(piece)
            else:
                held.append(piece)
                size += len(piece)
        if held:
            runs.append(b"".join(held))
        texts = [x.decode() for x in runs]
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))

    def join(self, pieces: list[bytes], alone: np.ndarray) -> "Pieces":
        """Links and groups of distinct pieces. A piece that does not come back byte for byte is marked bad and has none."""
        a, b = self.encode(pieces, alone)
        whole = b"".join(pieces)
        bad = np.zeros(len(pieces), bool)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            for k, piece in enumerate(pieces):
                x, y = self.encode([piece], np.ones(1, bool))
                bad[k] = b"".join(self.bytes_a[i] for i in x) != piece or b"".join(self.bytes_b[i] for i in y) != piece
            good = [p for p, no in zip(pieces, bad, strict=True) if not no]
            a, b = self.encode(good, np.ones(len(good), bool))
        sizes = np.where(bad, 0, np.array([len(p) for p in pieces], np.int64))
        return Pieces(self, a, b, np.cumsum(sizes), bad)


class Pieces:
    """Tokens, links and groups of pieces laid one after another; ``upto`` arrays end each piece."""

    def __init__(self, aligner: Aligner, a: np.ndarray, b: np.ndarray, ends: np.ndarray, bad: np.ndarray):
        end_a, end_b = np.cumsum(aligner.length_a[a]), np.cumsum(aligner.length_b[b])
        both = np.union1d(end_a, end_b)  # each stretch between ends of either side is the overlap of one pair
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        first, second = a[np.searchsorted(end_a, both)], b[np.searchsorted(end_b, both)]
        self.links = second << 32 | first
        self.bad = bad
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (end_a, end_b, shared, both))
        self.link_at = np.cumsum(self.n_links) - self.n_links
        # the spelling: tokens of a group's first side, then of its second
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = aligner.text_a[np.isin(end_a, shared, assume_unique=True).astype(int), a]
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = aligner.text_b[np.isin(end_b, shared, assume_unique=True).astype(int), b]
        lengths = np.cumsum([0, *map(len, out.tolist())])
        cuts = lengths[np.cumsum(self.n_a + self.n_b)].tolist()
        spelled = "".join(out.tolist()).encode()
        self.spelled = [spelled[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def _spaces(data: np.ndarray) -> np.ndarray:
    """Bytes that are white space or part of it."""
    out = _NARROW[data]
    for wide in _WIDE_SPACES:
        raw = wide.encode()
        hit = data[: len(data) - len(raw) + 1] == raw[0]
        if hit.any():
            for k, x in enumerate(raw[1:], 1):
                hit = hit & (data[k : len(data) - len(raw) + 1 + k] == x)
            for k in range(len(raw)):
                out[k : k + len(hit)] |= hit
    return out


def cut(data: np.ndarray, offsets: np.ndarray, may: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces of texts that each begin with a space, and whether a piece must be encoded alone."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    space = _spaces(data)
    at = first[:-1].copy()
    if may and len(data) > 2:
        inner = (data[1:-1] == 0x20) & ~space[:-2] & ~space[2:] & ~first[1:-2] & ~first[2:-1]
        at[1:-1] |= inner
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], len(data))
    second = np.minimum(starts + 1, len(data) - 1)
    return starts, ends, (ends - starts == 1) | space[second] | space[ends - 1] if len(starts) else np.zeros(0, bool)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in their narrowest kinds."""
    parts = [_narrow(x) for x in arrays]
    return b"".join([np.array([(x.itemsize, len(x)) for x in parts], np.int64).tobytes(), *(x.tobytes() for x in parts)])


def _unblob(raw: bytes, n: int) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2), 16 * n, []
    for each, length in sizes.tolist():
        out.append(np.frombuffer(raw, f"u{each}", length, at).astype(np.int64))
        at += each * length
    return out


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


DOCS = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
#: ``kind``: 0 documents of a chunk, 1 pairs with totals, 2 postings. The table also has the number of postings.
ROW = "kind int, chunk long, bucket int, postings long, data binary"
_ROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("postings", pa.int64()), ("data", pa.binary())])


def align_chunk(code: Aligner, chunk: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of a chunk: its documents, and pairs and postings of each bucket."""
    usable = [t if t and MARK not in t else None for t in texts]
    raws = [b" " + t.encode() if t else b"" for t in usable]
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends, alone = cut(data, offsets, code.cuts)
    _, at, which = np.unique(span_hashes(_BYTE_VALUE[data], BYTE_BASE, starts, ends), return_index=True, return_inverse=True)
    flat = data.tobytes()
    pieces = code.join([flat[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], alone[at])
    doc = np.searchsorted(offsets, starts, "right") - 1
    bad = np.zeros(len(ids), bool)
    bad[doc[pieces.bad[which]]] = True
    use = ~bad[doc]
    which, doc = which[use], doc[use]
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    figures = [np.bincount(doc, weights=x[which], minlength=len(ids)).astype(np.int64) for x in (pieces.n_a, pieces.n_b, pieces.n_groups, pieces.n_links)]
    index, spelled = which.tolist(), pieces.spelled
    shas = [hashlib.sha256(b"".join([spelled[k] for k in index[x:y]])[:-1]).hexdigest() if y > x else "" for x, y in zip(first.tolist(), first[1:].tolist(), strict=False)]
    pairs, pair_of_link = np.unique(pieces.links, return_inverse=True)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto = np.cumsum(pieces.n_links[which])
    x = 0
    while x < len(which):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + BLOCK_LINKS, "right")))
        n = pieces.n_links[which[x:y]]
        total = np.cumsum(n)
        at_link = np.arange(total[-1]) + np.repeat(pieces.link_at[which[x:y]] - (total - n), n)
        key = np.sort(pair_of_link[at_link] * len(ids) + np.repeat(doc[x:y], n))
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        keys.append(key[cuts])
        times.append(np.diff(np.append(cuts, len(key))))
        x = y
    key, times = _summed(np.concatenate(keys), np.concatenate(times))
    pair, doc = key // max(1, len(ids)), key % max(1, len(ids))
    documents = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, figures), pa.array(shas, pa.string())], schema=DOCS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, DOCS) as out:
        out.write_batch(documents)
    rows = [(0, chunk, -1, 0, sink.getvalue().to_pybytes())]
    bucket_of = (pairs >> 32) % BUCKETS
    bucket = bucket_of[pair]
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for k in range(BUCKETS):
        own = order[cuts[k] : cuts[k + 1]]
        if len(own):
            begin = np.flatnonzero(np.diff(pair[own], prepend=-1))
            here, total = pairs[pair[own[begin]]], np.add.reduceat(times[own], begin)
            rows.append((1, chunk, k, 0, _blob(here >> 32, here & 0xFFFFFFFF, total)))
            rows.append((2, chunk, k, len(own), _blob(here >> 32, here & 0xFFFFFFFF, np.diff(np.append(begin, len(own))), doc[own], times[own])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)


@tidy
def _sum_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a stream in the order of buckets: one row for each bucket. Holds each pair of a bucket once, and some rows."""

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

    now, held, size = None, [], 0
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != now and held:
                yield _totals_row(now, *merged())
                held, size = [], 0
            now = bucket
            b, a, total = _unblob(raw, 3)
            held.append((b << 32 | a, total))
            size += len(b)
            if size > 2 * len(held[0][0]) + BLOCK_LINKS:
                held = [merged()]
                size = len(held[0][0])
    if held:
        yield _totals_row(now, *merged())


def _totals_row(bucket: int, keys: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_blob(keys >> 32, keys & 0xFFFFFFFF, totals)], pa.binary())], names=["bucket", "data"])


@tidy
def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What postings say of their documents, by the totals that stand before them in the stream."""
    now = None
    keys = totals = best = np.zeros(0, np.int64)
    for batch in batches:
        chunks, datas = [], []
        for slot, kind, chunk, raw in zip(*(batch.column(c).to_pylist() for c in ("slot", "kind", "chunk", "data")), strict=True):
            if kind == 1:
                b, a, totals = _unblob(raw, 3)
                keys, now = b << 32 | a, slot
                first = np.flatnonzero(np.diff(b, prepend=-1))
                most = np.maximum.reduceat(totals, first)
                best = totals == np.repeat(most, np.diff(np.append(first, len(b))))
                continue
            if slot != now:
                raise RuntimeError("postings without the totals of their pairs")
            b, a, n_docs, doc, times = _unblob(raw, 5)
            at = np.repeat(np.searchsorted(keys, b << 32 | a), n_docs)
            docs, place = np.unique(doc, return_inverse=True)
            n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(n_best, place, times * best[at])
            np.add.at(count_sum, place, times * totals[at])
            chunks.append(chunk)
            datas.append(_blob(docs, n_best, count_sum))
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(datas, pa.binary())], names=["chunk", "data"])


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", slot_postings: int = SLOT_POSTINGS, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is a byte-level tokenizers file, ``second`` a sentencepiece model that adds a space.
    """
    spark = docs.sparkSession

    @tidy
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(first, second)
        for chunk, ids, texts in chunked(batches, chunk_rows, chunk_bytes):
            out = align_chunk(code, chunk, ids, texts)
            for k in range(0, len(out), 8):
                yield out.slice(k, 8)

    path = shared_path(spark, "alignment")
    docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encoded, ROW).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(ROW).parquet(path)
    postings = rows.where("kind = 2")
    most = postings.groupBy("bucket").agg(F.sum("postings").alias("n")).agg(F.max("n")).first()[0] or 0
    # a bucket's postings go to as many slots as its size asks for, and no fewer than keep all tasks at work
    salts = max(-(-most // slot_postings), -(-shuffle_partitions(spark) // BUCKETS))
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")
    slots = BUCKETS * salts
    partial = rows.where("kind = 1").select("bucket", "data", (F.col("bucket") * salts + salt).alias("slot")).repartitionById(slots, "slot").mapInArrow(_sum_totals, "bucket int, data binary")
    totals = partial.repartitionById(BUCKETS, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_totals, "bucket int, data binary")
    ahead = totals.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "bucket", "data").select((F.col("bucket") * salts + F.col("salt")).cast("int").alias("slot"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("chunk"), "data")
    stream = ahead.unionAll(postings.select((F.col("bucket") * salts + salt).cast("int").alias("slot"), "kind", "chunk", "data")).repartitionById(slots, "slot").sortWithinPartitions("slot", "kind")
    said = stream.mapInArrow(_contribute, "chunk long, data binary")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(left["data"][0].as_py()).read_all()
        n_best, count_sum = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        for raw in right["data"]:
            doc, best, count = _unblob(raw.as_py(), 3)
            n_best[doc] += best
            count_sum[doc] += count
        release()
        return pa.table({id_col: table["id"], "n_a": table["n_a"], "n_b": table["n_b"], "n_groups": table["n_groups"], "n_links": table["n_links"], "n_best": n_best, "count_sum": count_sum, "groups_sha256": table["groups_sha256"]})

    schema = f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.where("kind = 0").select("chunk", "data").groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(total, schema)
