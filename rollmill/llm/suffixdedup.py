"""Exact deduplication of long byte strings by prefix-free parsing and suffix order.

A window is ``length`` bytes that start in a document. Its anchor (see ``prefixfree``) splits a
document's windows into stretches of some eighty starts that share a core of bytes. Passes:

1. every chunk of rows sends the hash of each distinct core, and of the stretch around it, by hash;
   a core that stands in one place only is done, as its windows stand nowhere else; one that always
   has the same stretch around it is done too, as all its windows are repeated;
2. the chunk, joined with these answers, finishes the documents they settle, and sends the bytes of
   the stretches whose core has different surroundings to the core's bucket;
3. a bucket puts the suffixes of its stretches in order, by the suffix arrays of its dictionary and
   of its parse; neighbours in that order that share a window mark it, and the marks go back;
4. each chunk, joined with its marks, finishes the other documents.

So text that is copied in whole or in long passages is settled by hashes, only the borders of
copies are sorted, and texts whose documents have none are exchanged once. A core with more than
``MAX_STRETCHES`` different surroundings would make a bucket that grows with the corpus: its
windows are counted by their own hashes instead, dealt by these. What a third of all documents
share is one entry a chunk. Hashes have 64 bits; chunks carry digests, so an input that is not read
the same way twice is an error.

Nulls and empty texts have no bytes. Null ids, repeated ids and repeated rows are treated row by
row (repeated rows repeat each other's windows). Empty tables give empty results. Extra columns
are ignored. Bytes are removed wherever a repeated window covers them, in the middle of a
character as well, so what is kept is bytes and not always UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.chunks import PACKED, chunked, digest, pack, unpack
from rollmill.llm.cluster import buckets_for, shared_path, text_bytes
from rollmill.llm.prefixfree import TRIGGER, Stretches, repeated, stretches, window_hashes
from rollmill.llm.substring import dealt, unpacked
from rollmill.llm.substring import repeated as counted_twice
from rollmill.llm.textkernel import string_buffers
from rollmill.llm.tidy import release, tidy

LENGTH, REACH = 400, 160
#: Different stretches around one core that a task puts in order, and the bytes it does at once.
MAX_STRETCHES, SORT_BYTES = 1 << 14, 1 << 20
ONE, DIFFERENT, MANY = 1, 2, 3


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _distinct(found: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stretches in the order of (core, whole): their places, whether each occurs twice, and the first one of each core."""
    order = np.lexsort((found.whole, found.core))
    core, whole = found.core[order], found.whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order))) > 1, _runs(core[head])


CORES = "bucket long, chunk long, digest long, cores binary, wholes binary, notes binary"


def _ask(chunk: int, mark: int, found: Stretches, bucket_bits: int) -> pa.RecordBatch:
    """For each bucket: cores; the stretch around each, 0 if there are several; twice the number of these (at most 32767), plus 1 if one occurs twice."""
    at, twice, head = _distinct(found)
    n = np.diff(np.append(head, len(at)))
    cores, wholes = found.core[at[head]], np.where(n == 1, found.whole[at[head]], 0).astype(np.uint64)
    notes = (np.minimum(n, 0x7FFF) << 1 | np.logical_or.reduceat(twice, head)).astype(np.uint16)
    bucket = (cores >> np.uint64(64 - bucket_bits)).astype(np.int64)
    cuts = _runs(bucket)
    sides = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(cores)], strict=True))
    parts = [pa.array([x[a:b].tobytes() for a, b in sides], pa.binary()) for x in (cores, wholes, notes)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array(np.full(len(cuts), x, np.int64)) for x in (chunk, mark)), *parts], names=[c.split()[0] for c in CORES.split(", ")])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _judge(table: pa.Table, most: int) -> pa.Table:
    """What each chunk has to know of its cores that stand elsewhere, too."""
    cores, wholes, notes = _joined(table["cores"], np.uint64), _joined(table["wholes"], np.uint64), _joined(table["notes"], np.uint16).astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), [len(x.as_py()) // 8 for x in table["cores"]])
    order = np.argsort(cores, kind="stable")
    head = _runs(cores[order])
    size = np.diff(np.append(head, len(order)))
    least, greatest = (f.reduceat(wholes[order], head) for f in (np.minimum, np.maximum))
    alike = (least == greatest) & (least != 0)
    several = (size > 1) | (np.maximum.reduceat(notes[order] & 1, head) > 0)
    number = np.add.reduceat(notes[order] >> 1, head)
    said = np.where(alike, np.where(several, ONE, 0), np.where(number > most, MANY, DIFFERENT)).astype(np.uint8)
    status = np.empty(len(cores), np.uint8)
    status[order] = np.repeat(said, size)
    keep = status > 0
    cuts = np.searchsorted(row[keep], np.arange(table.num_rows + 1))
    rows = np.flatnonzero(np.diff(cuts))
    known, status = cores[keep], status[keep]
    parts = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary()) for x in (known, status)]
    return pa.table({"chunk": table["chunk"].take(pa.array(rows)), "digest": table["digest"].take(pa.array(rows)), "cores": parts[0], "status": parts[1]})


class Settled:
    """Per document, from the starts of repeated windows: bytes, removed bytes, removed runs, the hash of the rest and the rest itself."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, rows: np.ndarray, keep: bool):
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, last + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        self.columns: list[list] = [[], [], [], [], [], []]
        for d in rows.tolist():
            a, b = offsets[d], offsets[d + 1]
            here, text = gone[a:b], data[a:b]
            removed = int(np.count_nonzero(here))
            rest = text[~here] if removed else text
            spans = int(here[0]) + int(np.count_nonzero(here[1:] & ~here[:-1])) if removed else 0
            raw = rest.tobytes()
            for column, x in zip(self.columns, (ids[d], int(b - a), removed, spans, hashlib.sha256(raw).hexdigest(), raw if keep else None), strict=True):
                column.append(x)


def _blob(**arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unblob(raw: bytes) -> dict[str, bytes]:
    return pa.ipc.open_stream(raw).read_all().to_pylist()[0]


STEP = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())])
STEP_DDL = "kind int, chunk long, bucket long, a binary, b binary, id long, n_bytes long, n_removed long, n_spans long, sha string, kept binary"
FINISHED, OPEN, STRETCH, WINDOW = range(4)


def _step(kind: int, n: int, **columns) -> pa.Table:
    return pa.table([pa.array(columns.get(f.name, [None] * n) if f.name != "kind" else [kind] * n, f.type) for f in STEP], schema=STEP)


def _settle(left: pa.Table, right: pa.Table, length: int, reach: int, bucket_bits: int, keep: bool) -> pa.Table:
    """Documents that the answers finish; the others with what is known; stretches to be sorted; windows to be counted."""
    table = unpack(left, right["digest"].to_pylist())
    chunk, ids = left["chunk"][0].as_py(), table["id"].to_pylist()
    data, offsets = string_buffers(table["text"])
    cores, status = _joined(right["cores"], np.uint64), _joined(right["status"], np.uint8)
    order = np.argsort(cores)
    cores, status = cores[order], status[order]
    found = stretches(data, offsets, length, reach)
    said = np.zeros(len(found.core), np.uint8)
    if len(cores):
        at = np.minimum(np.searchsorted(cores, found.core), len(cores) - 1)
        said = np.where(cores[at] == found.core, status[at], 0).astype(np.uint8)
    doc = np.searchsorted(offsets, found.first, "right") - 1
    waits = np.zeros(len(ids), bool)
    waits[doc[said > ONE]] = True
    sure = said == ONE
    done = Settled(ids, data, offsets, found.first[sure], found.last[sure], length, np.flatnonzero(~waits), keep)
    out = [_step(FINISHED, len(done.columns[0]), **dict(zip(("id", "n_bytes", "n_removed", "n_spans", "sha", "kept"), done.columns, strict=True)))]
    rows = np.flatnonzero(waits)
    if len(rows):
        begin = offsets[rows]
        shift = np.zeros(len(ids), np.int64)
        shift[rows] = begin - np.concatenate([[0], np.cumsum(offsets[rows + 1] - begin)[:-1]])
        here = waits[doc] & (said > 0)
        raw = table.take(pa.array(rows))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, raw.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(raw)
        blob = _blob(first=(found.first - shift[doc])[here], last=(found.last - shift[doc])[here], whole=found.whole[here], said=said[here])
        out.append(_step(OPEN, 1, chunk=[chunk], a=[sink.getvalue().to_pybytes()], b=[blob]))
        sort = np.flatnonzero(said == DIFFERENT)
        if len(sort):
            own = Stretches(*(x[sort] for x in (found.first, found.last, found.anchor, found.core, found.whole)))
            at, twice, _ = _distinct(own)
            bucket = (own.core[at] >> np.uint64(64 - bucket_bits)).astype(np.int64)
            cuts = _runs(bucket)
            flat, sends = data.tobytes(), []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                k = at[a:b]
                texts = [flat[x:y] for x, y in zip(own.first[k].tolist(), (own.last[k] + length).tolist(), strict=True)]
                sends.append(_blob(core=own.core[k], whole=own.whole[k], size=np.array([len(t) for t in texts], np.int32), anchor=(own.anchor[k] - own.first[k]).astype(np.int32), twice=twice[a:b].astype(np.uint8), text=np.frombuffer(b"".join(texts), np.uint8)))
            out.append(_step(STRETCH, len(sends), chunk=[chunk] * len(sends), bucket=bucket[cuts], a=sends))
        many = np.flatnonzero(said == MANY)
        if len(many):
            n = found.last[many] - found.first[many] + 1
            starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(found.first[many], n)
            sent = dealt(chunk, window_hashes(data, starts, length), bucket_bits)
            out.append(_step(WINDOW, len(sent), chunk=[chunk] * len(sent), bucket=sent["bucket"].to_pylist(), a=sent["hashes"].to_pylist(), b=sent["marks"].to_pylist()))
    release()
    return pa.concat_tables(out)


ANSWER = "chunk long, wholes binary, bits binary, hashes binary"


def _sort(table: pa.Table, length: int) -> pa.Table:
    """Windows of a bucket's stretches that stand in more than one place, for the chunks that sent them."""
    parts = [_unblob(x.as_py()) for x in table["a"]]
    fields = {k: np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in (("core", np.uint64), ("whole", np.uint64), ("size", np.int32), ("anchor", np.int32), ("twice", np.uint8))}
    row = np.repeat(np.arange(len(parts)), [len(p["core"]) // 8 for p in parts])
    text, ends = b"".join(p["text"] for p in parts), np.cumsum(fields["size"].astype(np.int64))
    order = np.lexsort((fields["whole"], fields["core"]))
    core, whole = fields["core"][order], fields["whole"][order]
    new = np.ones(len(order), bool)
    new[1:] = (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])
    head = np.flatnonzero(new)
    first = order[head]
    full = (np.diff(np.append(head, len(order))) > 1) | (np.maximum.reduceat(fields["twice"][order], head) > 0)
    size = fields["size"][first].astype(np.int64)
    starts = np.cumsum(size - length + 1)
    hit = np.repeat(full, size - length + 1)
    group = _runs(core[head]).tolist() + [len(first)]
    k = 0
    while k + 1 < len(group):  # some cores at a time
        upto = k + 1
        while upto + 1 < len(group) and size[group[k] : group[upto + 1]].sum() <= SORT_BYTES:
            upto += 1
        a, b = group[k], group[upto]
        if b - a > 1:
            texts = [text[ends[i] - fields["size"][i] : ends[i]] for i in first[a:b].tolist()]
            begin = starts[a] - (size[a] - length + 1)
            hit[begin : starts[b - 1]] |= repeated(texts, fields["anchor"][first[a:b]].astype(np.int64), length)
        k = upto
    # the answer to a stretch that was sent is that of its first copy
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    n = size - length + 1
    some = np.add.reduceat(hit.astype(np.int64), starts - n) > 0
    chunks, wholes, bits = [], [], []
    cuts = np.searchsorted(row, np.arange(len(parts) + 1))
    for i in range(len(parts)):
        own = which[cuts[i] : cuts[i + 1]]
        own = own[some[own]]
        if len(own):
            chunks.append(table["chunk"][i].as_py())
            wholes.append(fields["whole"][first[own]].tobytes())
            bits.append(b"".join([np.packbits(hit[starts[j] - n[j] : starts[j]]).tobytes() for j in own.tolist()]))
    release()
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "wholes": pa.array(wholes, pa.binary()), "bits": pa.array(bits, pa.binary()), "hashes": pa.nulls(len(chunks), pa.binary())})


def _count(table: pa.Table) -> pa.Table:
    """Hashes of windows that stand in more than one place, for the chunks that sent them."""
    hashes, marks, row = unpacked(pa.table({"hashes": table["a"], "marks": table["b"]}))
    yes = counted_twice(hashes, marks)
    hashes, row = hashes[yes], row[yes]
    cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
    rows = np.flatnonzero(np.diff(cuts))
    return pa.table({"chunk": table["chunk"].take(pa.array(rows)), "wholes": pa.nulls(len(rows), pa.binary()), "bits": pa.nulls(len(rows), pa.binary()), "hashes": pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary())})


def _finish(left: pa.Table, right: pa.Table, length: int, keep: bool) -> list[list]:
    table = pa.ipc.open_stream(left["a"][0].as_py()).read_all()
    known = _unblob(left["b"][0].as_py())
    first, last, whole, said = (np.frombuffer(known[k], kind) for k, kind in (("first", np.int64), ("last", np.int64), ("whole", np.uint64), ("said", np.uint8)))
    data, offsets = string_buffers(table["text"])
    starts = [np.zeros(0, np.int64)]
    sort = np.flatnonzero(said == DIFFERENT)
    by_whole: dict[int, list[int]] = {}
    for k in sort.tolist():
        by_whole.setdefault(int(whole[k]), []).append(k)
    for wholes, bits in zip(right["wholes"].to_pylist(), right["bits"].to_pylist(), strict=True):
        at = 0
        for w in np.frombuffer(wholes, np.uint64).tolist() if wholes else ():
            own = by_whole[w]
            n = int(last[own[0]] - first[own[0]]) + 1
            size = -(-n // 8)
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, size, at), count=n))
            at += size
            starts += [hit + first[k] for k in own]
    many = np.flatnonzero(said == MANY)
    if len(many):
        twice = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in right["hashes"].to_pylist() if x] or [np.zeros(0, np.uint64)]))
        n = last[many] - first[many] + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[many], n)
        if len(twice):
            hashes = window_hashes(data, at, length)
            place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            starts.append(at[twice[place] == hashes])
    single = np.concatenate(starts)
    sure = said == ONE
    done = Settled(table["id"].to_pylist(), data, offsets, np.concatenate([first[sure], single]), np.concatenate([last[sure], single]), length, np.arange(table.num_rows), keep)
    release()
    return done.columns


def deduplicate(docs: DataFrame, length: int = LENGTH, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, max_stretches: int = MAX_STRETCHES, chunk_rows: int = 4096, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) if asked for."""
    if reach < 1 or reach + TRIGGER > length:
        raise ValueError("a window must hold the reach and a trigger")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bucket_bits = max(1, (buckets_for(spark, text_bytes(docs, text_col), 8 << 20) - 1).bit_length())

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, texts in chunked(batches, chunk_rows, chunk_bytes):
            found = stretches(*string_buffers(pa.array(texts, pa.large_string())), length, reach)
            if len(found.core):
                yield _ask(chunk, digest(ids, texts), found, bucket_bits)

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(batches, chunk_rows, chunk_bytes)

    answers = source.mapInArrow(ask, CORES).groupBy("bucket").applyInArrow(lambda table: _judge(table, max_stretches), "chunk long, digest long, cores binary, status binary")
    settle = lambda left, right: _settle(left, right, length, reach, bucket_bits, keep_bytes)
    path = shared_path(spark, "suffix-steps")
    source.mapInArrow(packed, PACKED).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, STEP_DDL).write.option("compression", "zstd").parquet(path)
    steps = spark.read.schema(STEP_DDL).parquet(path)
    sorted_ = steps.where(F.col("kind") == STRETCH).select("bucket", "chunk", "a").groupBy("bucket").applyInArrow(lambda table: _sort(table, length), ANSWER)
    counted = steps.where(F.col("kind") == WINDOW).select("bucket", "chunk", "a", "b").groupBy("bucket").applyInArrow(_count, ANSWER)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    types = ["long", "long", "long", "long", "string"] + ["binary"] * keep_bytes
    arrow = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_bytes

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(_finish(left, right, length, keep_bytes), arrow, strict=False)], names=names)

    rest = steps.where(F.col("kind") == OPEN).select("chunk", "a", "b").groupBy("chunk").cogroup(sorted_.unionAll(counted).groupBy("chunk")).applyInArrow(finish, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    ready = steps.where(F.col("kind") == FINISHED).select(*(F.col(c).alias(n) for c, n in zip(["id", "n_bytes", "n_removed", "n_spans", "sha", "kept"], names, strict=False)))
    return ready.unionAll(rest)
