"""Chunks: runs of rows of an input partition that two passes over one input cut alike.

A pass names a chunk by partition and place; a digest of its rows travels along, so that a later
pass that does not meet the same rows fails and does not mix them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20


def chunked(batches: Iterator[pa.RecordBatch], max_rows: int = CHUNK_ROWS, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, list[int | None], list[str | None]]]:
    """(chunk, ids, texts), cut by rows and bytes alone and not by how the rows came in batches."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text) if text else 0
            if len(ids) >= max_rows or held >= max_bytes:
                yield part << 32 | k, ids, texts
                ids, texts, held, k = [], [], 0, k + 1
    if ids:
        yield part << 32 | k, ids, texts


def digest(ids: list, texts: list) -> int:
    out = hashlib.blake2b(digest_size=8)
    for doc_id, text in zip(ids, texts, strict=True):
        out.update(f"{doc_id}\0{-1 if text is None else len(text)}\0".encode())
        if text:
            out.update(text[:64].encode())
    return int.from_bytes(out.digest(), "little", signed=True)


PACKED = "chunk long, digest long, docs binary"


def pack(batches: Iterator[pa.RecordBatch], max_rows: int = CHUNK_ROWS, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its name, digest and compressed rows."""
    for chunk, ids, texts in chunked(batches, max_rows, max_bytes):
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield pa.RecordBatch.from_pydict({"chunk": [chunk], "digest": [digest(ids, texts)], "docs": [sink.getvalue().to_pybytes()]})


def unpack(left: pa.Table, digests: list[int]) -> pa.Table:
    """A packed chunk's rows (id, text), if all answers were asked for by the same rows."""
    if left.num_rows != 1 or any(d != left["digest"][0].as_py() for d in digests):
        raise RuntimeError("the input was not read the same way twice; write it as a table first")
    return pa.ipc.open_stream(left["docs"][0].as_py()).read_all()
