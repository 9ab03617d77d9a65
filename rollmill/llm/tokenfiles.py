"""Token ids in Arrow files of fixed-size-list batches.

Documents are encoded whole, an end id closes each, and the ids of a run of documents (a shard:
a range of ids in ascending order) are cut into sequences of equal length. A shard is one Arrow
IPC file (the stream format with a footer) of two columns, ``ids`` fixed_size_list<uint16 or
uint32>[L] and ``mask`` fixed_size_list<bool>[L] (false on the padding that ends a shard), not
compressed, so that a reader maps the file and finds sequence k of a batch at a computable byte.
Beside it lies an Arrow file with the id, start and length of each document.

Files go to a folder all executors share, under a name of the task's own; the driver's manifest
lists those of the attempts that succeeded, so that lost executors and repeated attempts leave
the result whole.

Encoding goes word by word through a bounded cache: the tokenizer drops white space and no merge
or normalisation crosses it, so the ids of a text are those of its words in turn.

Nulls: a null text is encoded as the empty text (the end id alone), null ids sort first. Empty
tables give no files and an empty result. Rows of one id follow each other in the order of their
texts. Extra input columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.cluster import buckets_for, shared_path, text_bytes
from rollmill.llm.tidy import tidy

END_ID = 2
SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
#: Words of each of the cache's two generations.
CACHE_WORDS = 250_000
ENCODE_ROWS = 256

#: Words of a-z, ß-ö and ø-ÿ in UTF-8, and a mark or none.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?]?)")
#: The byte-level alphabet of these letters' bytes: printable Latin-1 stands for itself, other bytes for 256 and on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """ids of texts as bytes of little-endian unsigned integers; one per tokenizer and process.

    Unknown words go to the tokenizer many at a time, kept apart by a control character that is a
    token of its own. Words in the cache are in ASCII lower case, as the tokenizer lowers all text
    but its special tokens; texts that may hold such a token are encoded directly.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.specials = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = all(self._ids(x) == self._ids("a") + self._ids("b.") for x in ("a b.", "a\tb.", "A  B.\n")) and len(self._ids(self.SEPARATOR)) == 1
        self.mark = self._ids(self.SEPARATOR)[0]
        self.model = self.tokenizer.model
        self.marks = {m.encode(): self.direct(m) for m in ".,;:!?"}
        # the shortcut holds for this tokenizer only if it gives these words the same ids
        tests = ["a", "word", "unbelievably", "thes", "word.", "a,", "ing?", "zzxqy!", "i;", "ll:", "s", "re.", "é", "straße", "über,", "ñandú", "àâçèêëîïôûœ"[:10], "ÿö."]
        self.cache: dict[bytes, bytes] = {}
        self.by_word = self.by_word and all(self._plain(w.encode()) and self.cache[w.encode()] == self.direct(w) for w in tests)
        self.cache = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def direct(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        new = []
        for word in words:
            if word not in self.cache:
                if (ids := self.older.get(word)) is not None:
                    self.cache[word] = ids
                else:
                    new.append(word)
        new = [word for word in new if not self._plain(word)]
        for i in range(0, len(new), 256):
            part = new[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.SEPARATOR} ".join([w.decode() for w in part])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * self.kind.itemsize
            flat, at = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.cache[word] = flat[at:end]
                at = end + self.kind.itemsize

    def _plain(self, word: bytes) -> bool:
        """Keeps the ids of a word of lower-case Latin-1 letters, with or without one mark at its end; false for others.

        Such letters are a piece of their own to every step before the merges, which changes nothing but
        the alphabet their bytes are written in, and so is a mark after them.
        """
        found = _PLAIN.fullmatch(word) if self.by_word else None
        if not found:
            return False
        stem, mark = found.groups()
        text = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(_BYTE_LEVEL)
        self.cache[word] = np.array([t.id for t in self.model.tokenize(text)], self.kind).tobytes() + self.marks.get(mark, b"")
        return True

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[bytes] | None] = []
        for text in texts:
            raw = (text or "").encode().lower()
            plain = self.by_word and b"\x01" not in raw and not any(x in raw for x in self.specials)
            split.append(raw.split() if plain else None)  # at the six ASCII white-space bytes
        self.learn(set().union(*[w for w in split if w]))
        known = self.cache.__getitem__
        return [b"".join(map(known, words)) if words is not None else self.direct(text) for words, text in zip(split, texts, strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Packs documents into sequences, and writes them batch by batch."""

    def __init__(self, folder: str, shard: int, kind: np.dtype, length: int):
        self.fs, self.root = file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        stem = f"{shard:06d}-{uuid.uuid4().hex}"
        self.shard, self.kind, self.length = shard, kind, length
        self.names = {"ids": f"ids-{stem}.arrow", "docs": f"docs-{stem}.arrow"}
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, nullable=False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), False)])
        self.sink = self.fs.open_output_stream(f"{self.root}/{self.names['ids']}")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.pending = 0
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.tokens = self.sequences = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.ids.append(doc_id)
        self.starts.append(self.tokens)
        self.counts.append(n)
        self.tokens += n
        self.parts.append(ids)
        self.pending += n
        if self.pending >= self.length * SEQUENCES_PER_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.kind)
        rows = -(-len(flat) // self.length) if last else len(flat) // self.length
        rest = b"" if last else flat[rows * self.length :].tobytes()
        real = min(len(flat), rows * self.length)
        for at in range(0, rows, SEQUENCES_PER_BATCH):
            n = min(SEQUENCES_PER_BATCH, rows - at)
            values, mask = np.zeros(n * self.length, self.kind), np.zeros(n * self.length, bool)
            here = flat[at * self.length : min(real, (at + n) * self.length)]
            values[: len(here)] = here
            mask[: len(here)] = True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((values, mask))]
            self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += rows
        self.parts, self.pending = ([rest] if rest else []), len(rest) // self.kind.itemsize

    def close(self) -> dict:
        self._flush(True)
        self.out.close()
        self.sink.close()
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.root}/{self.names['docs']}") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        return {"shard": self.shard, "ids_file": self.names["ids"], "docs_file": self.names["docs"], "n_docs": len(self.ids), "n_tokens": self.tokens, "n_sequences": self.sequences}


MANIFEST = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long, n_sequences long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents and write them in ascending id order; returns the manifest, a row for each shard, with the ``offset`` of its first id.

    One exchange of the texts, to shards at approximate quantiles of the id; a shard's documents
    are sorted, encoded and written by one task that holds one batch of sequences at a time.
    """
    spark = docs.sparkSession
    n = buckets_for(spark, text_bytes(docs, text_col), 64 << 20)
    cuts = docs.select(F.percentile_approx(F.col(id_col), [i / n for i in range(1, n)] or [0.5], 20_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # the shard of an id: how many cuts are at or below it
    shard = F.when(F.col(id_col).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(id_col)))) if cuts else F.lit(0)

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, out, done = encoder(tokenizer), None, None, []
        end = np.array([end_id], code.kind).tobytes()
        for batch in batches:
            for part in range(0, len(batch), ENCODE_ROWS):
                rows = batch.slice(part, ENCODE_ROWS)
                for at, doc_id, ids in zip(rows.column("shard").to_pylist(), rows.column("id").to_pylist(), code.encode_all(rows.column("text").to_pylist()), strict=True):
                    if out is None or out.shard != at:
                        if out is not None:
                            done.append(out.close())
                        out = SequenceWriter(folder, at, code.kind, length)
                    out.add(doc_id, ids + end)
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    dealt = docs.select(shard.cast("int").alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionById(len(cuts) + 1, F.col("shard"))
    rows = sorted(dealt.sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), F.col("text")).mapInArrow(write, MANIFEST).collect())
    listed, offset = [], 0
    for row in rows:
        listed.append((*row, offset))
        offset += row["n_tokens"]
    return spark.createDataFrame(listed, MANIFEST + ", offset long")


def read_shard(folder: str, ids_file: str, docs_file: str) -> tuple[pa.Table, list[np.ndarray]]:
    """The documents' table and the flat ids of each batch, mapped where the file system is local."""
    system, root = file_system(folder)

    def opened(name: str) -> pa.ipc.RecordBatchFileReader:
        path = f"{root}/{name}"
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path))

    ids = opened(ids_file)
    flats = [ids.get_batch(i).column("ids").flatten().to_numpy() for i in range(ids.num_record_batches)]
    return opened(docs_file).read_all(), flats


def sequence(folder: str, ids_file: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the k-th sequence of a file, read by position."""
    system, root = file_system(folder)
    path = f"{root}/{ids_file}"
    reader = pa.ipc.open_file(pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path))
    batch = reader.get_batch(k // SEQUENCES_PER_BATCH)
    return tuple(batch.column(c)[k % SEQUENCES_PER_BATCH].values.to_numpy(zero_copy_only=False) for c in ("ids", "mask"))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, flats = read_shard(folder, row["ids_file"], row["docs_file"])
                bounds = np.cumsum([0] + [len(x) for x in flats])
                starts, counts = table["start"].to_numpy(), table["n_tokens"].to_numpy()
                crcs = np.zeros(len(starts), np.int64)
                for i, (a, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    crc, k = 0, int(np.searchsorted(bounds, a, "right")) - 1
                    while n > 0:
                        part = flats[k][a - bounds[k] : a - bounds[k] + n]
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        a, n, k = a + len(part), n - len(part), k + 1
                    crcs[i] = crc
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(starts + row["offset"]), pa.array(counts), pa.array(crcs), pa.array(np.full(len(starts), row["shard"], np.int32))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_table(docs: DataFrame, tokenizer: str, locate: Callable[[], str] | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = locate() if locate else shared_path(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, folder, tokenizer), folder)
