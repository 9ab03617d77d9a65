"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits (in lower case) and of non-ASCII bytes. The texts of
the benchmark, if they keep to BLOCK_BYTES, go to every task with the Karp-Rabin hashes of all
their runs of ``min_tile`` tokens. Each document's own running hashes are looked up among them:
shared runs are the seeds, and only pairs of document and item with enough seeds go on. There the
longest match of tokens that are marked on neither side is marked as a tile, again and again, until
no match of ``min_tile`` tokens is left; the share of the item's tokens under tiles is its
coverage. As tiles may lie in any order, reordered passages are found too. A benchmark of more
than BLOCK_BYTES is not sent: its seeds are joined to the documents' by hash, in one pass over the
documents, and the texts of the pairs that share enough are joined for tiling.

Nulls: null texts have no tokens and match nothing; a null item or document id is passed through.
Items of fewer than ``min_tile`` tokens match as a whole only, those without tokens never. Very
long texts are scanned whole, repeated rows give repeated results, ties between equally long
matches go to the earliest in the item, then in the document. Empty tables give empty results.
Extra columns pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rollmill.llm.cluster import checkpointed
from rollmill.llm.filters import FILTER_BITS, bit_filter, passes
from rollmill.llm.textkernel import BYTE_BASE, WORD_BASE, Words, _BYTE_VALUE, groups, mix, span_hashes, spans, windows
from rollmill.llm.tidy import tidy

MIN_TILE, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are broadcast at most.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20
#: Seeds that are held at once while they are joined to runs.
PAIRS = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CUT = np.ones(256, bool)
_CUT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def token_groups(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[Words, np.ndarray]]:
    for rows, data, offsets in groups(column):
        data = _FOLD[data]
        starts, ends = spans(data, offsets, _CUT[data])
        words = Words(data, rows, offsets, starts, ends, np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:]))
        yield words, span_hashes(_BYTE_VALUE[data], BYTE_BASE, starts, ends)


@dataclass
class Block:
    """The items of a block and where each run of tokens stands in them, by length of run."""

    items: list
    tokens: list[np.ndarray]
    min_tile: int
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def block_of(items: list, texts: list[str | None], min_tile: int = MIN_TILE) -> Block:
    tokens: list[np.ndarray] = []
    for words, hashes in token_groups(pa.array(texts, pa.string())):
        tokens += [hashes[a:b] for a, b in zip(words.first, words.last, strict=True)]
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, t in enumerate(tokens):
        if len(t):
            n = min(min_tile, len(t))
            starts = np.arange(len(t) - n + 1)
            found.setdefault(n, []).append((span_hashes(t, WORD_BASE, starts, starts + n), i))
    seeds = {}
    for n, parts in found.items():
        hashes = np.concatenate([h for h, _ in parts])
        item = np.concatenate([np.full(len(h), i, np.int64) for h, i in parts])
        at = np.concatenate([np.arange(len(h)) for h, _ in parts])
        order = np.lexsort((at, item, hashes))
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        seeds[n] = hashes[order], item[order], at[order], table
    return Block(items, tokens, min_tile, seeds)


def tile(i: np.ndarray, j: np.ndarray, n: int, item_len: int, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, length) from seeds of n tokens at (i, j)."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
    cuts = np.flatnonzero(new)
    return tile_runs(i[cuts], j[cuts], np.diff(np.append(cuts, len(i))) + n - 1, item_len, least)


def tile_runs(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, item_len: int, least: int) -> list[tuple[int, int, int]]:
    """The same from the longest matches themselves, ``sizes`` tokens at (i, j)."""
    from_doc = int(j.min())
    in_item, in_doc = np.zeros(item_len, bool), np.zeros(int((j + sizes).max()) - from_doc, bool)
    order = np.lexsort((j, i, -sizes))
    heap = list(zip((-sizes[order]).tolist(), i[order].tolist(), j[order].tolist(), strict=True))  # sorted, so a heap already
    out, room = [], item_len
    while heap and room >= least:
        size, a, b = heapq.heappop(heap)
        size = -size
        taken = in_item[a : a + size] | in_doc[b - from_doc : b - from_doc + size]
        if not taken.any():
            in_item[a : a + size] = in_doc[b - from_doc : b - from_doc + size] = True
            room -= size
            out.append((a, b, size))
            continue
        edges = np.flatnonzero(np.diff(taken.astype(np.int8), prepend=1, append=1))
        for k, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - k >= least:  # what is left of an occluded match competes again
                heapq.heappush(heap, (-(e - k), a + k, b + k))
    return out


def _runs(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of seeds (``seeds`` of them, one token apart, from (i, j)) with those that go on where another ends made one."""
    order = np.lexsort((i, j - i, item, doc))
    doc, item, i, j, seeds = (x[order] for x in (doc, item, i, j, seeds))
    new = np.ones(len(i), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + seeds[:-1])
    cuts = np.flatnonzero(new)
    return doc[cuts], item[cuts], i[cuts], j[cuts], np.add.reduceat(seeds, cuts) if len(cuts) else seeds


def _seed_runs(words: Words, hashes: np.ndarray, n: int, block: Block) -> tuple[np.ndarray, ...] | None:
    """(document, item, start in the item, start in the document, seeds) of the runs of seeds of n tokens.

    A token run that stands often on both sides has a seed for each pair of places; they are made
    some at a time and joined to runs at once, so only the runs are held.
    """
    seed, item, at, table = block.seeds[n]
    starts, found = windows(words, hashes, n)
    maybe = np.flatnonzero(table[(found >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    low = np.searchsorted(seed, found[maybe], "left")
    count = np.searchsorted(seed, found[maybe], "right") - low
    starts, low, count = starts[maybe][count > 0], low[count > 0], count[count > 0]
    if not len(starts):
        return None
    doc = words.doc_of_word()[starts]
    place = starts - words.first[doc]
    upto = np.cumsum(count)
    parts, x = [], 0
    while x < len(starts):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(x, y), count[x:y])
        pick = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count[x:y]) - count[x:y], count[x:y])
        parts.append(_runs(doc[own], item[pick], at[pick], place[own], np.ones(len(own), np.int64)))
        x = y
    return parts[0] if len(parts) == 1 else _runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def matches(column: pa.Array | pa.ChunkedArray, block: Block, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, longest tile) of the pairs that reach the coverage."""
    for words, hashes in token_groups(column):
        for n in block.seeds:
            runs = _seed_runs(words, hashes, n, block)
            if runs is None:
                continue
            doc, item, i, j, seeds = runs
            length = seeds + n - 1
            cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
                size = len(block.tokens[item[a]])
                covered = np.zeros(size + 1, np.int64)
                np.add.at(covered, i[a:b], 1)
                np.add.at(covered, i[a:b] + length[a:b], -1)
                if np.count_nonzero(np.cumsum(covered)[:-1]) < coverage * size:
                    continue  # not even all seeds together cover enough
                tiles = tile_runs(i[a:b], j[a:b], length[a:b], size, min(block.min_tile, size))
                share = sum(s for _, _, s in tiles) / size
                if share >= coverage:
                    yield int(words.rows[doc[a]]), int(item[a]), share, len(tiles), max(s for _, _, s in tiles)


def whole_block(benchmark: DataFrame, min_tile: int, item_col: str, text_col: str) -> Block | None:
    """The benchmark as one block, if it keeps to BLOCK_BYTES."""
    some = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = some.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    if total > BLOCK_BYTES:
        return None
    part: pd.DataFrame = some.toPandas()
    part = part.sort_values(["item", "text"], kind="stable")
    return block_of([None if pd.isna(x) else x for x in part["item"]], list(part["text"]), min_tile)


@tidy
def _item_seeds(batches: Iterator[pa.RecordBatch], min_tile: int) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of items, with how many tokens they can cover at most; an item is named by its row."""
    for batch in batches:
        for words, hashes in token_groups(batch.column("text")):
            parts = []
            for d in np.flatnonzero(words.counts > 0):
                size = int(words.counts[d])
                n = min(min_tile, size)
                starts = np.arange(words.first[d], words.last[d] - n + 1)
                seeds, times = np.unique(span_hashes(hashes, WORD_BASE, starts, starts + n), return_counts=True)
                parts.append((seeds, times * n, np.full(len(seeds), words.rows[d]), np.full(len(seeds), size), np.full(len(seeds), n)))
            if parts:
                seeds, covers, rows, sizes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), batch.column("row").take(pa.array(rows)), pa.array(covers.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(n.astype(np.int32))], names=["seed", "row", "covers", "size", "n"])


@tidy
def _doc_seeds(batches: Iterator[pa.RecordBatch], lengths: list[int], sent) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of documents that pass the filter of the items' seeds."""
    for batch in batches:
        for words, hashes in token_groups(batch.column("text")):
            for n in lengths:
                starts, found = windows(words, hashes, n)
                keep = np.flatnonzero(passes(sent.value, found, FILTER_BITS))
                if len(keep):
                    doc, found = words.doc_of_word()[starts[keep]], found[keep]
                    first = np.unique(mix(found ^ mix(doc.astype(np.uint64))), return_index=True)[1]
                    rows = pa.array(words.rows[doc[first]])
                    yield pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), batch.column("id").take(rows), batch.column("th").take(rows)], names=["seed", "id", "th"])


def joined_pairs(docs: DataFrame, benchmark: DataFrame, min_tile: int, coverage: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """id, th, item, coverage, n_tiles, longest_tile of the pairs that reach the coverage, for a benchmark of any size.

    The seeds of items and documents are joined by hash; a bit filter of fixed size keeps the
    documents' other seeds at home. Only pairs whose shared seeds could cover enough are tiled, with
    their texts joined to them. th is the hash of the document's text.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    items = checkpointed(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())).withColumn("row", F.monotonically_increasing_id())
    seeds = checkpointed(items.select("row", "text").mapInArrow(partial(_item_seeds, min_tile=min_tile), "seed long, row long, covers long, size long, n int"))
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # at most min_tile
    sent = spark.sparkContext.broadcast(bit_filter(seeds.select("seed"), "seed"))
    hits = source.mapInArrow(partial(_doc_seeds, lengths=lengths, sent=sent), "seed long, id long, th long").distinct()
    shared = hits.join(seeds.drop("n"), "seed").groupBy("id", "th", "row").agg(F.sum("covers").alias("covers"), F.first("size").alias("size"))
    pairs = checkpointed(shared.where(F.col("covers") >= F.lit(coverage) * F.col("size")).select("id", "th", "row"))
    texts = source.dropDuplicates(["id", "th"]).alias("d").join(pairs.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & F.col("d.th").eqNullSafe(F.col("p.th")))
    both = texts.join(items.withColumnRenamed("text", "item_text").alias("i"), F.col("p.row") == F.col("i.row")).select("d.id", "d.th", "d.text", "item", "item_text")

    @tidy
    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, (text, item) in enumerate(zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True)):
                found += [(k, *m[2:]) for m in matches(pa.array([text], pa.large_string()), block_of([0], [item], min_tile), coverage)]
            if found:
                rows, *figures = zip(*found, strict=True)
                at = pa.array(rows, pa.int64())
                kinds = (pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "th", "item")), *(pa.array(x, t) for x, t in zip(figures, kinds, strict=True))], names=["id", "th", "item", "coverage", "n_tiles", "longest_tile"])

    return both.mapInArrow(tiled, f"id long, th long, item {benchmark.schema[item_col].dataType.simpleString()}, coverage double, n_tiles int, longest_tile int")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc id, item_id, coverage, n_tiles, longest_tile of every pair that reaches the coverage."""
    kind = benchmark.schema[item_col].dataType
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = [id_col, "item_id", "coverage", "n_tiles", "longest_tile"]
    block = whole_block(benchmark, min_tile, item_col, item_text_col)
    if block is None:
        pairs = joined_pairs(docs, benchmark, min_tile, coverage, id_col, text_col, item_col, item_text_col)
        rows = source.select(F.col("id"), F.xxhash64("text").alias("th")).alias("r")
        own = rows.join(pairs.alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & F.col("r.th").eqNullSafe(F.col("p.th")))
        return own.select("r.id", "item", "coverage", "n_tiles", "longest_tile").toDF(*names)
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kinds = (pa.int64(), to_arrow_type(kind), pa.float64(), pa.int32(), pa.int32())

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            ids = batch.column("id")
            rows = [(ids[r].as_py(), b.items[i], c, k, s) for r, i, c, k, s in matches(batch.column("text"), b, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return source.mapInArrow(find, f"{id_col} long, item_id {kind.simpleString()}, coverage double, n_tiles int, longest_tile int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that cover a benchmark item; with a benchmark of one block, no exchange of rows."""
    block = whole_block(benchmark, min_tile, item_col, item_text_col)
    if block is None:
        found = joined_pairs(docs, benchmark, min_tile, coverage, id_col, text_col, item_col, item_text_col).select(F.col("id").alias("__i"), F.col("th").alias("__t")).distinct()
        return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(text_col)) == F.col("__t")), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.ones(len(batch), bool)
            for row, *_ in matches(batch.column(text_col), sent.value, coverage):
                mask[row] = False
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)
