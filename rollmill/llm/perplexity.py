"""Quality rules on whole texts, and n-gram perplexity bands by language.

The language model is an interpolated modified Kneser-Ney model of character ORDER-grams, in every
script: a symbol is a code point, but that white space of any length is one blank, all decimal
digits of ASCII are one symbol, and a mark ends each text. Spark counts the n-grams of all distinct
texts of each language; continuation counts, discounts, the masses of contexts and the
interpolation from single symbols up are aggregates and joins over tables of n-grams. Every n-gram
that is scored was counted, so the model is one table: the 64-bit hash of language and n-gram, and
its log probability. It is sent out as sorted hash arrays while it has at most MODEL_ENTRIES; a
larger one goes out in ranges of hashes, a pass over the texts for each, whose sums add up.

A document's verdict: its bits per symbol must lie within the band of its language, the median of
that language's distinct texts plus and minus a multiple of their spread (medians of the deviations
below and above, a quarter of the spread of single symbols at least), which widens for short texts as
the variance of a mean does. Copies count once in model, median and spreads: a text that half of a
language's rows hold neither draws the band to itself nor leaves it.

Nulls and texts without words have no words and fail the base rules; a null language is one of its
own. Repeated rows are treated alike. Languages of few documents have wide bands of their own.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.llm.cluster import checkpointed
from rollmill.llm.filters import FILTER_BITS, bit_filter, passes
from rollmill.llm.textkernel import BYTE_BASE, _BYTE_VALUE, groups, mix, places, span_hashes, spans, windows, SPACE, Words
from rollmill.llm.tidy import tidy

ORDER = 5
#: n-grams that one broadcast holds at most, 12 bytes each.
MODEL_ENTRIES = 1 << 23
#: Marks before and after each text, the blank and the digit (code points).
BEFORE, END, BLANK, DIGIT = 2, 3, 32, 48
#: Distinct n-grams of a language that a task holds before it sends them on.
HELD = 1 << 21
#: Half-width of a band in spreads.
SPREADS = 3.5
#: A spread is at least this share of the standard deviation of a symbol's bits .
LEAST_SHARE = 0.25

GRAM_BASE = 0xC2B2AE3D27D4EB4F


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (code points) of a group of texts, each after ORDER - 1 marks and before one, and the bounds of the texts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    bounds = heads[offsets]
    small = points < 128
    blank = small & SPACE[np.where(small, points, 0)]
    points = np.where(blank, BLANK, np.where((points >= 48) & (points <= 57), DIGIT, points)).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[bounds[:-1][bounds[:-1] < len(points)]] = True
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    points, bounds = points[keep], kept[bounds]
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(points) + ORDER * n, BEFORE, np.uint32)
    out[np.arange(len(points)) + ORDER * text + ORDER - 1] = points
    bounds = bounds + ORDER * np.arange(n + 1)
    out[bounds[1:] - 1] = END
    return out, bounds


def gram_hashes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the ORDER symbols that end at each place from ORDER - 1 on."""
    out = np.zeros(max(len(symbols) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        out *= np.uint64(GRAM_BASE)
        out += symbols[k : len(symbols) - ORDER + 1 + k].astype(np.uint64) + np.uint64(1)
    return out


def language_hash(lang: str | None) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(b"0" if lang is None else b"1" + lang.encode(), digest_size=8).digest(), "little"))


def key_of(hashes: np.ndarray, lang: np.ndarray | np.uint64) -> np.ndarray:
    return mix(hashes ^ lang)


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, hashes, where each text's n-grams start among the hashes, how many they are); hashes between texts are no n-grams."""
    symbols, bounds = symbols_of(data, offsets)
    return symbols, gram_hashes(symbols), bounds[:-1], np.diff(bounds) - ORDER + 1


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


Grams = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged(parts: list[Grams]) -> Grams:
    """Distinct hashes with their counts and symbols."""
    hashes, counts, symbols = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    cuts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[cuts], np.add.reduceat(counts, cuts), symbols[order[cuts]]


def _as_text(symbols: np.ndarray) -> pa.Array:
    """Rows of ORDER symbols as strings."""
    shown = symbols.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return pa.array([shown[k : k + ORDER] for k in range(0, len(shown), ORDER)], pa.string())


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[Grams]] = {}

    def sent(name: str | None) -> pa.RecordBatch:
        _, counts, symbols = _merged(held.pop(name))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), _as_text(symbols), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        codes, names = _languages(batch.column("lang"))
        for rows, data, offsets in groups(batch.column("text")):
            symbols, hashes, first, sizes = text_grams(data, offsets)
            for k in np.unique(codes[rows]):
                mine = np.flatnonzero(codes[rows] == k)
                at = np.repeat(first[mine] - np.cumsum(sizes[mine]) + sizes[mine], sizes[mine]) + np.arange(sizes[mine].sum())
                own = hashes[at]
                order = np.argsort(own)
                own = own[order]
                cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                places = at[order[cuts]]
                parts = held.setdefault(names[k], [])
                parts.append((own[cuts], np.diff(np.append(cuts, len(own))), symbols[places[:, None] + np.arange(ORDER)]))
                if len(parts) >= 8:
                    parts[:] = [_merged(parts)]
                    if len(parts[0][0]) > HELD:
                        yield sent(names[k])
    for name in list(held):
        yield sent(name)


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n: the ORDER-grams of all texts."""
    counted = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def count_distinct(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ORDER-grams of the distinct texts of each language.

    Texts whose hash no other row has are counted where they lie; a bit filter of fixed size tells
    them. Only the others, and a few strangers that the filter lets through, meet in an exchange.
    """
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("h", F.xxhash64("lang", "text"))
    again = source.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(again, "h"))

    def part(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(sent.value, batch.column("h").to_numpy().view(np.uint64), FILTER_BITS)
            yield batch.filter(pa.array(hit == shared)).drop_columns(["h"])

    alone = source.mapInArrow(tidy(lambda batches: _count(part(batches, False))), "lang string, gram string, n long")
    copies = source.mapInArrow(tidy(partial(part, shared=True)), "text string, lang string").distinct()
    both = alone.unionAll(copies.mapInArrow(_count, "lang string, gram string, n long"))
    return both.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, gram, log2p of every counted ORDER-gram, under the interpolated modified Kneser-Ney model.

    Lower orders count the distinct longer n-grams that end in them. Each order has three discounts
    of each language, from its numbers of n-grams of one to four; where one of these is 0, fixed
    ones. Contexts are grouped by (language, context), of at most as many rows as there are symbols.
    """
    # all orders go through one plan: lengths are taken from the n-grams, so Spark compiles it once
    shorter, context = F.substring("gram", F.lit(2), F.length("gram")), F.substring("gram", F.lit(1), F.length("gram") - 1)
    levels = [checkpointed(counts.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("l"), "gram", "n"))]
    for _ in range(ORDER - 1):
        levels.append(checkpointed(levels[-1].groupBy("l", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    below = levels[-1].groupBy("l").agg(F.lit("").alias("suffix"), (F.lit(1.0) / F.count(F.lit(1))).alias("lower"))
    while levels:
        level = levels.pop()
        singles = level.groupBy("l").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        known = F.least("n1", "n2", "n3", "n4") > 0
        cuts = [F.when(known, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05))).otherwise(fixed).alias(f"d{k}") for k, fixed in ((1, 0.5), (2, 0.75), (3, 0.9))]
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(singles.select("l", *cuts), "l").select("l", "gram", "n", cut.alias("cut"), context.alias("context"), shorter.alias("suffix"))
        masses = rows.groupBy("l", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        p = (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) + F.col("mass") * F.col("lower")) / F.col("total")
        below = checkpointed(rows.join(masses, ["l", "context"]).join(below, ["l", "suffix"]).select("l", F.col("gram").alias("suffix"), p.alias("lower")))
    return below.select(F.when(F.col("l") != "0", F.substring("l", 2, 1 << 30)).alias("lang"), F.col("suffix").alias("gram"), F.log2("lower").alias("log2p"))


@tidy
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, names = _languages(batch.column("lang"))
        marks = np.array([language_hash(x) for x in names], np.uint64)
        points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        hashes = np.zeros(len(points), np.uint64)
        for k in range(ORDER):
            hashes = hashes * np.uint64(GRAM_BASE) + points[:, k].astype(np.uint64) + np.uint64(1)
        yield pa.RecordBatch.from_arrays([pa.array(key_of(hashes, marks[codes]).view(np.int64)), batch.column("log2p").cast(pa.float32())], names=["key", "log2p"])


@dataclass
class Model:
    """Log probabilities of n-grams by the sorted hashes of language and n-gram; of a range of hashes, those within."""

    keys: np.ndarray
    log2p: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = places(self.keys, keys)
        return np.where(self.keys[at] == keys, self.log2p[at], np.float32(0))


def model_blocks(counts: DataFrame) -> Iterator[Model]:
    """The model, whole if it has at most MODEL_ENTRIES, else by ranges of hashes of about so many."""
    rows = checkpointed(kneser_ney(counts).mapInArrow(_keys, "key long, log2p float"))
    n = rows.count()
    blocks = -(-n // MODEL_ENTRIES) if n > MODEL_ENTRIES else 1
    head = F.shiftrightunsigned("key", 32)
    for k in range(blocks):
        low, high = (k << 32) // blocks, (k + 1 << 32) // blocks
        part = (rows if blocks == 1 else rows.where((head >= low) & (head < high))).toArrow()
        keys = part["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        yield Model(keys[order], part["log2p"].to_numpy()[order])


_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeats(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash in the same document."""
    key = mix(hashes ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line, by document."""
    starts, ends = spans(data, offsets, _BREAK[data])
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(offsets, starts, "right") - 1
    key = mix(span_hashes(_BYTE_VALUE[data], BYTE_BASE, starts, ends) ^ mix(doc.astype(np.uint64)))
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=len(offsets) - 1)


def base_rules(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends = spans(data, offsets, SPACE[data])
    words = Words(data, np.arange(len(offsets) - 1), offsets, starts, ends, np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:]))
    chars = per_doc(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    at, found = windows(words, words.word_hashes(), 3)
    at = at[repeats(words.doc_of_word()[at], found)]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 3, -1)
    repeated = per_doc(np.cumsum(edge)[:-1] > 0, np.append(words.first, len(starts)))
    return words.counts, chars, per_doc(_SIGNS[data], offsets), duplicate_lines(data, offsets, words), repeated


SCORES = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_keys long, total double, squares double, hash long"


def _rated(batches: Iterator[pa.RecordBatch], sent, base: bool) -> Iterator[pa.RecordBatch]:
    """Sums of the bits and of their squares of every row's n-grams that the block has, and, with ``base``, the base figures."""
    names = [c.split()[0] for c in SCORES.split(", ")]
    for batch in batches:
        codes, langs = _languages(batch.column("lang"))
        marks = np.array([language_hash(x) for x in langs], np.uint64)
        for rows, data, offsets in groups(batch.column("text")):
            _, hashes, first, sizes = text_grams(data, offsets)
            mark = np.zeros(len(hashes), np.uint64)
            spread = np.repeat(marks[codes[rows]], sizes + ORDER - 1)
            mark[:] = spread[: len(hashes)]
            bits = -sent.value.of(key_of(hashes, mark)).astype(np.float64)
            sums = []
            for x in (bits, bits * bits):
                upto = np.append(0.0, np.cumsum(x))
                sums.append(upto[first + sizes] - upto[first])
            figures = base_rules(data, offsets) if base else [np.zeros(len(rows), np.int64)] * 5
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("lang").take(at), *[pa.array(x.astype(np.int64)) for x in figures], pa.array(sizes), *map(pa.array, sums), batch.column("hash").take(at)], names=names)


def score(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base figures of every row, and its bits per symbol (mean and standard deviation) under its language's model."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash"))
    out = None
    for model in model_blocks(counts):
        sent = spark.sparkContext.broadcast(model)
        if out is None:
            out = source.mapInArrow(tidy(partial(_rated, sent=sent, base=True)), SCORES)
            continue
        # a further range of hashes: the sums of each distinct text are added to its rows'
        more = source.mapInArrow(tidy(partial(_rated, sent=sent, base=False)), SCORES).groupBy("lang", "hash").agg(F.min("total").alias("__t"), F.min("squares").alias("__s"))
        joined = out.alias("o").join(more.alias("m"), F.col("o.lang").eqNullSafe(F.col("m.lang")) & F.col("o.hash").eqNullSafe(F.col("m.hash")))
        out = checkpointed(joined.select("o.*", "__t", "__s").withColumn("total", F.col("total") + F.col("__t")).withColumn("squares", F.col("squares") + F.col("__s")).drop("__t", "__s"))
    mean = F.col("total") / F.col("n_keys")
    deviation = F.sqrt(F.greatest(F.col("squares") / F.col("n_keys") - F.col("bits") * F.col("bits"), F.lit(0.0)))
    return out.withColumn("bits", mean).withColumn("deviation", deviation).drop("total", "squares")


def median(rows: DataFrame, key: str, value: Column, step: float, name: str) -> DataFrame:
    """The median of each key to within ``step``, from a histogram: the bins are pre-aggregated and their number is bounded by the values' range."""
    # a table of its own: the bins are added up by key and bin, and only they meet in the key's window
    bins = checkpointed(rows.groupBy(key, F.floor(value / F.lit(step)).alias("__b")).agg(F.count(F.lit(1)).alias("__n")))
    every = W.partitionBy(key)
    ranked = bins.withColumn("__c", F.sum("__n").over(every.orderBy("__b"))).withColumn("__t", F.sum("__n").over(every))
    return ranked.where(2 * F.col("__c") >= F.col("__t")).groupBy(key).agg(((F.min("__b") + 0.5) * F.lit(step)).alias(name))


def judge(docs: DataFrame, spreads: float = SPREADS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per row: id, base figures, base_failed, bits, low and high of its language's band, kept."""
    counts = checkpointed(count_distinct(docs, text_col, lang_col))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = checkpointed(score(docs, counts, id_col, text_col, lang_col)).withColumn("base_failed", failed)
    # equal texts of a language have equal figures, and count once
    good = checkpointed(scored.where(~F.col("base_failed")).groupBy("lang", "hash").agg(*[F.min(c).alias(c) for c in ("bits", "deviation", "n_keys")]))
    middle = median(good, "lang", F.col("bits"), 1e-4, "mid")
    # deviations are scaled by the square root of the length: means of n symbols spread as 1/sqrt(n)
    scale = F.sqrt(F.lit(1.0) / (F.lit(1.0) / F.lit(4000.0) + F.lit(1.0) / F.col("n_keys")))
    paired = good.alias("g").join(middle.alias("m"), F.col("g.lang").eqNullSafe(F.col("m.lang")))
    off = checkpointed(paired.select("m.lang", "m.mid", ((F.col("bits") - F.col("mid")) * scale).alias("d")))
    below = median(off.where("d <= 0"), "lang", -F.col("d"), 1e-3, "below")
    above = median(off.where("d >= 0"), "lang", F.col("d"), 1e-3, "above")
    symbol = median(good, "lang", F.col("deviation"), 1e-3, "symbol")
    named = middle.alias("m")
    for part, name in ((below, "l"), (above, "u"), (symbol, "y")):
        named = named.join(part.alias(name), F.col("m.lang").eqNullSafe(F.col(f"{name}.lang")), "left")
    bands = named.select("m.lang", "mid", "below", "above", (F.col("symbol") * LEAST_SHARE).alias("least"))
    bands = checkpointed(bands.select("lang", "mid", *[F.greatest(F.col(c) * 1.4826, "least").alias(c) for c in ("below", "above")]))
    joined = scored.alias("s").join(bands.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left")
    low, high = F.col("mid") - F.lit(spreads) * F.col("below") / scale, F.col("mid") + F.lit(spreads) * F.col("above") / scale
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("bits").between(low, high), F.lit(True))).alias("kept"),
        "bits", low.alias("low"), high.alias("high"),
    )
