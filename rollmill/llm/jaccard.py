"""N-gram Jaccard join by a MinHash LSH forest.

A document's shingles are its runs of five consecutive words (words as they stand; a text of
fewer words is one shingle). Texts of equal words are one class of copies, with one representative
in the forest, so copies are never expanded into pairs. Each of TREES prefix tries holds every
representative under a label of DEPTH MinHash values: OWN of the tree's own, then the first of the
next tree's. A trie is its sorted label list, made by one range exchange for all trees; each label
keeps the number of values that it shares with a neighbour, so the labels that share a prefix of
any depth are picked without another look at the others. The join starts with the longest prefixes.
A round verifies the pairs whose prefixes match in some tree at this depth and in none at the depth
before, each in the first such tree alone. From the exact similarities of all pairs found it
estimates how many there are (each found pair stands for one over its chance of being met, and some
more at the threshold for kinds of pairs of which none was found) and which share a depth would
meet; prefixes are then shortened to the greatest depth that reaches the target recall, until the
depth at hand does. If no depth does, the last one is 1, and a warning names the recall.
Verification counts the common shingles (64-bit hashes) exactly.

No pair is ever a row: tasks return each representative's number of links and a star of links that
spans what they have connected; components of the stars are the classes. A prefix that many
representatives share is cut into square blocks of pairs that go to tasks of their own. What is
sent again for verification, the shingles, is that of representatives with candidate pairs alone,
picked by a bit filter of fixed size.

Results: class_id, the least id of the class; n_links, the number of other texts (of different
words) with a similarity of ``threshold`` or more; n_copies, the rows with the same words.
Nulls and texts without words have no shingles: they link to nothing and are classes of their own.
A class takes the least id that is not null (null, if all are).
Repeated rows are copies of each other. Empty tables give empty results. Extra columns are ignored
by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.cluster import checkpointed, shuffle_partitions
from rollmill.llm.components import components
from rollmill.llm.filters import FILTER_BITS, bit_filter, passes
from rollmill.llm.textkernel import WORD_BASE, Words, mix, span_hashes, windows, word_groups
from rollmill.llm.tidy import tidy

SHINGLE, THRESHOLD = 5, 0.8
TREES, OWN, DEPTH = 20, 5, 8
#: Depth down to which the first look at the tries keeps labels; a shorter prefix needs another look.
KEPT_DEPTH = 3
TARGET_RECALL = 0.9995
#: Pairs at the threshold that may be there though none was found (the 95 % bound of a count of none), and steps of similarity of a histogram.
UNSEEN, BINS = 3, 200
#: Representatives of one side of a block of pairs.
BLOCK = 512
#: Type and bytes of a MinHash value.
VALUE, WIDTH = np.uint16, 2
#: Signatures that agree in less than threshold - SLACK of their values are not verified (over five standard deviations).
SLACK = 0.2

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, TREES * OWN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, last, of documents; key of each document's word sequence)."""
    hashes = words.word_hashes()
    starts, found = windows(words, hashes, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        starts = np.concatenate([starts, words.first[short]])
        found = np.concatenate([found, span_hashes(hashes, WORD_BASE, words.first[short], words.last[short])])
        order = np.argsort(starts, kind="stable")
        starts, found = starts[order], found[order]
    first, last = np.searchsorted(starts, words.first), np.searchsorted(starts, words.last)
    key = np.zeros((2, len(words.rows)), np.uint64)
    some = np.flatnonzero(words.counts > 0)
    for k in range(2):  # two independent hashes of the word sequence
        key[k, some] = span_hashes(mix(hashes + np.uint64(k * 0x5851F42D4C957F2D)), WORD_BASE, words.first[some], words.last[some])
    return found, first, last, key


def signatures(found: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """MinHash values of the given documents, all with shingles; documents' shingles follow one another.

    A value is 16 bits of the hash of the least: the head of the least itself would be much alike for all long texts.
    """
    out = np.empty((len(docs), TREES * OWN), VALUE)
    if len(docs):
        starts = first[docs]
        for k in range(TREES * OWN):
            out[:, k] = np.minimum.reduceat(found * _MULTIPLY[k], starts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    return out


def _fixed(blobs: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in blobs], pa.binary())


@tidy
def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_groups(batch.column("text")):
            found, first, last, key = shingles(words, n)
            some = np.flatnonzero(last > first)
            if not len(some):
                continue
            rows = pa.array(words.rows[some])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("th").take(rows), pa.array(key[0, some].view(np.int64)), pa.array(key[1, some].view(np.int64)), _fixed(signatures(found, first, last, some))], names=["id", "th", "k1", "k2", "sig"])


def _rep_hash(k1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(k1 ^ mix(ids))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = bounds(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
            table = table.slice(cuts[-2])
        held = table.to_batches()
    if held and sum(len(b) for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def _sigs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), VALUE).reshape(-1, TREES * OWN)


def met(similarity: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Chance that a pair is met at ``depth`` and not put aside for a signature that agrees in less than ``least`` of its values.

    Beyond OWN values a tree matches if all its own and the first of the next tree's agree, so
    neighbouring trees are not independent: no tree matches if no block of OWN values that agrees in
    full is followed, around the circle of trees, by one that agrees at its head.
    """
    s = np.atleast_1d(np.asarray(similarity, np.float64))
    n = TREES * OWN
    short = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(math.ceil(least * n)))
    if depth <= OWN:
        missed = (1 - s**depth) ** TREES
    else:
        full, head = s**OWN, s ** (depth - OWN)
        chance = np.stack([full, head - full, 1 - head], 1)
        step = np.repeat(chance[:, None, :], 3, 1)
        step[:, 0, :2] = 0
        missed = np.trace(np.linalg.matrix_power(step, TREES), axis1=1, axis2=2)
    return np.clip(1 - missed - short, 1e-12, 1)


def recall_at(found: np.ndarray, at: int, depth: int, threshold: float) -> float:
    """The share of all pairs that ``depth`` meets, estimated from a histogram of the similarities of those met at depth ``at``."""
    edges = threshold + (1 - threshold) * np.arange(len(found)) / (len(found) - 1)
    there = found.astype(np.float64)
    there[0] += UNSEEN
    there /= met(edges, at, threshold - SLACK)
    return float((there * met(edges, depth, threshold - SLACK)).sum() / there.sum())


def _matched(same: np.ndarray, depth: int) -> np.ndarray:
    """Whether pairs match at ``depth``, by tree; ``same``: by pair, tree and place, whether the trees' own values agree."""
    out = same[:, :, : min(depth, OWN)].all(2)
    if depth > OWN:
        out &= np.roll(same[:, :, : depth - OWN].all(2), -1, axis=1)
    return out


@tidy
def _neighbours(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Labels of sorted tries with the number of values shared with a neighbour, where that is ``least`` or more.

    The first and the last label of a partition, whose neighbours are elsewhere, pass as if they shared all.
    """
    held, before = None, DEPTH

    def part(table: pa.Table, shared: np.ndarray) -> list[pa.RecordBatch]:
        return table.append_column("shared", pa.array(shared.astype(np.int32))).filter(pa.array(shared >= least)).to_batches()

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        label = np.frombuffer(b"".join(x.as_buffer() for x in table["label"]), VALUE).reshape(-1, DEPTH)
        tree = table["tree"].to_numpy()
        common = np.cumprod(label[1:] == label[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
        yield from part(table.slice(0, len(table) - 1), np.maximum(np.append(before, common[:-1])[: len(common)], common))
        held, before = table.slice(len(table) - 1), common[-1] if len(common) else before
    if held is not None:
        yield from part(held, np.array([DEPTH]))


def tries(reps: DataFrame, least: int) -> DataFrame:
    """rid, tree, label, shared of the labels that share ``least`` values or more with a neighbour in their sorted trie."""
    around = F.concat("sig", F.substring("sig", 1, WIDTH * DEPTH))
    labels = reps.select("rid", around.alias("around"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    labels = labels.select("rid", "tree", F.substring("around", F.col("tree") * F.lit(WIDTH * OWN) + 1, F.lit(WIDTH * DEPTH)).alias("label"))
    order = ["tree", "label", "rid"]
    ordered = labels.repartitionByRange(shuffle_partitions(reps.sparkSession), *order).sortWithinPartitions(*order)
    return checkpointed(ordered.mapInArrow(partial(_neighbours, least=least), "rid long, tree int, label binary, shared int"))


def _group_pairs(cuts: np.ndarray, side: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, in arrays of bounded length; of a block off the diagonal, those across it."""
    left, right, held = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if lo[a] == hi[a]:
            for i in range(a, b - 1):
                left.append(np.full(b - i - 1, i))
                right.append(np.arange(i + 1, b))
                held += b - i - 1
                if held >= limit:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
        else:
            here, there = a + np.flatnonzero(side[a:b] == lo[a]), a + np.flatnonzero(side[a:b] == hi[a])
            for i in here:
                left.append(np.full(len(there), i))
                right.append(there)
                held += len(there)
                if held >= limit:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _candidates(table: pa.Table, cuts: np.ndarray, depth: int, before: int | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows that this round verifies in the rows' own tree."""
    sig, tree = _sigs(table["sig"]), table["tree"].to_numpy()
    for i, j in _group_pairs(cuts, table["side"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy()):
        for k in range(0, len(i), 16384):
            a, b = i[k : k + 16384], j[k : k + 16384]
            same = sig[a] == sig[b]
            close = same.mean(1) >= least
            a, b, same = a[close], b[close], same[close].reshape(-1, TREES, OWN)
            match = _matched(same, depth)
            good = match.argmax(1) == tree[a]
            good &= match[np.arange(len(a)), tree[a]]
            if before is not None:
                good &= ~_matched(same, before).any(1)
            yield a[good], b[good]


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    used = np.unique(np.concatenate([a, b]))
    if len(used) <= 24 or len(a) < 200:
        return np.array([len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate([sets[i], sets[j]]))) for i, j in zip(a, b, strict=True)], np.int64)
    place = np.zeros(used[-1] + 1, np.int64)
    place[used] = np.arange(len(used))
    values = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    cuts = np.append(np.flatnonzero(new), len(values))
    column = np.cumsum(new) - 1
    shared = np.diff(cuts)[column] > 1  # a shingle of one set alone adds to no intersection
    column, owner = column[shared], owner[shared]
    if not len(column):
        return np.zeros(len(a), np.int64)
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    total = np.zeros((len(used), len(used)), np.float32)
    for c in range(0, int(column[-1]) + 1, 2048):  # columns of the incidence matrix, some at a time
        x, y = np.searchsorted(column, [c, c + 2048])
        part = np.zeros((len(used), 2048), np.float32)
        part[owner[x:y], column[x:y] - c] = 1
        total += part @ part.T
    return total[place[a], place[b]].astype(np.int64)


def _stars(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each connected part of rows under links (a, b): its least name, and the others."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            i, j = (i, j) if names[i] < names[j] else (j, i)
            parent[j] = i
    nodes = np.unique(np.concatenate([a, b]))
    roots = np.array([root(x) for x in nodes.tolist()], np.int64)
    other = nodes != roots
    return names[roots[other]], names[nodes[other]]


FOUND = "kind int, a long, b long, n long"


@tidy
def _verified(batches: Iterator[pa.RecordBatch], depth: int, before: int | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for table, cuts in sorted_groups(batches, ["bucket", "lo", "hi"], 2_000):
        rid = table["rid"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
        sizes = np.array([len(s) for s in sets])
        group = np.searchsorted(cuts, np.arange(len(rid)), "right")
        pairs = list(_candidates(table, cuts, depth, before, threshold - SLACK))
        if not pairs:
            continue
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        order = np.argsort(group[a], kind="stable")
        a, b = a[order], b[order]
        common = np.zeros(len(a), np.int64)
        at = np.append(np.flatnonzero(np.diff(group[a], prepend=-1)), len(a))
        for x, y in zip(at[:-1], at[1:], strict=True):
            common[x:y] = _common(sets, a[x:y], b[x:y])
        similarity = common / (sizes[a] + sizes[b] - common)
        good = similarity >= threshold - 1e-12
        a, b, similarity = a[good], b[good], similarity[good]
        if not len(a):
            continue
        links = np.bincount(np.concatenate([a, b]), minlength=len(rid))
        some = np.flatnonzero(links)
        # a row may stand in several groups of the table: stars join rows by name
        names, where = np.unique(rid, return_inverse=True)
        hub, leaf = _stars(len(names), where[a], where[b], names)
        histogram = np.bincount(np.clip((similarity - threshold) / max(1 - threshold, 1e-9) * BINS + 1e-6, 0, BINS).astype(np.int64))
        steps = np.flatnonzero(histogram)
        # each row's links; stars; how many pairs are of a step of similarity
        parts = [(rid[some], np.zeros(len(some)), links[some]), (hub, leaf, np.zeros(len(hub))), (steps, np.zeros(len(steps)), histogram[steps])]
        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3)]
        kinds = np.repeat(np.arange(3, dtype=np.int32), [len(p[0]) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, columns)], names=["kind", "a", "b", "n"])


def linked(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows with words: id, th, k1, k2; classes of word sequences: k1, k2, class_id, class_th, rep, rep_th, n_links, n_copies).

    th is the hash of the text itself, so that a row can be found again by id and text.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    described = checkpointed(source.mapInArrow(lambda it: _describe(it, shingle), "id long, th long, k1 long, k2 long, sig binary"))
    least = F.struct(F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).alias("o"), F.col("id"), F.col("th"))
    reps = described.groupBy("k1", "k2").agg(F.min(least).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"))
    reps = checkpointed(reps.select("k1", "k2", "rep", "n_copies", "sig")).withColumn("rid", F.monotonically_increasing_id())
    n = shuffle_partitions(spark)
    before, found, depth, kept_depth = None, None, DEPTH, KEPT_DEPTH
    forest = tries(reps, kept_depth)
    while True:
        if depth < kept_depth:
            kept_depth = depth
            forest = tries(reps, kept_depth)
        labels = forest.where(F.col("shared") >= depth).select("rid", "tree", F.xxhash64("tree", F.substring("label", 1, WIDTH * depth)).alias("bucket"))
        shared = labels.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        members = labels.join(shared, "bucket").withColumn("sides", F.ceil(F.col("m") / F.lit(block)).cast("int")).withColumn("side", F.pmod(F.xxhash64("rid"), F.col("sides")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("bucket", "tree", "rid", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
        keys = ["bucket", "lo", "hi"]

        @tidy
        def worth(batches: Iterator[pa.RecordBatch], depth=depth, before=before) -> Iterator[pa.RecordBatch]:
            for table, cuts in sorted_groups(batches, keys):
                used = np.zeros(table.num_rows, bool)
                for a, b in _candidates(table, cuts, depth, before, threshold - SLACK):
                    used[a] = used[b] = True
                yield from table.drop_columns(["sig"]).filter(pa.array(used)).to_batches()

        schema = "bucket long, lo int, hi int, side int, tree int, rid long"
        columns = ["bucket", "lo", "hi", "side", "tree", "rid"]
        signed = members.join(reps.select("rid", "sig"), "rid").select(*columns, "sig")
        kept = checkpointed(signed.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(worth, schema))
        near = reps.join(kept.select("rid").distinct(), "rid", "left_semi").select("rid", "k1", "k2", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_rep_hash(batch.column("k1").to_numpy().view(np.uint64), _ids(batch.column("id"))).view(np.int64))], names=["h"])

        wanted = spark.sparkContext.broadcast(bit_filter(near.select("k1", "id").mapInArrow(hashed, "h long"), "h"))

        @tidy
        def sets(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = _ids(batch.column("id"))
                for words in word_groups(batch.column("text")):
                    values, first, last, key = shingles(words, shingle)
                    pick = np.flatnonzero((last > first) & passes(wanted.value, _rep_hash(key[0], ids[words.rows]), FILTER_BITS))
                    if len(pick):
                        rows = pa.array(words.rows[pick])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(key[0, pick].view(np.int64)), pa.array(key[1, pick].view(np.int64)), pa.array([np.unique(values[first[d] : last[d]]).tobytes() for d in pick], pa.binary())],
                            names=["id", "th", "k1", "k2", "shingles"],
                        )

        own = source.mapInArrow(sets, "id long, th long, k1 long, k2 long, shingles binary").alias("s")
        same = (F.col("s.k1") == F.col("n.k1")) & (F.col("s.k2") == F.col("n.k2")) & F.col("s.id").eqNullSafe(F.col("n.id")) & (F.col("s.th") == F.col("n.th"))
        own = own.join(near.alias("n"), same).select("rid", "shingles").dropDuplicates(["rid"]).join(reps.select("rid", "sig"), "rid")
        ready = kept.join(own, "rid").select(*columns, "sig", "shingles").repartition(n, *keys).sortWithinPartitions(*keys)
        here = checkpointed(ready.mapInArrow(lambda it, depth=depth, before=before: _verified(it, depth, before, threshold), FOUND))
        found = here if found is None else found.unionAll(here)
        histogram = np.zeros(BINS + 1, np.int64)
        for step, count in found.where("kind = 2").groupBy("a").agg(F.sum("n")).collect():
            histogram[step] = count
        recall = recall_at(histogram, depth, depth, threshold)
        if recall >= target_recall:
            break
        if depth == 1:
            warnings.warn(f"the estimated recall {recall} is under the target {target_recall}", stacklevel=2)
            break
        enough = [d for d in range(1, depth) if recall_at(histogram, depth, d, threshold) >= target_recall]
        before, depth = depth, max(enough, default=1)
    links = found.where("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    parts = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rid")
    tagged = checkpointed(reps.drop("sig").join(parts, "rid", "left").join(links, "rid", "left").withColumn("component", F.coalesce("component", "rid")))
    heads = tagged.where("n_links > 0").groupBy("component").agg(F.min("rep").alias("head"))
    out = tagged.join(heads, "component", "left").withColumn("head", F.coalesce("head", "rep"))
    return described.drop("sig"), out.select("k1", "k2", F.col("head.id").alias("class_id"), F.col("head.th").alias("class_th"), F.col("rep.id").alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, class_id, n_links, n_copies."""
    rows, found = linked(docs, id_col=id_col, text_col=text_col, **options)
    without = docs.where(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("id"))
    some = found.where("n_links > 0 or n_copies > 1").drop("class_th", "rep")
    shown = rows.join(some, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.when(F.col("n_copies").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    return shown.unionAll(without.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (of equal rows, one). Rows without words all stay."""
    _, found = linked(docs, id_col=id_col, text_col=text_col, **options)
    # one exchange of the texts serves the join and the removal of equal rows: both go by the same keys
    name = lambda row, th: F.xxhash64(row.cast("long"), th)
    heads = found.select(name(F.col("class_id"), F.col("class_th")).alias("__j"), F.col("class_th").alias("__t")).distinct()
    th = F.xxhash64(F.col(text_col))
    keyed = docs.withColumn("__t", th).withColumn("__j", name(F.col(id_col), th))
    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.where(~blank).join(heads, ["__j", "__t"], "left_semi").dropDuplicates(["__j", "__t"])
    return kept.select(*docs.columns).unionByName(docs.where(blank))
