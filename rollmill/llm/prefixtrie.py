"""The prefix trie of conversations, each node with figures of its members and of its subtree.

A turn travels as a 16-byte digest of (role, text) and a count of words; texts are read once and
never exchanged. Equal conversations become one sequence with a number of members before any trie
is built. Sequences are dealt by the digest of their first turn, a bucket holds whole first-turn
subtries, and each bucket's trie of pointer dictionaries is built inside ``applyInPandas`` and
summed in postorder without recursion. A subtrie of more than ``MAX_TURNS`` turns is not built: the
turns that all its sequences share become a chain of nodes, and the sequences are dealt again by
the turn after it, as often as it takes; the sums of their subtries are added to the chain's nodes
afterwards, from the last round to the first.

Nulls: null roles and texts are empty, null turns come first, rows without a conv_id belong to no
conversation and make no node. Remainders of negative ids have their sign, as in SQL. Turns of one number stand in the order of their digests, repeated rows
are turns of their own. Empty texts have no words. An empty table has no node, not even a root.
Extra columns are ignored. One sequence is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollmill.llm.cluster import shared_path, shuffle_partitions
from rollmill.llm.tidy import tidy

#: Turns of a subtrie, and about those of a bucket, that one task holds as dictionaries.
MAX_TURNS = 1 << 16
#: The rebuilding rule: conversations take their first turns from the first of their block.
BLOCK, HEADS = 20, 4
DIGEST = 16
#: Bytes of ids in a row of a run.
RUN_BYTES = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _written(df: DataFrame, kind: str) -> DataFrame:
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns in order) and words (of each turn) of every conversation, rebuilt.

    One exchange of narrow rows by block: the order of turns, the block's first conversation and the
    join with it keep to it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        block.cast("long").alias("block"),
        F.col("turn").alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    place = F.row_number().over(Window.partitionBy("block", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    dealt = turns.repartition(F.col("block")).withColumn("place", place)
    own = dealt.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("own"))
    first = dealt.where((F.col("conv_id") == F.col("block")) & (F.col("place") < HEADS)).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    h = heads(F.col("conv_id"))
    kept = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    rebuilt = own.join(first, "block", "left").select("conv_id", F.when(F.col("head").isNull() | (h == 0), kept).otherwise(F.concat(F.slice("head", 1, F.greatest(h, F.lit(1))), kept)).alias("turns"))
    return rebuilt.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.words").alias("words"))


def ends(members: DataFrame) -> DataFrame:
    """seq, rep (least conv_id), n and the hash of the conv_ids of every distinct sequence.

    A hash over ids in order is one stream by its nature. The sorting isn't: ranges of (seq, conv_id)
    are sorted apart, so that a hot sequence's ids meet as runs of text, about a megabyte a row.
    """

    def grouped(batches: Iterator[pa.RecordBatch], open_group, put, close) -> Iterator[tuple]:
        now, state = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if state is not None:
                        yield from close(now, state)
                    now, state = row[0], open_group(row)
                yield from put(now, state, row)
        if state is not None:
            yield from close(now, state)

    def batched(rows: Iterator[tuple], schema: pa.Schema, each: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 64 + len(row[-1])
            if size >= each:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    run = pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    whole = pa.schema([("seq", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(seq, state, row):
            state[0].append(b"%d" % row[1])
            state[1] += len(state[0][-1]) + 1
            if state[1] >= RUN_BYTES:
                yield from close(seq, state)
                state[:] = [], 0

        def close(seq, state):
            if state[0]:
                yield seq, int(state[0][0]), len(state[0]), b",".join(state[0])

        yield from batched(grouped(batches, lambda row: [[], 0], put, close), run, 4 * RUN_BYTES)

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(seq, state, row):
            state[0].update(b"," + row[3] if state[2] else row[3])
            state[2] += row[2]
            return ()

        def close(seq, state):
            yield seq, state[1], state[2], state[0].hexdigest()

        yield from batched(grouped(batches, lambda row: [hashlib.sha256(), row[1], 0], put, close), whole, RUN_BYTES)

    n = shuffle_partitions(members.sparkSession)
    runs = members.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(pack, "seq binary, first long, n long, ids binary")
    return runs.repartition(n, F.col("seq")).sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq binary, rep long, n long, ends string")


class Trie:
    """Nodes as parallel lists; each has a dictionary of pointers from a turn's digest to a child.

    Children are made after their parents, so the order of making, reversed, is a postorder.
    """

    def __init__(self):
        self.kids: list[dict[bytes, int] | None] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.words: list[int] = []
        self.least: list[int] = []
        self.members: list[int] = []
        self.ends: list[str] = []

    def node(self, parent: int, depth: int, words: int, rep: int) -> int:
        for values, x in ((self.kids, None), (self.parent, parent), (self.depth, depth), (self.words, words), (self.least, rep), (self.members, 0), (self.ends, NO_ENDS)):
            values.append(x)
        return len(self.kids) - 1

    def add(self, tops: dict[bytes, int], path: bytes, words: np.ndarray, at: int, rep: int, n: int, ends: str) -> None:
        """A sequence of ``n`` members from its turn number ``at`` on; ``tops`` are the nodes at that depth."""
        here, kids = -1, tops
        for d in range(at, len(words)):
            turn = path[d * DIGEST : (d + 1) * DIGEST]
            child = kids.get(turn)
            if child is None:
                child = kids[turn] = self.node(here, d + 1, int(words[d]), rep)
            here = child
            self.members[here] += n
            if rep < self.least[here]:
                self.least[here] = rep
            if d + 1 < len(words):
                if self.kids[here] is None:
                    self.kids[here] = {}
                kids = self.kids[here]
        self.ends[here] = ends

    def sums(self) -> tuple[list[int], list[int]]:
        """Leaves and saved tokens of each node's subtree."""
        leaves, saved = [0] * len(self.kids), [0] * len(self.kids)
        for i in range(len(self.kids) - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.members[i] - 1) * self.words[i]
            up = self.parent[i]
            if up >= 0:
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        return leaves, saved


BUILT = NODE + ", top boolean, chain binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all subtries of a bucket; ``top`` marks the subtries' roots, ``chain`` names the chain above them."""
    trie, tops, above = Trie(), {}, {}
    for key, chain, up, path, words, at, rep, n, ends_ in zip(rows["key"], rows["chain"], rows["up"], rows["path"], rows["words"], rows["at"], rows["rep"], rows["n"], rows["ends"], strict=True):
        made = len(trie.kids)
        trie.add(tops.setdefault(bytes(key), {}), bytes(path), words, int(at), int(rep), int(n), ends_)
        if made < len(trie.kids) and trie.parent[made] < 0:
            above[made] = (bytes(chain), int(up))
    leaves, saved = trie.sums()
    top = [p < 0 for p in trie.parent]
    ups = [above[i][1] if p < 0 else trie.least[p] for i, p in enumerate(trie.parent)]
    return pd.DataFrame(
        {"conv_id": trie.least, "depth": trie.depth, "parent_conv_id": ups, "n_convs": trie.members, "n_children": [len(k) if k else 0 for k in trie.kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": trie.ends, "top": top, "chain": [above[i][0] if p < 0 else None for i, p in enumerate(trie.parent)]}
    )


def _shared(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns that the first and the last of sequences in order share, which is what all of them share."""
    for part in rows:
        part["upto"] = [_common(bytes(lo), bytes(hi)) for lo, hi in zip(part["lo_path"], part["hi"], strict=True)]
        part["own"] = [own if len(lo) == n * DIGEST else None for lo, own, n in zip(part["lo_path"], part["lo_ends"], part["upto"], strict=True)]
        part["words"] = [words[:n] for words, n in zip(part["lo_words"], part["upto"], strict=True)]
        yield part[["key", "chain", "up", "at", "upto", "words", "conv_id", "n_convs", "own"]]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return (int(differ[0]) if len(differ) else n) // DIGEST


def _chain_nodes(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of chains whose sums below are known; a long chain comes in several batches."""
    for part in rows:
        for r in part.itertuples(index=False):
            words = np.asarray(r.words[r.at :], np.int64)
            saved = np.cumsum(((r.n_convs - 1) * words)[::-1])[::-1] + r.saved
            depth = np.arange(r.at + 1, r.upto + 1)
            for a in range(0, len(depth), MAX_TURNS):
                d = depth[a : a + MAX_TURNS]
                last = d == r.upto
                yield pd.DataFrame(
                    {"conv_id": r.conv_id, "depth": d, "parent_conv_id": np.where(d == r.at + 1, r.up, r.conv_id), "n_convs": r.n_convs, "n_children": np.where(last, r.children, 1), "n_leaves": max(r.leaves, 1), "saved_tokens": saved[a : a + MAX_TURNS],
                     "ends_sha256": np.where(last & (r.own is not None), r.own or NO_ENDS, NO_ENDS), "top": d == r.at + 1, "chain": [r.chain if x else None for x in d == r.at + 1]}
                )


def trie(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs = _written(sequences(conversations).withColumn("seq", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * DIGEST))), "trie-conversations")
    known = _written(ends(convs), "trie-ends")
    n_convs, least = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n_convs:
        return spark.createDataFrame([], NODE)
    turn = lambda at: F.substring(F.col("path"), at * DIGEST + 1, DIGEST)
    named = F.unhex(F.substring(F.sha2(F.concat(F.col("chain"), F.col("turn")), 256), 1, 2 * DIGEST))
    distinct = convs.select("conv_id", "path", "words").join(known.withColumnRenamed("rep", "conv_id"), "conv_id")
    rows = distinct.withColumnRenamed("conv_id", "rep")
    everyone = _written(
        rows.select("rep", "n", "ends", "path", "words", F.lit(0).alias("at"), F.lit(int(least)).alias("up"), F.lit(b"").alias("chain"), turn(0).alias("turn")).withColumn("key", named).drop("turn"),
        "trie-sequences",
    )
    root_ends = everyone.where(F.length("path") == 0).select("ends").first()
    left = F.size("words") - F.col("at")
    waiting, built, chains = everyone.where(left > 0), [], []
    while True:
        sizes = waiting.groupBy("key").agg(F.sum(left).alias("turns"), F.count(F.lit(1)).alias("seqs"))
        total, most = sizes.agg(F.sum("turns"), F.max("turns")).first()
        if not total:
            break
        large = sizes.where(F.col("turns") > max_turns).select("key")
        small = waiting.join(large, "key", "left_anti") if most > max_turns else waiting
        n = max(shuffle_partitions(spark), -(-total // max_turns))
        bucket = F.pmod(F.xxhash64("key"), F.lit(n))
        built.append(_written(small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_build, BUILT), "trie-nodes"))
        if most <= max_turns:
            break
        rest = waiting.join(large, "key")
        ordered = F.struct("path", "words", "ends")
        found = rest.groupBy("key").agg(F.min(ordered).alias("lo"), F.max("path").alias("hi"), F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("chain").alias("chain"), F.first("up").alias("up"), F.first("at").alias("at"))
        found = found.select("*", F.col("lo.path").alias("lo_path"), F.col("lo.words").alias("lo_words"), F.col("lo.ends").alias("lo_ends")).drop("lo")
        chain = _written(found.mapInPandas(_shared, "key binary, chain binary, up long, at int, upto int, words array<long>, conv_id long, n_convs long, own string"), "trie-chains")
        chains.append(chain)
        ahead = rest.drop("chain", "up", "at").join(chain.select("key", F.col("upto").alias("at"), F.col("conv_id").alias("up")), "key").where(F.size("words") > F.col("at"))
        ahead = ahead.withColumnRenamed("key", "chain").withColumn("turn", F.substring(F.col("path"), F.col("at") * DIGEST + 1, F.lit(DIGEST)))
        waiting = _written(ahead.withColumn("key", named).drop("turn"), "trie-waiting")
    tops = [b.where("top") for b in built]
    nodes = list(built)
    for level in range(len(chains) - 1, -1, -1):
        under = tops[level + 1] if level + 1 < len(tops) else None
        below = under.groupBy(F.col("chain").alias("key")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")) if under is not None else spark.createDataFrame([], "key binary, children long, leaves long, saved long")
        done = _written(chains[level].join(below, "key", "left").fillna(0, ["children", "leaves", "saved"]).mapInPandas(_chain_nodes, BUILT), "trie-chain-nodes")
        nodes.append(done)
        tops[level] = tops[level].unionAll(done.where("top"))
    names = [c.split()[0] for c in NODE.split(", ")]
    totals = [0, 0, 0]
    if tops:
        totals = [x or 0 for x in tops[0].agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()]
    root = spark.createDataFrame([(int(least), 0, None, int(n_convs), totals[0], max(totals[1], 1), totals[2], root_ends[0] if root_ends else NO_ENDS)], NODE)
    for part in nodes:
        root = root.unionAll(part.select(names))
    return root
