"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless global numbers in the order of (id, text hash); a keyed Feistel network over the
smallest even-bit domain that holds the row count, walked along its cycles until it lands below
that count, permutes them. The place p of a row gives its shard (p mod shards) and slot (p div
shards), so both are computable from the row number alone, and the inverse network tells which
row stands at any shard and slot. Shard sizes differ by one row at most.

Nulls: a null text has size 1 (the constant) and crc32 0, a null id sorts first. Empty texts are
ordinary rows, repeated rows get row numbers of their own, an empty table gives an empty result.
Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.cluster import checkpointed, shuffle_partitions, utf8_crc32
from rollmill.llm.textkernel import mix

ROUNDS = 6


class Feistel:
    """A keyed permutation of 0 .. n-1 and its inverse, on whole arrays."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = int(n)
        self.half = np.uint64(max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        keys = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = mix(keys + np.uint64(seed & (1 << 64) - 1))

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x, np.uint64), back)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self._pass(out[far], back)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, back=False)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, back=True)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with gapless ``row_number`` in the given order, and the row count.

    One range exchange on the given columns (and, so that repeated rows spread, on the rows'
    places in the input, among which the result is indifferent), a reliable checkpoint that fixes
    the partitions, and one count per partition brought to the driver.
    """
    spark = df.sparkSession
    fixed = checkpointed(
        df.withColumn("__at", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(spark), *order, "__at")
        .sortWithinPartitions(*order, "__at")
        .drop("__at")
    )
    marked = fixed.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftrightunsigned("__id", 33).cast("int"))
    counts = sorted((r["__part"], r["count"]) for r in marked.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    starts = spark.createDataFrame(offsets, "__part int, __start long")  # a row for each partition
    out = marked.join(F.broadcast(starts), "__part").withColumn("row_number", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("__id", "__part", "__start"), total


def assign_shards(docs: DataFrame, n_shards: int = 16, seed: int = 2024, payload: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes + 1), text_crc32, row_number, place, shard, slot, and ``payload``."""
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        utf8_crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("__text_hash"),
        *payload,
    )
    rows, total = numbered(narrow, [id_col, "__text_hash"])
    permutation = Feistel(total, seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(row.to_numpy()))

    return (
        rows.withColumn("place", place("row_number"))
        .withColumn("shard", (F.col("place") % n_shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {n_shards}"))
        .drop("__text_hash")
    )


def row_at(total: int, shard: int, slot: int, n_shards: int = 16, seed: int = 2024) -> int:
    """The row number that stands at a shard and slot, without looking at the data."""
    return int(Feistel(total, seed).row(np.array([slot * n_shards + shard]))[0])


def write_shards(assigned: DataFrame, path: str, slots_per_file: int = 100_000) -> None:
    """Write assigned rows as one folder for each shard, each file a run of slots in order."""
    (
        assigned.withColumn("run", F.expr(f"slot div {slots_per_file}"))
        .repartition("shard", "run")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard", "run")
        .parquet(path)
    )
