"""Mixing sources by temperature, realised as budgeted block permutations.

Weights: with n_s tokens in source s, w_s is proportional to n_s**alpha, 0 <= alpha <= TOP_EXPONENT.
The exponent is bisected so that the entropy of the weights is the target (a share of the greatest
entropy, that of equal weights): below 1 it evens the sources out, above 1 it sharpens them. If a
source would then be repeated beyond the limit, w_s * budget > limit * n_s, the exponent goes back
towards 1, where all sources are repeated alike, until none is. What is reached is returned with
every row: the entropy's share, the greatest repetition, and whether all stated targets are met
(equal sources have the greatest entropy whatever the exponent, which then stays 1; a budget beyond
the limit for all sources together cannot be met). The search runs over the token counts of up to
BROADCAST_SOURCES sources on the driver, and beyond that by aggregates over their table.

Draw: a source's quota is w_s * budget tokens: whole passes over it, plus the head of one more
pass whose order is a permutation of blocks. A document's block is the head of its hash; a Feistel
network permutes the blocks anew for each source and pass; whole blocks are taken while they fit,
the block at the edge is cut by its sub-blocks, and the sub-block at the edge by single documents.
Only tables of at most BLOCKS rows for each source, and one sub-block of about a millionth of a
source, are ever ordered in one task.

Nulls: a null source is a source of its own, a null text has no tokens. Empty texts cost nothing
and go with their block. Rows of equal id and text are drawn together, as one unit that is not
split; a draw never exceeds its quota, and falls short of it by less than one such unit. An empty
table gives an empty result. Extra input columns pass through ``mix`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.cluster import checkpointed
from rollmill.llm.textkernel import SPACE, groups, spans

BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: Bits that hashes of units have: 15 hexadecimal digits of an MD5.
KEY_BITS = 60
ROUNDS, HALF = 4, BLOCK_BITS // 2
TOP_EXPONENT, STEPS, CUTS = 64.0, 56, 16
#: Digits that exponents and weights are rounded to, and how near an entropy (as a share) and a repetition (relatively) must come to its target.
EXPONENT_DIGITS, WEIGHT_DIGITS, NEAR = 6, 12, 1e-4
#: Tokens that the query and the pipeline draw, as a share of those there are, and the entropy they ask for.
BUDGET_SHARE, ENTROPY_SHARE, MAX_REPETITION = 1.5, 0.95, 4.0
#: Sources up to which their tables (some hundred bytes a row) are broadcast.
BROADCAST_SOURCES = 20_000


@F.arrow_udf(T.LongType())
def n_words(text: pa.Array) -> pa.Array:
    counts = [np.zeros(0, np.int64)]
    for _, data, offsets in groups(text):
        starts, _ = spans(data, offsets, SPACE[data])
        counts.append(np.diff(np.searchsorted(starts, offsets)))
    return pa.array(np.concatenate(counts), pa.int64())


Measure = Callable[[list[float]], list[tuple[float, float]]]


def measured(counts: np.ndarray, budget: float) -> Measure:
    """(entropy, greatest repetition) of exponents, from the sources' token counts."""
    share = counts / counts.max()

    def measure(alphas: list[float]) -> list[tuple[float, float]]:
        out = []
        for a in alphas:
            w = share**a
            z = w.sum()
            out.append((math.log(z) - a * float((w * np.log(share)).sum()) / z, float((w / counts).max()) / z * budget))
        return out

    return measure


def measured_by_job(sources: DataFrame, budget: float) -> Measure:
    """The same from a table of sources, by one aggregate for all exponents asked for."""
    some = sources.where("n_tokens > 0")
    share = F.col("n_tokens") / F.lit(float(some.agg(F.max("n_tokens")).first()[0]))

    def measure(alphas: list[float]) -> list[tuple[float, float]]:
        aggs = []
        for a in alphas:
            w = F.pow(share, F.lit(a))
            aggs += [F.sum(w), F.sum(w * F.log(share)), F.max(w / F.col("n_tokens"))]
        row = some.agg(*aggs).first()
        return [(math.log(z) - a * y / z, x / z * budget) for a, z, y, x in zip(alphas, row[::3], row[1::3], row[2::3], strict=True)]

    return measure


def least_exponent(measure: Measure, good: Callable[[tuple[float, float]], bool], low: float, high: float, cuts: int = 2) -> float | None:
    """The exponent next to ``low`` (which may lie above ``high``) from which ``good`` holds towards ``high``; None if it does not hold there."""
    if good(measure([low])[0]):
        return low
    if not good(measure([high])[0]):
        return None
    for _ in range(math.ceil(STEPS / math.log2(cuts))):
        grid = [low + (high - low) * i / cuts for i in range(1, cuts)]
        found = [good(m) for m in measure(grid)]
        k = found.index(True) if True in found else cuts - 1
        low, high = (grid[k - 1] if k else low), (grid[k] if k < cuts - 1 else high)
    return high


def temperature(measure: Measure, n: int, entropy_share: float | None, max_repetition: float | None, cuts: int = 2) -> tuple[float, float, float, bool]:
    """The exponent, the share of the greatest entropy and the greatest repetition that it reaches, and whether these are what was asked for."""
    most = math.log(n) if n > 1 else 1.0
    alpha = 1.0 if max_repetition is None else 0.0
    if entropy_share is not None and n > 1:
        found = least_exponent(measure, lambda m: m[0] <= entropy_share * most, 0.0, TOP_EXPONENT, cuts)
        alpha = 1.0 if found is None else found
    if max_repetition is not None:
        found = least_exponent(measure, lambda m: m[1] <= max_repetition, alpha, 1.0, cuts)
        alpha = 1.0 if found is None else found
    alpha = round(alpha, EXPONENT_DIGITS)
    entropy, repetition = measure([alpha])[0]
    share = entropy / most if n > 1 else 1.0
    met = (entropy_share is None or abs(share - entropy_share) <= NEAR) and (max_repetition is None or repetition <= max_repetition * (1 + NEAR))
    return alpha, share, repetition, met


def unit_key(seed: int, doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of seed, id and text; nulls apart from all values."""
    part = lambda c: F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), part(doc_id), F.lit("|"), part(text)).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def block_place(block: Column, turn: Column) -> Column:
    """The place of a block in the order named by ``turn``: a Feistel network over the two halves of its bits."""
    left, right = F.shiftright(block, HALF), block.bitwiseAND(F.lit((1 << HALF) - 1))
    for k in range(ROUNDS):
        mixed = F.conv(F.substring(F.md5(F.concat(turn, F.lit(f"|{k}|"), right.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
        left, right = right, left.bitwiseXOR(mixed.bitwiseAND(F.lit((1 << HALF) - 1)))
    return F.shiftleft(left, HALF).bitwiseOR(right)


def _edge(units: DataFrame, block: str, before: list[str]) -> DataFrame:
    """Per source: the block at the edge of the quota (null: all fit) and the tokens left for it.

    The blocks' sums are a table of their own, so that they are added up by source and block and
    only they, not each task's share of them, meet in the source's window.
    """
    w = Window.partitionBy("__src", *before).orderBy(block)
    sums = checkpointed(units.groupBy("__src", *before, "__left", block).agg(F.sum("__tokens").alias("__t")))
    over = sums.withColumn("__cum", F.sum("__t").over(w)).where(F.col("__cum") > F.col("__left"))
    left = (F.col("__left") - F.col("__cum") + F.col("__t")).alias("left")
    edge = over.groupBy("__src", *before).agg(F.min_by(F.struct(F.col(block), left), block).alias("e"))
    return edge.select("__src", *before, F.col(f"e.{block}").alias(block), F.col("e.left").alias("__left"))


def draw(docs: DataFrame, budget_tokens: int | None = None, budget_share: float = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_repetition: float | None = MAX_REPETITION, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, n_tokens, weight, alpha, entropy_share, repetition, on_target, passes, copies and the unit's __key.

    ``copies`` is how often the row is drawn. budget_tokens: tokens to draw in all; by default
    ``budget_share`` of those there are.
    """
    units = checkpointed(
        docs.select(
            F.col(id_col).alias(id_col),
            F.col(source_col).alias("__name"),
            F.struct(F.col(source_col).isNull().alias("n"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("v")).alias("__src"),
            n_words(F.col(text_col)).alias("__tokens"),
            unit_key(seed, F.col(id_col), F.col(text_col)).alias("__key"),
        )
    )
    sources = checkpointed(units.groupBy("__src").agg(F.sum("__tokens").alias("n_tokens")))
    total, n_sources, n, most = sources.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n_tokens") > 0), F.coalesce(F.max("n_tokens"), F.lit(0))).first()
    # tables of a row for each source: sent to all tasks if they are few, else joined by an exchange that a hot source may skew
    few = n_sources <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df
    budget = float(math.floor(total * budget_share) if budget_tokens is None else budget_tokens)
    alpha, share, repetition, met = 1.0, 1.0, 1.0, True
    if n and few:
        counts = np.array(sorted(r["n_tokens"] for r in sources.where("n_tokens > 0").select("n_tokens").collect()), np.float64)
        alpha, share, repetition, met = temperature(measured(counts, budget), n, entropy_share, max_repetition)
    elif n:
        alpha, share, repetition, met = temperature(measured_by_job(sources, budget), n, entropy_share, max_repetition, CUTS)
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(float(max(most, 1))), F.lit(alpha))).otherwise(0.0)
    z = sources.agg(F.coalesce(F.sum(power), F.lit(0.0))).first()[0] or 1.0
    quotas = (
        sources.withColumn("weight", F.round(power / F.lit(z), WEIGHT_DIGITS))
        .withColumn("__quota", F.col("weight") * F.lit(budget))
        .withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("__quota") / F.col("n_tokens") + F.lit(1e-9))).otherwise(1).cast("long"))
        .withColumn("__left", F.greatest(F.lit(0), F.floor(F.col("__quota") - F.col("passes") * F.col("n_tokens") + F.lit(1e-6))).cast("long"))
        .select("__src", "weight", "passes", "__left")
    )
    quotas = checkpointed(quotas)
    turn = F.concat(F.lit(f"{seed}|"), F.col("passes").cast("string"), F.lit("|"), F.col("__src.v"))
    bits = lambda shift: F.shiftright(F.col("__key"), KEY_BITS - shift).bitwiseAND(F.lit(BLOCKS - 1))
    placed = (
        units.join(small(quotas), "__src")
        .withColumn("__b1", block_place(bits(BLOCK_BITS), turn).cast("int"))
        .withColumn("__b2", bits(2 * BLOCK_BITS).cast("int"))
    )
    narrow = placed.select("__src", "__left", "__b1", "__b2", "__key", "__tokens")
    first = checkpointed(_edge(narrow, "__b1", []))
    second = checkpointed(_edge(narrow.drop("__left").join(small(first), ["__src", "__b1"]), "__b2", ["__b1"]))
    at = narrow.drop("__left").join(small(second), ["__src", "__b1", "__b2"])
    third = _edge(at, "__key", ["__b1", "__b2"])
    # rows strictly before the edge, in the order (block, sub-block, key), are drawn once more
    edges = (
        first.select("__src", F.col("__b1").alias("__e1"))
        .join(second.select("__src", F.col("__b2").alias("__e2")), "__src", "left")
        .join(third.select("__src", F.col("__key").alias("__e3")), "__src", "left")
    )
    edges = checkpointed(edges)
    b1, b2, key, e1, e2, e3 = (F.col(c) for c in ("__b1", "__b2", "__key", "__e1", "__e2", "__e3"))
    again = e1.isNull() | (b1 < e1) | ((b1 == e1) & (e2.isNull() | (b2 < e2) | ((b2 == e2) & (e3.isNull() | (key < e3)))))
    again = again & (F.col("__left") > 0)
    return placed.join(small(edges), "__src", "left").select(
        id_col,
        F.col("__name").alias("source"),
        F.col("__tokens").alias("n_tokens"),
        F.col("weight"),
        F.lit(alpha).alias("alpha"),
        F.lit(share).alias("entropy_share"),
        F.lit(repetition).alias("repetition"),
        F.lit(met).alias("on_target"),
        F.col("passes"),
        (F.col("passes") + again.cast("long")).alias("copies"),
        F.col("__key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """``docs`` with each row as often as it is drawn, all columns kept."""
    drawn = draw(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    named = lambda c: F.struct(c.isNull(), F.coalesce(c.cast("string"), F.lit("")))
    copies = drawn.where("copies > 0").select("__key", named(F.col("source")).alias("__s"), F.col("copies").alias("__copies")).dropDuplicates(["__key", "__s"])
    keyed = docs.withColumn("__key", unit_key(seed, F.col(id_col), F.col(text_col))).withColumn("__s", named(F.col(source_col)))
    joined = keyed.join(copies, ["__key", "__s"])
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
