"""Running sums and look-ahead over a total order, in two passes over ranges of it.

Rows are dealt by range of (key, order), so a key that holds a third of all rows, or an order
without any key, lies in as many partitions as it needs. Each range sums for itself; a key that
goes on from one range into the next is the first key of that next one, so what has to be carried
over is at most one row for each range, and that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollmill.sources.shared import checkpointed


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, last: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds, within a key: ``sums`` up to and with the row, ``ahead`` as of the next row, the ``last`` values that are not null up to and with the row, and ``previous`` as of the row before.

    ``order``: columns, ascending, nulls first; rows that tie in all of them stand in no certain
    order. Null keys are a key. Values before the first and after the last row are null. The rows
    are checkpointed once, so both passes read the same ranges.
    """
    sums, ahead, last, previous = sums or {}, ahead or {}, last or {}, previous or {}
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    # a window needs a key; without one, all rows of a range have the same
    key = by or ["__all"]
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    packed = lambda these: F.struct(F.lit(0).alias("__"), *(c.alias(a) for a, c in these.items()))
    rows = rows.withColumns({f"__s{k}": c for k, c in enumerate(sums.values())} | {f"__v{k}": c for k, c in enumerate(last.values())} | {"__ahead": packed(ahead), "__prior": packed(previous)})
    placed = checkpointed(rows.repartitionByRange(n, *key, *order).withColumn("__part", F.spark_partition_id()))
    within = W.partitionBy("__part", *key).orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    at = F.struct(*order)
    known = [F.max_by(F.struct(F.col(f"__v{k}").alias("v")), F.when(F.col(f"__v{k}").isNotNull(), at)) for k in range(len(last))]
    edges = placed.groupBy("__part", *key).agg(
        *(F.sum(f"__s{k}").alias(f"__t{k}") for k in range(len(sums))), *(c.alias(f"__w{k}") for k, c in enumerate(known)), F.min_by("__ahead", at).alias("__head"), F.max_by("__prior", at).alias("__tail")
    )
    along = W.partitionBy(*key).orderBy("__part")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        F.col("__part").alias("__p"),
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(key)),
        *(F.sum(f"__t{k}").over(before).alias(f"__b{k}") for k in range(len(sums))),
        *(F.last(f"__w{k}", ignorenulls=True).over(before).alias(f"__x{k}") for k in range(len(last))),
        F.lead("__head").over(along).alias("__next"),
        F.lag("__tail").over(along).alias("__before"),
    )
    carried = edges.where(F.col("__before").isNotNull() | F.col("__next").isNotNull())  # two rows for each range at most
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    own = placed.withColumns(
        {f"__r{k}": F.sum(f"__s{k}").over(upto) for k in range(len(sums))}
        | {f"__y{k}": F.last(F.when(F.col(f"__v{k}").isNotNull(), F.struct(F.col(f"__v{k}").alias("v"))), ignorenulls=True).over(upto) for k in range(len(last))}
        | {"__l": F.lead("__ahead").over(within), "__f": F.lag("__prior").over(within)}
    )
    joined = own.join(F.broadcast(carried), same, "left")
    added = {name: F.coalesce(f"__r{k}", F.lit(0)) + F.coalesce(f"__b{k}", F.lit(0)) for k, name in enumerate(sums)}
    added |= {name: F.coalesce("__l", "__next")[name] for name in ahead}
    added |= {name: F.coalesce(f"__y{k}", f"__x{k}")["v"] for k, name in enumerate(last)}
    added |= {name: F.coalesce("__f", "__before")[name] for name in previous}
    return joined.select(*(c for c in names if c not in added), *(c.alias(name) for name, c in added.items()))


def numbered(rows: DataFrame, order: list[str], name: str = "place", by: list[str] | None = None) -> DataFrame:
    """Adds the place of each row, from 1, in the order of all rows (or of a key's)."""
    return running(rows, by or [], order, {name: F.lit(1).cast("long")})
