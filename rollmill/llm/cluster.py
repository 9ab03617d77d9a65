"""What the operators need to know of the cluster: the shared folder and sensible partition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.sources.shared import checkpointed, shared_dir, shared_path

__all__ = ["buckets_for", "checkpointed", "id_fold", "shared_dir", "shared_path", "shuffle_partitions", "text_bytes", "utf8_crc32"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """Buckets of about ``each`` bytes, and no fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(spark), -(-int(n_bytes) // each))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column (nulls: 0); one scan, one row back."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("b")).first()["b"]


def utf8_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
