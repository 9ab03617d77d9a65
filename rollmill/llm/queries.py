"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.sharding import assign_shards

    shards = assign_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.jaccard import classes

    return classes(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.mixing import BUDGET_SHARE, draw

    return draw(table(spark, sf_dir, "documents"), budget_share=BUDGET_SHARE).drop("__key")


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.perplexity import judge

    return judge(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), length=35)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def licence_disguises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan for a known set that hits: documents in disguise, against all."""
    from rollmill.llm.licences import disguised, scan_licences

    docs = table(spark, sf_dir, "documents")
    return scan_licences(docs, disguised(docs))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.linecrf import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op8_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.tiling import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.grulm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rollmill.llm.tokenfiles import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rollmill.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.prefixtrie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollmill.llm.suffixdedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"), length=400)


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_mixing": op3_mixing,
        "op4_perplexity": op4_perplexity,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_licences": op6_licences,
        "op7_line_crf": op7_line_crf,
        "op8_tiling": op8_tiling,
        "op9_gru_lm": op9_gru_lm,
        "op10_token_files": op10_token_files,
        "op11_alignment": op11_alignment,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_suffix_dedup": op13_suffix_dedup,
        "licence_disguises": licence_disguises,
    }


def oracle_sql() -> dict[str, str]:
    from rollmill.llm.licences import disguised_sql, scan_sql
    from rollmill.llm.oracles import bytes_sql, jaccard_sql, mixing_sql, sharding_sql, substring_sql, trie_sql

    return {"op1_sharding": sharding_sql(), "op2_jaccard_join": jaccard_sql(), "op3_mixing": mixing_sql(), "op5_substring_dedup": substring_sql(), "op6_licences": scan_sql(), "op12_prefix_trie": trie_sql(), "op13_suffix_dedup": bytes_sql(), "licence_disguises": disguised_sql()}
