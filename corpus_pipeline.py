"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality classifier, n-gram Jaccard join (one row of each class of near copies stays), benchmark
decontamination, mixing to source weights, token files. All stages but the last return the columns
of ``documents``. The last encodes the documents it is given into token files in the shared folder
and returns what it reads back from them.

Rows are treated as the operators' docstrings say: null and empty texts are scored by the
classifier like others, are never near copies and never contaminated, and cost no tokens. Empty
tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollmill.llm import jaccard, linecrf, mixing, tiling, tokenfiles
from rollmill.llm.cluster import shared_path

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from ``documents`` and ``labels``."""
    crf = linecrf.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return linecrf.keep_good(docs, crf)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under whose tiles no benchmark item lies."""
    return tiling.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' temperature weights draw them, from a budget of half as many tokens again as there are."""
    return mixing.mix(docs, budget_share=mixing.BUDGET_SHARE)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    import public_tokenizers

    return tokenfiles.token_table(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
    ("token files", token_files),
]

#: No stage but the mixing is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each through a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
