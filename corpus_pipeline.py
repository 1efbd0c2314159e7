"""From raw documents to token ids: the stages of the corpus, in order.

Each stage takes (spark, docs, sf_dir) and returns documents, or at the end
their ids; ``run`` writes what a stage returns before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.llm import byte_bpe, decontaminate, pii, quality, simhash
from cohortloom.session import cut, ship

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, _table(ship(spark), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the one with the least id."""
    ship(spark)
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, _table(ship(spark), sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    ship(spark)
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids, and the text that they decode to."""
    ship(spark)
    path = public_tokenizers.path(RANKS)
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.col("decoded").cast("string").alias("text"))


STAGES = [("quality", good_quality), ("near_duplicates", without_copies),
          ("decontamination", without_benchmark), ("personal_data", without_personal_data),
          ("byte_bpe", encoded)]

#: Hash folding, training and merging have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = _table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
