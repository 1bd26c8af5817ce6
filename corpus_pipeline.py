"""A training corpus from raw documents: quality classifier, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet in the cluster's shared folder and read again. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, mixing, ngram_join, packing, quality, queries, shared


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    return quality.keep_good(docs, shared.read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    shared.workers_find_package(spark)
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per epoch that takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    shared.workers_find_package(spark)
    return packing.packed_documents(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # the classifier is trained; tests compare every stage with a brute-force version instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir))
    return docs
