"""Documents to training tokens: quality rules, one document of each group of near copies, the mix of sources, encoding.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns a DataFrame; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import byte_pair, mixing, ngram_join, quality_rules, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return ngram_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (the tokens) of each document."""
    return byte_pair.encode_documents(docs, byte_pair.default_path()).drop("decoded")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: Merges of a tokenizer file can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    scratch = shared.Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
