"""A cleaning run over the documents table, stage by stage.

Rejected by the quality classifier, exact copies, near copies and documents
with benchmark passages go, in this order; what stays is encoded. All stages
but the last return the columns of documents. Each stage's module states what
happens to nulls, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import decontaminate, factor_quality, piece_codec, poly_dedup, simhash_cover
from chartloom.llm.shared import shared_folder, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on these documents' labels, does not reject."""
    machine = factor_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return factor_quality.keep_good(docs, machine)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return poly_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document with the smallest doc_id."""
    return simhash_cover.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what stays."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encode(docs, model, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: The classifier has no equivalent in SQL; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
