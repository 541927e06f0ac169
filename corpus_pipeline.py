"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept and applies one operator of sparkpact.llm to all
of it; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkpact.llm.exact_dedup import drop_copies
from sparkpact.llm.language_id import keep_identified
from sparkpact.llm.mixing import mixed_documents
from sparkpact.llm.near_copies import drop_similar
from sparkpact.llm.pieces import piece_digests
from sparkpact.llm.shared import drop, materialize, tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts, those without a letter, and those to which the network gives no language a score of 0.4."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keeps that of the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a five-word similarity of 0.8 links, keeps that of the smallest doc_id."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix of sources takes it, or not at all."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; doc_id, n_tokens and digests of ids and text."""
    return piece_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL can express neither the network of the first stage nor the mix's rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's own tables, and its predecessor's result, go once its result is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
        if written is not None:
            drop(written)
        written = docs
    return docs
