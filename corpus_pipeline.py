"""Corpus pipeline over ``documents``: each stage reads what its predecessor kept, as Parquet.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a frame with the columns of ``documents`` (the last adds its own).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import exact_dedup, mixing, pieces, quality, simhash
from trellis.llm.common import prepare
from trellis.session import ensure_checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    prepare(spark)
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (smallest ``doc_id``)."""
    prepare(spark)
    return exact_dedup.dedup_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays (smallest ``doc_id``)."""
    prepare(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (zero to three times)."""
    prepare(spark)
    return mixing.mix_rows(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ``token_ids``."""
    prepare(spark)
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", good),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mixed),
    ("sentencepiece", tokenised),
]

#: Fingerprints, the balanced sample and the tokeniser have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written to the shared folder and read again."""
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
