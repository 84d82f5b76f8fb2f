"""The corpus pipeline: documents -> clean, distinct, secret-free, packed sequences.

Each stage calls one operator of ``pulse.llm`` on everything its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulse.llm import exact_dedup, mbs_packing, quality, secret_forest, simhash_bk
from pulse.llm.common import read, stage_table

BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.keep_first_of_groups(docs, shingle=3, radius=2, seed=42)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_forest.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mbs_packing.pack_documents(docs, BPE, capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

# The classifier, the forest and the tokeniser have no SQL; tests/llm/test_pipeline.py checks the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; every stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
