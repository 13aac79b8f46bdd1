"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets as docs; all but the last return
the columns of documents. Decisions take effect: a stage's rejected rows are gone for those after it. Nulls, empty
tables and further columns are as in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from fieldloom.llm.common import checkpointed, table
from fieldloom.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded), the row with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 of five-word shingles, the one with the smallest id stays."""
    return near_dedup.deduplicated(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low and toxic documents beyond their targets beside the clean ones are thinned by their rates; none is repeated.

    The classifier learns from the labelled documents as they were before the stages, which leave few low ones.
    """
    return mixing.thinned(docs, table(spark, sf_dir, "labels"), examples=table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(bpe.encode(docs, TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: The stages learn references, sketches and rates; SQL can't express them. tests/llm holds the dedup and token stages
#: against brute force in test_pipeline.py, verdicts and rates in test_quality.py and test_mixing.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
