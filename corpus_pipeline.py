"""The corpus pipeline: documents in, token ids out. Each stage works on all that the one before it kept.

Rows without an id pass the two deduplications as they are; a null text counts as empty; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from strata.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_predicted") == 1).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; a document of which no line with a word is left goes."""
    left = line_dedup.dedup_lines(docs, per=line_dedup.PER, rounds=None)
    return left.where((F.col("n_lines_kept") > 0) | (F.col("n_lines_dropped") == 0)).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    return bpe.encode_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", distinct_lines), ("MinHash near-dedup", distinct_documents), ("mixing sources to target weights", mixture), ("BPE encoding", tokens)]
#: Neither the classifier's fit, the signatures nor the merges can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
