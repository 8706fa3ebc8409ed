"""A training corpus from ``documents``: five stages, each over all that the one before has kept.

Every stage is written as Parquet and read again by the next one. A stage that
filters or rewrites returns the columns of ``documents``; the last one returns
the mix: doc_id, size, source_size, target and taken words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, mixing, near_dup, pii, quality
from tallyframe.llm.common import table
from tallyframe.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dup.keep_firsts(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked and words that give them away are generalised or removed; n_chars stays as it was."""
    return pii.sanitised(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Components, spans by corpus counts and Newton steps have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
