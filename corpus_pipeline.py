"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before it kept and is written as Parquet before the next one
reads it. All stages but the last return the columns of ``documents``. Stages judge null and empty
texts, repeated rows and rows without an id as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postweave.llm import decontaminate, langid, packing, quality, simhash
from postweave.plans.registry import table
from postweave.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and documents in none of the learned languages go."""
    return langid.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (three-word shingles, three bits) stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of what is left."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
FEW_ROWS = 1024  # texts that travel to a Python worker together; each is held there and in the JVM, several times over

ORACLE_SQL = None  # trained models, token ids and bitwise fingerprints: checked by brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, min(FEW_ROWS, int(before)) if int(before) > 0 else FEW_ROWS)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(ROWS_AT_ONCE, before)
    return docs
