"""The vector index on disk: a table of vectors and a one-row table of metadata."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators.search import vector_profile
from postweave.sources import versions


def index_meta(index: DataFrame, model_name: str, source: str) -> DataFrame:
    """Metadata record; mixed vector sizes are an error."""
    profile = vector_profile(index)
    mixed = F.raise_error(F.lit("vectors of different sizes in one index")).cast("bigint")
    dim = F.when(F.col("min_dim") != F.col("max_dim"), mixed).otherwise(F.col("max_dim"))
    stamp = datetime.now(timezone.utc).replace(tzinfo=None).isoformat() + "Z"
    return profile.select(
        F.lit(stamp).alias("created_at"),
        F.lit(model_name).alias("model_name"),
        "num_vectors",
        dim.alias("dim"),
        F.lit(source).alias("source"),
    )


def meta_summary(meta: DataFrame) -> DataFrame:
    return meta.select("num_vectors", "model_name", "dim")


def _saved(index: DataFrame, prefix: str, part: str, model_name: str, source: str) -> DataFrame:
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{prefix}/vectors{part}")
    meta = index_meta(spark.read.parquet(f"{prefix}/vectors{part}"), model_name, source)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{prefix}/meta{part}")
    return spark.read.parquet(f"{prefix}/meta{part}")


def save_index(index: DataFrame, prefix: str, model_name: str, source: str) -> DataFrame:
    """Write ``<prefix>/vectors`` and ``<prefix>/meta``; the metadata is read off the written table."""
    meta = _saved(index, prefix, "", model_name, source)
    if versions.latest(prefix) is not None:
        versions.publish(prefix, {"part": ""})
    return meta


def save_version(index: DataFrame, prefix: str, model_name: str, source: str) -> DataFrame:
    """Write a new version of the index beside the one that it may have been made from, then put it in force."""
    part = f"-{uuid.uuid4().hex}"
    meta = _saved(index, prefix, part, model_name, source)
    versions.publish(prefix, {"part": part})
    return meta


def load_index(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and metadata of the version in force; both parts must exist."""
    part = (versions.latest(prefix) or {"part": ""})["part"]
    try:
        return spark.read.parquet(f"{prefix}/vectors{part}"), spark.read.parquet(f"{prefix}/meta{part}")
    except AnalysisException as error:
        raise FileNotFoundError(f"index or metadata not found for prefix: {prefix}") from error


def check_model(meta: DataFrame, model_name: str, dim: int) -> None:
    """A query must come from the model that made the index."""
    row = meta.select("model_name", "dim").first()
    if (row.model_name, row.dim) != (model_name, dim):
        raise ValueError(f"index holds {row.model_name} ({row.dim}), query is {model_name} ({dim})")
