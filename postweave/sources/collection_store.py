"""The saved collection as a table bucketed by id, so that a batch meets it without moving it.

Rows of one id lie in one bucket. A join on the id shuffles the batch alone, into as many parts as there are buckets,
and reads each bucket where it is. The table is known to the session's catalogue under its name; its files lie in the
shared folder that is given. Appended batches add files to the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def save_collection(postings: DataFrame, name: str, path: str, key: str = "id", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write the collection, or with ``append`` add to it, as the table ``name`` in the folder ``path``."""
    dealt = postings.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode(mode).saveAsTable(name)


def saved_collection(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def only_unsaved(found: DataFrame, name: str, key: str = "id", succeeded=None) -> DataFrame:
    """Found rows whose key the table does not hold (as succeeded, if that is given). The saved side has no exchange."""
    saved = found.sparkSession.table(name)
    done = saved if succeeded is None else saved.filter(succeeded)
    return found.join(done.select(key).hint("merge"), key, "left_anti")
