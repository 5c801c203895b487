"""Joins that stay even when one key holds a large share of the rows.

Adaptive execution splits a hot partition of a sort-merge join only when an exchange lies directly
under each side. A side that comes out of an aggregate or window on the same key brings its old
partitioning along and has no exchange of its own; these helpers give it one. Small sides are
still broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COPIES = 32  # a key keeps at most this many copies after the first combine


def thinned_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``rows``, copies combined inside the tasks; a few copies may remain.

    Enough for semi and anti joins, which do not count matches.
    """
    salted = rows.select(key, (F.spark_partition_id() % _COPIES).alias("_copy"))
    return salted.distinct().select(key)


def even_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on one key; ``right`` has one row per key, ``left`` may repeat a key any number of times."""
    own_key = F.concat(F.col(key).cast("string"), F.lit("")).alias("_key")
    keyed = right.select(own_key, *[c for c in right.columns if c != key])
    joined = left.join(keyed, left[key].cast("string") == keyed["_key"], how)
    return joined.drop("_key")
