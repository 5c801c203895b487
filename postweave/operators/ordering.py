"""Row numbers and neighbours in a total order, without a window over a whole key.

Rows are range-partitioned and sorted once and written to the shared folder, so every later
stage sees the same cut. Only one summary row per chunk (there are as many as shuffle
partitions) is combined in one place. A key that holds a third of the rows is cut like any
other stretch of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the position inside a partition in 33 bits


def ordered_chunks(df: DataFrame, *order: str) -> DataFrame:
    """Add ``_chunk`` and ``_pos``: sorted chunks that follow each other in the given order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)  # as many chunks as their size asks for
    place = F.monotonically_increasing_id()
    return cut_lineage(
        ranged.select(
            "*",
            F.shiftright(place, _ROW_BITS).cast("int").alias("_chunk"),
            place.bitwiseAND((1 << _ROW_BITS) - 1).alias("_pos"),
        )
    )


def dense_ids(df: DataFrame, *order: str, name: str = "internal_id") -> DataFrame:
    """Number the rows 0..n-1 in the given order (unique keys give one defined numbering).

    The rows travel once, in the range exchange, and each row gets a number of its own, also where keys
    repeat or are null (null comes first).
    """
    rows = ordered_chunks(df, *order)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_chunk")
        .agg(F.count("*").alias("_n"))  # one row per chunk from here on
        .select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    numbered = rows.join(F.broadcast(starts), "_chunk")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_pos")).alias(name))


def with_previous(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the value of the row before within the key, as a lag over the whole key would."""
    rows = ordered_chunks(df.withColumn("_value", value), key, *order)
    inside = Window.partitionBy("_chunk").orderBy("_pos")
    last_rows = rows.groupBy("_chunk").agg(
        F.max_by(F.struct(F.col(key).alias("key"), F.col("_value").alias("value")), "_pos").alias("_last")
    )
    by_chunk = Window.orderBy("_chunk")  # one row per chunk
    borders = last_rows.select("_chunk", F.lag("_last").over(by_chunk).alias("_border"))
    own = F.struct(F.col(key).alias("key"), F.col("_value").alias("value"))
    previous = F.coalesce(F.lag(own).over(inside), F.col("_border"))
    joined = rows.join(F.broadcast(borders), "_chunk").withColumn("_previous", previous)
    same_key = F.col("_previous.key") == F.col(key)
    return joined.select(*df.columns, F.when(same_key, F.col("_previous.value")).alias(name))
