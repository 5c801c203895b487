"""Rows named by number, for operators that judge rows whatever their ids are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.session import scratch_path


def number_rows(docs: DataFrame) -> DataFrame:
    """Write the rows once: a number (``_row``) that later steps name them by, and the row itself (``_doc``).

    The row's own columns stay inside ``_doc``, so none of them can clash with the number.
    """
    path = scratch_path(docs.sparkSession, "numbered")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def field(name: str) -> Column:
    return F.col("_doc").getField(name)
