"""Collection that saves its progress: new files in, unseen postings appended per micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators.collect import last_wins, only_new, success_filter


def saved_rows(spark: SparkSession, sink: str) -> DataFrame | None:
    """What earlier batches saved, with their ``batch_id``; None before the first save."""
    try:
        return spark.read.parquet(sink)
    except AnalysisException:
        return None


def append_unseen(batch: DataFrame, batch_id: int, sink: str, key: str, order: list[str]) -> None:
    """Save the rows of one batch whose key no other batch has saved successfully.

    Rows that carry ``details`` and ``error`` are successful as :func:`succeeded` says; a posting that
    was saved as failed is collected again, and :func:`latest_saved` gives its last version. Rows
    of other shapes are all successful.
    The batch overwrites its own folder only, so a batch that runs again after a failure leaves
    the same rows behind.
    """
    rows = last_wins(batch, key, order)
    saved = saved_rows(batch.sparkSession, sink)
    if saved is not None:
        done = saved.filter(F.col("batch_id") != batch_id)
        if {"details", "error"} <= set(saved.columns):
            done = success_filter(done)
        rows = only_new(rows, done, key)
    rows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def latest_saved(spark: SparkSession, sink: str, key: str) -> DataFrame | None:
    """One row per key: what the last batch that saved it found."""
    saved = saved_rows(spark, sink)
    return None if saved is None else last_wins(saved, key, ["batch_id"])


def collect_available(stream: DataFrame, sink: str, checkpoint: str, key: str, order: list[str]) -> None:
    """Process all files that are there now, then stop; the next call goes on from there."""

    def save(batch: DataFrame, batch_id: int) -> None:
        append_unseen(batch, batch_id, sink, key, order)

    (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def posting_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def table_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """The files of one table: ``path`` itself where it is a file, else the files in it.

    The last character is given as a pattern. Spark takes what a pattern finds, be it a file or a folder, while a plain
    path has to be a folder.
    """
    return posting_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, pattern)
