"""Incremental collection: what is done, what is new, attempts, limits, failure runs, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.operators.joins import thinned_keys
from postweave.operators.ordering import dense_ids, ordered_chunks, with_previous

# Fixed values.
ATTEMPTS_PER_POSTING = 2
FAILURE_LIMIT = 5
ROWS_PER_SAVE = 10

_SMALL_LIMIT = 100_000  # up to here a top-n keeps at most this many rows per task


def succeeded(details: str = "details", error: str = "error") -> Column:
    return F.col(details).isNotNull() & F.col(error).isNull()


def success_filter(postings: DataFrame) -> DataFrame:
    return postings.filter(succeeded())


def only_new(found: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Found rows whose key is not among the finished ones."""
    return found.join(thinned_keys(done, key), key, "left_anti")


def resolve_attempts(
    log: DataFrame, key: str, order: list[str], failed: Column, message: Column, attempts: int = ATTEMPTS_PER_POSTING
) -> DataFrame:
    """Per key: the first success among the first attempts, else the last error.

    The row-number filter becomes a per-task limit before the shuffle, so at most ``attempts``
    rows of a key leave any task however many rows the key has.
    """
    window = Window.partitionBy(key).orderBy(*order)
    tried = (
        log.select(key, *order, failed.alias("_failed"), message.alias("_message"))
        .withColumn("attempt", F.row_number().over(window))
        .filter(F.col("attempt") <= attempts)
    )
    success = F.min(F.when(~F.col("_failed"), F.col("attempt")))
    last_error = F.max_by(F.col("_message"), F.when(F.col("_failed"), F.col("attempt")))
    return tried.groupBy(key).agg(
        success.isNotNull().alias("ok"),
        F.coalesce(success, F.max("attempt")).cast("bigint").alias("attempts"),
        F.when(success.isNull(), last_error).alias("error"),
    )


def within_cap(
    new: DataFrame, n_old: Column, max_rows: int, order: list[str], strict: bool = False
) -> DataFrame:
    """The new rows that still find room when ``n_old`` are there already.

    The limit is tested after each append, so a full collection still gains one row; ``strict``
    turns that off.
    """
    room = F.greatest(F.lit(max_rows) - n_old, F.lit(0 if strict else 1))
    if max_rows <= _SMALL_LIMIT:
        first = new.orderBy(*order).limit(max(max_rows, 1))  # top-n, not a full sort
        ranked = first.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        ranked = dense_ids(new, *order, name="_place")
    return ranked.filter(F.col("_place") < room).drop("_place")


def cap_rows(old: DataFrame, new: DataFrame, max_rows: int, order: list[str], strict: bool = False) -> DataFrame:
    """Old rows plus new ones until ``max_rows`` is reached."""
    n_old = old.select(F.count("*").alias("n")).scalar()
    return old.unionByName(within_cap(new, n_old, max_rows, order, strict))


def failure_runs(
    log: DataFrame, key: str, order: list[str], failed: Column, at_least: int = FAILURE_LIMIT
) -> DataFrame:
    """Runs of consecutive failures per key.

    The number of successes before it is the same for all failures of a run and for no other failure of its key.
    It is counted over the whole order, so one range sort is enough.
    """
    rows = ordered_chunks(log.select(key, *order, F.coalesce(failed, F.lit(False)).alias("_failed")), key, *order)
    inside = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    totals = rows.groupBy("_chunk").agg(F.count_if(~F.col("_failed")).alias("_successes"))
    before = totals.select("_chunk", F.coalesce(F.sum("_successes").over(earlier), F.lit(0)).alias("_before"))
    counted = rows.withColumn("_inside", F.count_if(~F.col("_failed")).over(inside)).filter("_failed")
    place = F.struct(F.col("_chunk"), F.col("_pos"))
    runs = counted.join(F.broadcast(before), "_chunk").groupBy(key, (F.col("_before") + F.col("_inside")).alias("_island")).agg(
        F.count("*").alias("run_length"),
        F.min_by(order[-1], place).alias(f"first_{order[-1]}"),
        F.max_by(order[-1], place).alias(f"last_{order[-1]}"),
    )
    return runs.filter(F.col("run_length") >= at_least).drop("_island")


def page_advance(log: DataFrame, key: str, order: list[str], first_key: Column) -> DataFrame:
    """Whether the first key of a page differs from that of the page before (true on the first)."""
    paired = with_previous(log.withColumn("first_key", first_key), key, order, first_key, "previous_key")
    return paired.withColumn("advanced", ~F.col("first_key").eqNullSafe(F.col("previous_key")))


def append_union(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Old rows first, then the new ones, both in the given order, with their ``place``."""
    placed = dense_ids(old, *order, name="place")
    return placed.unionByName(placed_after(placed, new, order, "place"))


def placed_after(old: DataFrame, new: DataFrame, order: list[str], place: str) -> DataFrame:
    """New rows with their ``place``, counted from the last place of the old ones on."""
    following = old.select((F.max(place) + 1).alias("n")).scalar()
    numbered = dense_ids(new, *order, name="_place")
    return numbered.withColumn(place, F.col("_place") + F.coalesce(following, F.lit(0))).drop("_place")


def outcome_summary(postings: DataFrame) -> DataFrame:
    return postings.agg(
        F.count("*").alias("total"),
        F.count_if(succeeded()).alias("successful"),
        F.count_if(~succeeded()).alias("failed"),
    )


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in the given order; copies are combined before the shuffle."""
    window = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    ranked = rows.withColumn("_latest", F.row_number().over(window))
    return ranked.filter(F.col("_latest") == 1).drop("_latest")


def batch_numbers(rows: DataFrame, order: list[str], size: int = ROWS_PER_SAVE) -> DataFrame:
    """Add the number of the save that first holds each row."""
    numbered = dense_ids(rows, *order, name="_place")
    return numbered.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")
