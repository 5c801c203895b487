"""Attempts and failure streaks of a log that keeps growing, held as keyed streaming state.

Each key's state is its number of attempts, the first success among the allowed ones, the last error, and the failures
in a row that are still open. A micro-batch changes the state of the keys that it has events of; it gives
one row for each key whose outcome may have changed, and one for each run of failures that is long enough and is new
or has grown. Later rows replace earlier ones of the same key, or of the same key and beginning of the run, so
what is saved last equals the batch operators' answer over the whole log.

Events have to arrive in order from one micro-batch to the next; within one they are sorted. A key's events of one
micro-batch meet in one task, so the files taken at a time bound it. The state of a key that has had no event for
``expire_after`` (by event time) goes; later events then count from the beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postweave.operators.collect import ATTEMPTS_PER_POSTING, FAILURE_LIMIT, last_wins
from postweave.streaming.progress import saved_rows

ATTEMPT, RUN = "attempt", "run"
DAY = 86_400_000


def _simple(log: DataFrame, column: str) -> str:
    return log.schema[column].dataType.simpleString()


def follow(
    log: DataFrame, key: str, order: list[str], failed: Column, message: Column, attempts: int = ATTEMPTS_PER_POSTING,
    at_least: int = FAILURE_LIMIT, expire_after: int = 30 * DAY, late: str = "1 day",
) -> DataFrame:
    """Changes of a streaming log's outcomes and failure runs, for :func:`collect_changes`.

    ``order`` names the event time and the event's id. ``expire_after`` is in milliseconds. Events that come more than
    ``late`` behind the newest one are left out, as their place in a streak cannot be known any more.
    """
    time, event = order
    event_type = _simple(log, event)
    slim = log.select(key, F.col(time).cast("timestamp").alias(time), event, failed.alias("_failed"), message.cast("string").alias("_message")).withWatermark(time, late)
    out = (
        f"kind string, {key} {_simple(log, key)}, ok boolean, attempts long, error string, run_length long, "
        f"first_{event} {event_type}, last_{event} {event_type}"
    )
    kept = f"tried long, success long, error string, run long, first {event_type}, last {event_type}"
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tried, success, error, run, first, last = state.get if state.exists else (0, None, None, 0, None, None)
        rows = pd.concat(list(parts)).sort_values([time, event], kind="stable")
        bad, events, changes = rows["_failed"].to_numpy(bool), rows[event].tolist(), []
        for failure, text in zip(bad[: max(0, attempts - tried)].tolist(), rows["_message"].tolist()):
            tried += 1
            if failure:
                error = text
            elif success is None:
                success = tried
        changes.append((ATTEMPT, group[0], success is not None, success or tried, None if success else error, None, None, None))
        # stretches of equal outcome; the first may go on a run of the state
        edges = np.flatnonzero(np.diff(bad)) + 1
        for begin, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(bad)]):
            if not bad[begin]:
                run, first, last = 0, None, None
                continue
            first = events[begin] if not run else first
            run, last = run + stop - begin, events[stop - 1]
            if run >= at_least:
                changes.append((RUN, group[0], None, None, None, run, first, last))
        state.update((tried, success, error, run, first, last))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + expire_after)
        yield pd.DataFrame({n: pd.Series([c[i] for c in changes], dtype="object") for i, n in enumerate(names)})

    return slim.groupBy(key).applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def collect_changes(changes: DataFrame, sink: str, checkpoint: str) -> None:
    """Save the changes of all that is there now, then stop; the next call goes on from there with the same state."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    query = changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def saved_attempts(spark: SparkSession, sink: str, key: str) -> DataFrame | None:
    """``key, ok, attempts, error`` as the batch operator gives them over all events so far."""
    saved = saved_rows(spark, sink)
    if saved is None:
        return None
    return last_wins(saved.filter(F.col("kind") == ATTEMPT), key, ["batch_id"]).select(key, "ok", "attempts", "error")


def saved_runs(spark: SparkSession, sink: str, key: str, event: str) -> DataFrame | None:
    """The failure runs so far, the open ones included."""
    saved = saved_rows(spark, sink)
    if saved is None:
        return None
    runs = saved.filter(F.col("kind") == RUN).withColumn("_run", F.struct(key, f"first_{event}"))
    latest = last_wins(runs, "_run", ["batch_id", "run_length"])
    return latest.select(key, "run_length", f"first_{event}", f"last_{event}")
