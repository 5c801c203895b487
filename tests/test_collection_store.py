"""A batch meets the bucketed collection without moving it; attempts and streaks as a stream."""

import random
from collections import Counter

from pyspark.sql import functions as F

from postweave.operators import collect
from postweave.sources import collection_store
from postweave.streaming import attempts, progress


def test_the_saved_side_stays_where_it_is(spark, tmp_path):
    saved = spark.range(2000).select("id", (F.col("id") % 2 == 0).alias("ok"), F.lit("x").alias("body"))
    collection_store.save_collection(saved, "kept_collection", str(tmp_path / "kept"), buckets=16)
    found = spark.createDataFrame([(i,) for i in [*range(1990, 2010)] * 2 + [None]], "id long")
    new = collection_store.only_unsaved(found, "kept_collection", succeeded=F.col("ok"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 16 out of 16" in plan and "body" not in plan
    expected = [i for i in range(1990, 2010) if i >= 2000 or i % 2] * 2 + [None]
    assert Counter(r["id"] for r in new.collect()) == Counter(expected)
    collection_store.save_collection(spark.range(2000, 2005).select("id", F.lit(True).alias("ok"), F.lit("y").alias("body")), "kept_collection",
                                     str(tmp_path / "kept"), buckets=16, mode="append")
    assert {r["id"] for r in collection_store.only_unsaved(spark.range(1998, 2008), "kept_collection").collect()} == {2005, 2006, 2007}


def events(spark, n, seed):
    draw = random.Random(seed)
    rows = [(i, f"2025-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", draw.choice([1, 1, 1, 2, 3, None]), draw.random() < 0.6, f"m{i}") for i in range(n)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, bad boolean, message string")
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def test_replayed_batches_equal_the_batch_operators(spark, tmp_path):
    log = events(spark, 400, 1)
    order, sink = ["ts", "event_id"], str(tmp_path / "sink")
    for low, high in ((0, 3), (3, 150), (150, 151), (151, 400)):
        log.filter(F.col("event_id").between(low, high - 1)).write.mode("append").parquet(str(tmp_path / "log"))
        stream = progress.posting_stream(spark, str(tmp_path / "log"), log.schema)
        changes = attempts.follow(stream, "user_id", order, F.col("bad"), F.col("message"), at_least=2)
        attempts.collect_changes(changes, sink, str(tmp_path / "marks"))
        so_far = log.filter(F.col("event_id") < high)
        rows = lambda df: Counter(tuple(r) for r in df.collect())
        expected = collect.resolve_attempts(so_far, "user_id", order, F.col("bad"), F.col("message"))
        assert rows(attempts.saved_attempts(spark, sink, "user_id")) == rows(expected)
    runs = collect.failure_runs(log, "user_id", order, F.col("bad"), 2).select("user_id", "run_length", "first_event_id", "last_event_id")
    assert rows(attempts.saved_runs(spark, sink, "user_id", "event_id")) == rows(runs) and runs.count() > 20


def test_nothing_saved_yet(spark, tmp_path):
    assert attempts.saved_attempts(spark, str(tmp_path / "none"), "k") is None and attempts.saved_runs(spark, str(tmp_path / "none"), "k", "e") is None
