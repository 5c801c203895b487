"""One key holds a third of the rows: joins split it, numbering cuts through it."""

import pytest
from pyspark.sql import functions as F

from postweave.operators import collect, documents
from postweave.operators.joins import even_join, thinned_keys
from postweave.operators.ordering import ordered_chunks

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key in SETTINGS:
        spark.conf.unset(key)


def hot(spark, name):
    """60,000 rows from several tasks, a third of them with key 7."""
    rows = spark.range(0, 60_000, 1, 6)
    return rows.select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("string").alias(name), "id")


def final_plan(frame):
    """Row count, and the plan that adaptive execution ended with."""
    whole = frame.agg(F.count("*").alias("n"), F.sum(F.hash(*frame.columns)))
    rows = whole.collect()[0].n
    return rows, whole._jdf.queryExecution().executedPlan().toString()


def test_anti_join_splits_the_hot_key(skewed):
    done = skewed.range(2500, 2600).select(F.col("id").cast("string").alias("key"))
    rows, plan = final_plan(collect.only_new(hot(skewed, "key"), done, "key"))
    assert "SortMergeJoin(skew=true)" in plan
    assert rows == hot(skewed, "key").filter("cast(key as int) not between 2500 and 2599").count()


def test_lookup_splits_the_hot_selection(skewed):
    schema = "id string, title string, company string, details array<struct<key:string,value:string>>, seq bigint"
    postings = skewed.range(5000).selectExpr(
        "cast(id as string) as id", "concat('t', id) as title", "'c' as company",
        "cast(null as array<struct<key:string,value:string>>) as details", "id as seq",
    )
    assert postings.schema.simpleString() == skewed.createDataFrame([], schema).schema.simpleString()
    selection = hot(skewed, "job_id").withColumnRenamed("id", "rank")
    rows, plan = final_plan(documents.lookup_for_display(selection, postings, ["seq"]))
    assert "SortMergeJoin(skew=true)" in plan
    assert rows == 60_000


def test_aggregated_side_gets_its_own_exchange(skewed):
    totals = hot(skewed, "key").groupBy("key").agg(F.count("*").alias("n"))
    rows, plan = final_plan(even_join(hot(skewed, "key"), totals, "key"))
    assert "SortMergeJoin(skew=true)" in plan
    assert rows == 60_000


def test_copies_are_combined_before_the_shuffle(skewed):
    assert thinned_keys(hot(skewed, "key"), "key").filter("key = '7'").count() <= 6


def test_chunks_cut_through_the_hot_key(skewed):
    sizes = [r["count"] for r in ordered_chunks(hot(skewed, "key"), "key", "id").groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 60_000 / 3
