"""Written tables that cut lineage: sizes known from files, rows settled, files released."""

from pathlib import Path

from pyspark.sql import functions as F

from postweave.session import cut_lineage, release


def size_of(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_size_estimates_stay_flat_in_loops(spark):
    state, sizes = cut_lineage(spark.range(100).withColumn("other", F.col("id") * 7 % 100)), []
    for _ in range(8):
        step = state.join(state.select(F.col("id").alias("other"), F.col("other").alias("next")), "other")
        after = cut_lineage(step.select("id", F.col("next").alias("other")))
        release(state)
        state = after
        sizes.append(size_of(state))
    assert max(sizes) < 2 * min(sizes) and state.count() == 100


def test_rows_are_settled_and_files_go(spark):
    drawn = cut_lineage(spark.range(50).withColumn("x", F.rand()))
    assert drawn.collect() == drawn.collect()
    place = Path(drawn.written_to.removeprefix("file:"))
    assert place.exists()
    release(drawn, None, spark.range(1))
    assert not place.exists()


def test_a_table_without_rows_keeps_its_columns(spark):
    none = cut_lineage(spark.createDataFrame([], "a long, b array<struct<c: string>>"))
    assert none.collect() == [] and none.dtypes == [("a", "bigint"), ("b", "array<struct<c:string>>")]
