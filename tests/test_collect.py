import random

import pytest
from pyspark.sql import functions as F

from postweave.operators import collect as C
from postweave.operators.joins import even_join
from postweave.operators.ordering import dense_ids, with_previous
from postweave.plans import collecting
from postweave.streaming import progress


def log(spark, rows):
    return spark.createDataFrame(rows, "id string, ts int, ok boolean, msg string")


@pytest.mark.parametrize(
    "outcomes, wanted",
    [
        ([False, True], (True, 2, None)),
        ([False, False], (False, 2, "m1")),
        ([True], (True, 1, None)),
        ([False, False, True], (False, 2, "m1")),
        ([True, False], (True, 1, None)),
        ([False], (False, 1, "m0")),
    ],
)
def test_attempts(spark, outcomes, wanted):
    rows = [("a", i, ok, f"m{i}") for i, ok in enumerate(outcomes)]
    random.Random(1).shuffle(rows)
    row = C.resolve_attempts(log(spark, rows), "id", ["ts"], ~F.col("ok"), F.col("msg")).first()
    assert (row.ok, row.attempts, row.error) == wanted


@pytest.mark.parametrize(
    "n_old, cap, strict, wanted",
    [(0, 3, False, 3), (3, 3, False, 4), (5, 3, False, 6), (3, 3, True, 3), (0, 0, False, 1), (1, 100, False, 11)],
)
def test_cap(spark, n_old, cap, strict, wanted):
    old = spark.range(n_old)
    new = spark.range(100, 110)
    rows = C.cap_rows(old, new, cap, ["id"], strict)
    ids = sorted(r.id for r in rows.collect())
    assert ids == list(range(n_old)) + list(range(100, 100 + wanted - n_old))


def test_large_cap_takes_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(C, "_SMALL_LIMIT", 1)
    rows = C.cap_rows(spark.range(2), spark.range(10, 20), 6, ["id"])
    assert sorted(r.id for r in rows.collect()) == [0, 1, 10, 11, 12, 13]


def test_failure_runs(spark):
    def stretch(key, *lengths):
        """Runs of failures, each ended by a success."""
        return [(key, f) for n in lengths for f in [True] * n + [False]]

    rows = stretch("a", 4, 5, 6) + stretch("b", 2, 4, 5) + [("b", True)] * 7
    data = [(k, i, f) for i, (k, f) in enumerate(rows)]
    random.Random(2).shuffle(data)
    frame = spark.createDataFrame(data, "id string, n int, failed boolean")
    runs = C.failure_runs(frame, "id", ["n"], F.col("failed"))
    assert sorted((r.id, r.run_length) for r in runs.collect()) == [("a", 5), ("a", 6), ("b", 5), ("b", 7)]
    for r in runs.collect():
        assert r.last_n - r.first_n + 1 == r.run_length


def test_hot_key_is_numbered_over_many_chunks(spark):
    rows = spark.range(4000).withColumn("key", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    numbered = dense_ids(rows, "key", "id").collect()
    order = sorted((r.key, r.id) for r in numbered)
    assert [(r.key, r.id) for r in sorted(numbered, key=lambda r: r.internal_id)] == order
    assert sorted(r.internal_id for r in numbered) == list(range(4000))


def test_previous_crosses_chunks_but_not_keys(spark):
    rows = spark.range(1000).withColumn("key", F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 7).cast("string")))
    found = {r.id: r.before for r in with_previous(rows, "key", ["id"], F.col("id"), "before").collect()}
    last = {}
    for i in range(1000):
        key = "hot" if i < 700 else str(i % 7)
        assert found[i] == last.get(key)
        last[key] = i


def test_page_advance_treats_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "b")], "s int, n int, k string")
    got = C.page_advance(rows, "s", ["n"], F.col("k")).orderBy("n").collect()
    assert [r.advanced for r in got] == [True, False, True, False, True]


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "id string, seq int")
    once = C.last_wins(rows, "id", ["seq"])
    assert sorted(map(tuple, once.collect())) == [("a", 3), ("b", 1)]
    assert sorted(map(tuple, C.last_wins(once, "id", ["seq"]).collect())) == [("a", 3), ("b", 1)]


def test_only_new_is_idempotent(spark):
    done = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    found = spark.createDataFrame([(1,), (3,), (3,), (4,)], "id int")
    new = C.only_new(found, done, "id")
    assert sorted(r.id for r in new.collect()) == [3, 3, 4]
    assert sorted(r.id for r in C.only_new(new, done, "id").collect()) == [3, 3, 4]


def test_success_and_summary(spark):
    schema = "id string, details array<struct<key:string,value:string>>, error string"
    rows = spark.createDataFrame([("a", [("k", "v")], None), ("b", None, None), ("c", [("error", "x")], "x")], schema)
    assert [r.id for r in C.success_filter(rows).collect()] == ["a"]
    assert tuple(C.outcome_summary(rows).first()) == (3, 1, 2)


def test_append_keeps_old_rows_first(spark):
    placed = C.append_union(spark.range(5, 8), spark.range(0, 3), ["id"]).orderBy("place")
    assert [r.id for r in placed.collect()] == [5, 6, 7, 0, 1, 2]


def test_batches_of_ten(spark):
    batches = C.batch_numbers(spark.range(25), ["id"]).groupBy("batch").count()
    assert sorted(map(tuple, batches.collect())) == [(0, 10), (1, 10), (2, 5)]


def test_even_join_keeps_repeats(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k bigint, v string")
    got = sorted((str(r.k), str(r.v)) for r in even_join(left, right, "k").collect())
    assert got == [("1", "a"), ("1", "a"), ("2", "None"), ("None", "None")]


def page(rows):
    cells = "".join(f"<td>{c}</td>" for c in "cdefgh")
    body = "".join(f"<tr class='table__row--body'><th>{i}</th><td><a>{t}</a></td><td></td>{cells}</tr>" for i, t in rows)
    return f"<table><tbody>{body}</tbody></table>"


@pytest.mark.parametrize("cap, wanted", [(None, 6), (5, 5), (1, 4), (100, 6)])
def test_collect_round(spark, cap, wanted):
    pages = spark.createDataFrame(
        [(0, "u", page([(1, "one"), (2, "two")])), (1, "u", page([(3, "three"), (4, "four")]))],
        "page_id bigint, url string, html string",
    )
    details = spark.createDataFrame(
        [(str(i), f'<div class="dashboard-header--mini"><h2>T{i}</h2></div>') for i in (2, 3)], "id string, html string"
    )
    schema = ", ".join(f"{f} string" for f in collecting.FLAT_FIELDS) + (
        ", details array<struct<key:string,value:string>>, status_tags array<string>, error string, seq bigint"
    )
    flat = ["x"] * 7
    saved = spark.createDataFrame(
        [("1", *flat, [("k", "v")], [], None, 0), ("2", *flat, [("error", "x")], None, "x", 1), ("9", *flat, [], [], None, 2)],
        schema,
    )
    found = collecting.collect_round(saved, pages, details, cap).orderBy("seq").collect()
    every = [("1", None), ("2", "x"), ("9", None), ("2", None), ("3", None), ("4", "No detail page")]
    assert [(r.id, r.error) for r in found] == every[:wanted]
    assert [r.seq for r in found] == list(range(wanted))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "id bigint, seq bigint"
    spark.createDataFrame([(1, 1), (2, 1), (2, 2)], schema).write.parquet(folder)
    for _ in range(2):
        progress.collect_available(progress.posting_stream(spark, folder, schema), sink, marks, "id", ["seq"])
    spark.createDataFrame([(2, 9), (3, 1)], schema).write.mode("append").parquet(folder)
    progress.collect_available(progress.posting_stream(spark, folder, schema), sink, marks, "id", ["seq"])
    saved = sorted((r.id, r.seq) for r in spark.read.parquet(sink).collect())
    assert saved == [(1, 1), (2, 2), (3, 1)]


def test_a_batch_that_runs_again_leaves_the_same_rows(spark, tmp_path):
    sink = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, 1), (2, 1)], "id bigint, seq bigint")
    for _ in range(2):
        progress.append_unseen(batch, 0, sink, "id", ["seq"])
    progress.append_unseen(batch, 1, sink, "id", ["seq"])
    assert spark.read.parquet(sink).count() == 2
