"""Index versions, refresh by content, numbering of repeated keys and the plans of the flagship."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import search
from postweave.plans import matching
from postweave.sources import postings, vector_store, versions


def counting_encoder(folder):
    """Hashing encoder that leaves one file for each text it is given; made here so that it travels whole."""
    import os
    import uuid

    class Counting:
        name = "hashing-64"

        def __call__(self, texts):
            for _ in texts:
                open(os.path.join(str(folder), uuid.uuid4().hex), "w").close()
            return search.HashingEncoder()(texts)

    return Counting()


def jobs(spark, rows):
    """(seq, id, title) to postings."""
    empty = postings.resume_state(spark, "/nowhere/at/all")
    made = spark.createDataFrame(rows, "seq long, id string, title string")
    return made.unionByName(empty.drop("id", "title"), allowMissingColumns=True)


def index_rows(index):
    return sorted((r["internal_id"], r["job_id"], tuple(r["vec"]), r["text_hash"]) for r in index.collect())


def test_only_new_texts_reach_the_encoder(spark, tmp_path):
    prefix, seen = str(tmp_path / "index"), tmp_path / "seen"
    seen.mkdir()
    encoder = counting_encoder(seen)
    first = [(i, f"j{i}", f"text {i % 40}") for i in range(60)] + [(100, None, "no id"), (101, None, "no id")]
    matching.vectorize_postings(jobs(spark, first), prefix, "s", ["seq"], encoder)
    assert len(list(seen.iterdir())) == 62
    second = [(i, f"j{i}", f"text {i % 40}" if i % 10 else f"changed {i}") for i in range(5, 70)] + [(101, None, "no id"), (200, "j300", "fresh")] * 2
    changes = matching.refresh_index(jobs(spark, second), prefix, "s", ["seq"], encoder)
    new = {t for _, _, t in second} - {t for _, _, t in first}
    assert len(list(seen.iterdir())) == 62 + len(new)
    found = {r["job_id"]: r["change"] for r in changes.collect()}
    assert found["j0"] == "gone" and found["j10"] == "changed" and found["j65"] == found["j300"] == "added" and found["j7"] == "same"
    rebuilt = matching.index_postings(jobs(spark, second), ["seq"], search.HashingEncoder())
    index, meta = vector_store.load_index(spark, prefix)
    assert index_rows(index) == index_rows(rebuilt) and meta.first()["num_vectors"] == rebuilt.count()
    matching.refresh_index(jobs(spark, second), prefix, "s", ["seq"], encoder)
    assert len(list(seen.iterdir())) == 62 + len(new)


def test_a_reader_keeps_the_version_it_has_opened(spark, tmp_path):
    prefix = str(tmp_path / "index")
    matching.vectorize_postings(jobs(spark, [(1, "a", "one")]), prefix, "s", ["seq"])
    before, _ = vector_store.load_index(spark, prefix)
    matching.refresh_index(jobs(spark, [(1, "a", "two"), (2, "b", "three")]), prefix, "s", ["seq"])
    assert before.count() == 1 and vector_store.load_index(spark, prefix)[0].count() == 2
    matching.vectorize_postings(jobs(spark, [(1, "a", "four")]), prefix, "s", ["seq"])  # a full build counts again
    assert vector_store.load_index(spark, prefix)[0].count() == 1


def test_an_index_of_another_model_is_built_anew(spark, tmp_path):
    prefix = str(tmp_path / "index")
    matching.vectorize_postings(jobs(spark, [(1, "a", "one")]), prefix, "s", ["seq"], search.HashingEncoder(32))
    matching.refresh_index(jobs(spark, [(1, "a", "one")]), prefix, "s", ["seq"])
    index, meta = vector_store.load_index(spark, prefix)
    assert meta.first()["model_name"] == "hashing-64" and len(index.first()["vec"]) == 64


def test_no_postings_and_postings_from_none(spark, tmp_path):
    prefix = str(tmp_path / "index")
    some = [(1, "a", "one"), (2, None, None)]
    matching.vectorize_postings(jobs(spark, some), prefix, "s", ["seq"])
    changes = matching.refresh_index(jobs(spark, some).limit(0), prefix, "s", ["seq"]).collect()
    assert {r["change"] for r in changes} == {"gone"} and vector_store.load_index(spark, prefix)[0].count() == 0
    assert {r["change"] for r in matching.refresh_index(jobs(spark, some), prefix, "s", ["seq"]).collect()} == {"added"}


def test_versions(tmp_path):
    root = str(tmp_path)
    assert versions.latest(root) is None
    assert [versions.publish(root, {"n": n}) for n in range(12)] == list(range(12)) and versions.latest(root) == {"n": 11}


def test_repeated_order_keys_get_one_number_each(spark):
    rows = [(7, "a", "x"), (7, "b", "y"), (None, "c", "z"), (None, "d", "u"), (1, "a", "older")]
    index = matching.index_postings(jobs(spark, rows), ["seq"]).collect()
    assert sorted(r["internal_id"] for r in index) == [0, 1, 2, 3] and sorted(r["job_id"] for r in index) == list("abcd")
    vecs = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0])], "seq long, vec array<double>")
    built = search.build_index(vecs, "vec", F.col("seq").cast("string"), "seq").collect()
    assert sorted(r["internal_id"] for r in built) == [0, 1, 2] and sorted(r["job_id"] for r in built) == ["0", "7", "7"]


def test_the_id_map_stays_where_it_is(spark, monkeypatch):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "internal_id long, vec array<double>")
    ids = spark.range(300).select(F.col("id").alias("internal_id"), F.concat(F.lit("job-"), "id").alias("job_id"))
    query = corpus.limit(1).select(F.col("internal_id").alias("query_id"), "vec")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = matching.match(corpus, query, 4, ids=ids)
        plan = matched._jdf.queryExecution().executedPlan().toString()
        found = matched.collect()
        best = search.topk(corpus, query, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert best.count("zip_with(") == 1 and "zip_with(" not in plan  # the product stands in one place
    assert len(found) == 4 and all(r["job_id"].startswith("job-") for r in found)


@pytest.mark.parametrize("k", [2, 5, 200_000])
def test_rows_without_a_score_match_nothing(spark, k):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [0.5, 0.5])]
    corpus = spark.createDataFrame(rows, "internal_id long, vec array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    found = search.topk(corpus, query, k).orderBy("rank").collect()
    assert [(r["rank"], r["internal_id"]) for r in found] == [(1, 1), (2, 4)]
