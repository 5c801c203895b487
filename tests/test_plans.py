"""What the optimizer makes of the operators."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postweave.operators import collect, search
from postweave.plans import all_queries  # noqa: F401  (registers every query)
from postweave.plans.registry import ORACLES, QUERIES, table

ROOT = Path(__file__).resolve().parents[1]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


WITH_PYTHON = {
    "batch_generate", "encode_corpus", "encode_query", "match_batch", "match_cells", "match_files", "match_postings",
    "refresh_index", "index_changes", "prefilter_postings", "saved_generation", "followed_attempts", "followed_runs",
}
WITH_FILES = {
    "scan_jobs_json", "scan_text_docs", "sink_snapshot", "sink_checkpointed", "resume_state", "index_write",
    "index_read", "sink_documents", "scan_presence", "build_index", "plan_uploads", "collect_round",
    "scan_jobs_ranges", "resume_rejects", "sink_versions",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON - WITH_FILES))
def test_no_python_stage(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "MapInArrow" not in text


@pytest.mark.parametrize("name", ["encode_corpus", "encode_query"])
def test_encoder_runs_once_and_maps_only(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("ArrowEvalPython") == 1
    assert "hashpartitioning" not in text


def test_generator_runs_once_and_maps_only(spark, sf_dir):
    text = plan(QUERIES["batch_generate"](spark, sf_dir))
    assert text.count("ArrowEvalPython") == 1
    assert "hashpartitioning" not in text


@pytest.mark.parametrize("name", ["last_wins", "resolve_attempts"])
def test_few_rows_per_key_leave_a_task(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_k_is_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_search"](spark, sf_dir))


def test_many_queries_limit_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["match_batch"](spark, sf_dir))
    assert "MapInArrow" in text and "WindowGroupLimit" in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_FILES))
def test_no_cartesian_product(spark, sf_dir, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir))


def test_prefilter_reaches_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan(QUERIES["prefilter_match"](spark, sf_dir))


@pytest.mark.parametrize(
    "name, columns",
    [("incremental_new", "doc_id:bigint"), ("suffix_count", "url:string"), ("last_number_id", "page_id:bigint,url:string")],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(QUERIES[name](spark, sf_dir))


def test_hot_key_can_be_split(spark, sf_dir):
    """Both sides of the anti join have an exchange of their own, as adaptive execution needs it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
        found = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
        text = plan(collect.only_new(found, done))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(id") >= 2 and "SortMergeJoin" in text


def test_model_is_not_run_to_number_rows(spark, sf_dir, tmp_path):
    """The encoder sees each text once, although rows are sampled, sorted and numbered."""

    def counting(folder):
        import os
        import uuid

        def encode(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write(str(len(texts)))
            return search.HashingEncoder()(texts)

        return encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = search.build_index(search.encode(docs, "text", counting(str(tmp_path))), "vec", F.col("doc_id").cast("string"), "doc_id")
    assert index.count() == docs.count() == sum(int(p.read_text()) for p in tmp_path.iterdir())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_library_does_not_collect_or_use_local_checkpoints():
    for path in (ROOT / "postweave").rglob("*.py"):
        if path.parent.name == "llm":
            continue  # its bounded samples are tested beside it
        calls = {n.func.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not calls & {"collect", "toPandas", "localCheckpoint", "crossJoin", "toLocalIterator"}, path
