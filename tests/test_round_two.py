"""Cases that the first round's fixtures did not hold."""

import json

import pytest
from pyspark.sql import functions as F

from postweave.operators import manifest, relay, search
from postweave.operators.documents import FLAT_FIELDS, posting_json
from postweave.operators.flatten import with_posting_text
from postweave.plans import matching
from postweave.sources import postings
from postweave.streaming import progress


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, vec array<double>")


def test_null_scores_are_no_matches_whatever_k(spark):
    corpus = vectors(spark, [(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5])], "internal_id")
    query = vectors(spark, [(0, [1.0, 0.0])], "query_id")
    for k in (3, search.SMALL_TOP_K + 1):
        assert [r["internal_id"] for r in search.topk(corpus, query, k).orderBy("rank").collect()] == [1, 3]
        assert search.topk(corpus, query.filter("false"), k).count() == 0
    many = search.topk_many(corpus, vectors(spark, [(0, [1.0, 0.0]), (1, None)], "query_id"), 3)
    assert [(r["query_id"], r["internal_id"]) for r in many.orderBy("query_id", "rank").collect()] == [(0, 1), (0, 3)]


def test_match_without_a_known_id_keeps_its_number(spark):
    corpus = vectors(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1])], "internal_id")
    names = spark.createDataFrame([(1, "job-1")], "internal_id long, job_id string")
    found = matching.match(corpus, vectors(spark, [(0, [1.0, 0.0])], "query_id"), 2, ids=names)
    assert [r["job_id"] for r in found.collect()] == ["job-1", "2"]


def test_null_order_keys_are_numbered(spark):
    rows = spark.createDataFrame([(None, [1.0]), (1, [2.0])], "n long, vec array<double>")
    index = search.build_index(rows, "vec", F.col("n").cast("string"), "n")
    assert sorted((r["internal_id"], r["job_id"]) for r in index.collect()) == [(0, "0"), (1, "1")]


def test_blocks_follow_the_size_of_the_corpus(spark):
    corpus = vectors(spark, [(i, [float(i % 7), 1.0]) for i in range(200)], "internal_id")
    queries = vectors(spark, [(i, [1.0, float(i)]) for i in range(20)], "query_id")
    whole = search.topk_many(corpus, queries, 3).collect()
    parts = search.topk_many(corpus, queries, 3, broadcast_limit=16, part_limit=400).collect()
    assert sorted(whole) == sorted(parts)
    few = search.topk_many(corpus, queries, 3, candidate_limit=10).collect()  # three queries a block
    assert sorted(whole) == sorted(few)
    pairs = search._block_pairs(corpus, queries, slices=40, least_parts=8)
    largest = pairs.select(F.size("c_ids").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 200 and pairs.count() > 0


def test_failed_postings_keep_their_error_and_are_tried_again(spark, tmp_path):
    columns = "id string, details array<struct<key:string,value:string>>, status_tags array<string>, error string"
    flat = [f for f in postings.FLAT_FIELDS if f != "id"]

    def rows(*values):
        frame = spark.createDataFrame(list(values), columns)
        return frame.select("*", *[F.lit("x").alias(f) for f in flat])

    failed, good = ("1", None, None, "Timeout"), ("1", [("a", "b")], [], None)
    postings.write_snapshot(rows(failed), str(tmp_path / "json"), "json")
    assert postings.resume_state(spark, str(tmp_path / "json")).first()["error"] == "Timeout"
    sink = str(tmp_path / "sink")
    for number, batch in enumerate((failed, good, good)):
        progress.append_unseen(rows(batch), number, sink, "id", ["id"])
    assert progress.saved_rows(spark, sink).count() == 2
    assert progress.latest_saved(spark, sink, "id").first()["error"] is None


def test_resume_reads_an_indented_list(spark, tmp_path):
    place = tmp_path / "jobs.json"
    place.write_text('[\n  {\n    "id": "1",\n    "details": {"a": "b"}\n  },\n  {\n    "id": "2"\n  }\n]')
    assert postings.resume_state(spark, str(place)).count() == 2
    place.write_text('[\n  {\n    "id": "1",')
    assert postings.resume_state(spark, str(place)).count() == 0


def test_line_ends_are_read_as_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n")
    assert postings.read_documents(spark, str(tmp_path)).first()["text"] == "one\ntwo\nthree\n"


@pytest.mark.parametrize("value", ["false", "0", "[]", "{}", '""', "null"])
def test_empty_values_give_way(spark, value):
    raw = spark.createDataFrame([(f'{{"text":{value},"output":"o","output_text":"t"}}',)], "raw string")
    found = raw.select(relay.reply_output_chain(F.col("raw")).alias("o"), relay.reply_text_chain(F.col("raw")).alias("t")).first()
    assert (found["o"], found["t"]) == ("o", "t")


def test_text_that_looks_empty_stays(spark):
    raw = spark.createDataFrame([('{"text":"false","output":"o"}',)], "raw string")
    assert raw.select(relay.reply_output_chain(F.col("raw"))).first()[0] == "false"


def test_unknown_flags_count_as_absent(spark):
    rows = spark.createDataFrame([(None, None)], "has_key boolean, has_host boolean")
    provider = F.lit(relay.NEEDS_HOST)
    assert rows.select(relay.credential_error(provider, F.col("has_key"), F.col("has_host"))).first()[0] is not None
    slots = spark.createDataFrame([(False, None, True, "a", "b")], "prescreening boolean, resume_slot boolean, cover_slot boolean, resume_path string, cover_path string")
    found = manifest.upload_actions(slots).first()
    assert (found["resume_action"], found["cover_action"]) == ("none", "upload")


def test_details_that_are_no_strings(spark, tmp_path):
    details = {"job_title": "R", "n": 5, "list": ["a", "\u00e9"], "none": None, "yes": True, "obj": {"z": 1}, "digits": "5"}
    posting = {f: None for f in FLAT_FIELDS} | {"id": "1", "details": details | {"required_skills": ["x"], "job_summary": 0}}
    (tmp_path / "jobs.json").write_text(json.dumps([posting, {"id": "2", "details": {"job_title": "S"}}]))
    read = postings.read_jobs_json(spark, str(tmp_path / "jobs.json"))
    others = {"n": "5", "list": '["a","\u00e9"]', "yes": "true", "obj": '{"z":1}', "required_skills": '["x"]', "job_summary": "0"}

    def found(frame):
        return {r.id: ([(p.key, p.value) for p in r.details], r.other_details) for r in frame.collect()}

    wanted = {"1": ([("job_title", "R"), ("digits", "5")], others), "2": ([("job_title", "S")], None)}
    assert found(read) == wanted
    texts = {r.id: r.text for r in with_posting_text(read).collect()}
    assert texts == {"1": 'R \n ["x"] \n 5', "2": "S"}  # 5 is the string, not the number
    postings.write_snapshot(read, str(tmp_path / "lines"), "json")
    assert found(postings.read_jobs_json(spark, str(tmp_path / "lines"), "lines")) == wanted
    assert found(postings.resume_state(spark, str(tmp_path / "lines"))) == wanted
    written = [json.loads(r.j) for r in read.orderBy("id").select(posting_json("other_details").alias("j")).collect()]
    known = {k: v for k, v in posting["details"].items() if v is not None}
    assert written[0]["details"] == known and written[1]["details"] == {"job_title": "S"}


def test_the_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(search, "KNOWN_TOKENS", 3)
    encoder = search.HashingEncoder(8)
    texts = ["a b c d e", "e d c b a f g", "a"]
    assert (encoder(texts) == search.HashingEncoder(8)(texts[::-1])[::-1]).all()
    assert len(encoder.places) <= 3
