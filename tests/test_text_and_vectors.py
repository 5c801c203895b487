import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postweave.functions import vectors as V
from postweave.operators import flatten, search
from postweave.plans import matching
from postweave.sources import vector_store

POSTING = (
    "id string, title string, company string, details array<struct<key:string,value:string>>, "
    "status_tags array<string>, error string, seq int"
)


def flat_text(title, company, details):
    """The rule in plain Python."""
    parts = [x for x in (title or details.get("job_title"), company or details.get("organization")) if x]
    parts += [details[k] for k in flatten.PRIORITY_FIELDS if details.get(k)]
    for key, value in details.items():
        if key != "job_title" and key not in flatten.PRIORITY_FIELDS and value and len(value) <= 2000:
            parts.append(value)
    return " \n ".join(parts)


CASES = [
    ("T", "C", {"job_summary": "s", "notes": "n", "level": "l"}),
    ("", None, {"job_title": "J", "organization": "O", "required_skills": "", "job_summary": "N/A"}),
    (None, "", {"job_title": "", "organization": None}),
    ("T", "C", {"error": "Timeout"}),
    ("T", "C", {"a": "x" * 2000, "b": "y" * 2001, "c": "é" * 2000}),
    ("T", "C", {}),
    (" ", "C", {"targeted_degrees_and_disciplines": "d", "job_summary": "s", "additional_information": "i"}),
]


def test_posting_text(spark):
    rows = [(str(i), t, c, list(d.items()), ["tag"], None, i) for i, (t, c, d) in enumerate(CASES)]
    got = flatten.with_posting_text(spark.createDataFrame(rows, POSTING)).orderBy("seq").collect()
    assert [r.text for r in got] == [flat_text(*case) for case in CASES]


def test_posting_text_without_details(spark):
    frame = spark.createDataFrame([("1", None, None, None, None, "x", 0), ("2", "T", None, None, None, None, 1)], POSTING)
    assert [r.text for r in flatten.with_posting_text(frame).orderBy("seq").collect()] == ["", "T"]
    assert [r.id for r in flatten.with_posting_text(frame, drop_failed=True).collect()] == ["2"]


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, 0.2), ("x", 0.2), ("", 0.2), ("-1", 0.0), ("7", 1.0), ("nan", 1.0), ("inf", 1.0), ("-inf", 0.0),
        (" 0.3 ", 0.3), ("0.5d", 0.2), ("1e-1", 0.1), ("0", 0.0), ("0_0.5", 0.5), ("_1", 0.2), ("0x1p3", 0.2),
        (".5", 0.5), ("1.", 1.0), ("\xa00.4\u2003", 0.4), ("+Infinity", 1.0), ("-.25e0", 0.0), (".", 0.2),
    ],
)
def test_weight(spark, text, wanted):
    frame = spark.createDataFrame([(text,)], "w string")
    assert frame.select(V.clamp_weight(F.col("w")).alias("w")).first().w == wanted


def vectors(spark, rows, first="internal_id bigint"):
    return spark.createDataFrame(rows, f"{first}, vec array<double>")


def test_zero_vector_stays_zero(spark):
    got = search.l2_normalize(vectors(spark, [(0, [0.0, 0.0]), (1, [3.0, 4.0])]), "vec").orderBy("internal_id").collect()
    assert [r.vec for r in got] == [[0.0, 0.0], [0.6, 0.8]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=3), min_size=1, max_size=20))
def test_unit_length(spark, rows):
    got = search.l2_normalize(vectors(spark, list(enumerate(rows))), "vec").collect()
    for row in got:
        raw = rows[row.internal_id]
        length = math.sqrt(sum(x * x for x in raw))
        assert math.isclose(math.sqrt(sum(x * x for x in row.vec)), 1.0 if length > 0 else 0.0, abs_tol=1e-9)


def test_blend(spark):
    queries = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "query_id bigint")
    likes = spark.createDataFrame(
        [(0, "x", [0.0, 1.0]), (1, " \n", [0.0, 1.0]), (3, "x", [-1.0, 0.0])],
        "query_id bigint, text string, vec array<double>",
    )
    got = {r.query_id: r.vec for r in search.blend_queries(queries, likes, weight=F.lit(0.5)).collect()}
    assert np.allclose(got[0], [0.5**0.5, 0.5**0.5])
    assert got[1] == [1.0, 0.0] and got[2] == [1.0, 0.0]  # blank or no preference: unchanged
    assert got[3] == [0.0, 0.0]  # opposite vectors cancel out and stay zero


def brute(corpus, query, k):
    scored = [(round(float(np.dot(query, v)), search.SCORE_DECIMALS), i) for i, v in corpus]
    return [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("k", [1, 3, 50, 500])
def test_topk_with_ties_and_short_corpus(spark, k, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(-2, 3, size=(12, 4)).astype(float)
    corpus = [(i, base[i % 12].tolist()) for i in range(90)]  # every vector comes several times
    frame = vectors(spark, corpus).repartition(7)
    queries = [(q, base[q].tolist()) for q in range(5)]
    one = vectors(spark, queries[:1], "query_id bigint")
    got = search.topk(frame, one, k).orderBy("rank").collect()
    assert [(r.internal_id, r.score) for r in got] == brute(corpus, base[0], k)
    monkeypatch.setattr(search, "SMALL_TOP_K", 40)  # larger k take the other way
    assert search.topk(frame, one, k).orderBy("rank").collect() == got
    for limit in (1 << 20, 64):  # the broadcast way and the block way
        many = search.topk_many(frame, vectors(spark, queries, "query_id bigint"), k, broadcast_limit=limit)
        rows = many.orderBy("query_id", "rank").collect()
        for q, vec in queries:
            assert [(r.internal_id, r.score) for r in rows if r.query_id == q] == brute(corpus, np.array(vec), k)


def test_empty_corpus_and_no_queries(spark):
    none, one = vectors(spark, []), vectors(spark, [(0, [1.0, 0.0])], "query_id bigint")
    assert search.topk(none, one, 3).count() == 0
    assert search.topk_many(none, one, 3).count() == 0
    assert search.topk_many(none.union(one), vectors(spark, [], "query_id bigint"), 3).count() == 0


def test_string_ids(spark):
    corpus = vectors(spark, [("b", [1.0]), ("a", [1.0]), ("c", [2.0])], "internal_id string")
    for limit in (1 << 20, 4):
        found = search.topk_many(corpus, vectors(spark, [("q", [1.0])], "query_id string"), 2, broadcast_limit=limit)
        assert [r.internal_id for r in found.orderBy("rank").collect()] == ["c", "a"]


def test_unknown_internal_id_names_itself(spark):
    rows = spark.createDataFrame([(0,), (7,)], "internal_id bigint")
    known = spark.createDataFrame([(0, "x")], "internal_id bigint, job_id string")
    assert sorted(r.job_id for r in search.map_ids(rows, known).collect()) == ["7", "x"]


def hashed(text, dim=64):
    import hashlib
    import re

    out = [0.0] * dim
    for token in re.findall("[a-z0-9]+", text.lower()):
        digest = hashlib.md5(token.encode()).hexdigest()
        out[int(digest[:4], 16) % dim] += 1 if int(digest[4], 16) % 2 == 0 else -1
    length = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / length for x in out]


def test_encoder(spark):
    texts = ["Hello, hello world 42", "", None, "Ünïcode ÄÖ x"] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in search.encode(frame, "t", batch_size=7).collect():
        assert np.allclose(row.vec, hashed(texts[row.i] or ""))


def test_any_encoder_plugs_in(spark):
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    frame = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    got = [r.vec for r in search.encode(frame, "t", lengths).collect()]
    assert np.allclose(got, [[2 / 5**0.5, 1 / 5**0.5], [4 / 17**0.5, 1 / 17**0.5]])


def postings(spark):
    rows = [
        ("a", "data engineer", "x", [("job_summary", "spark sql")], None, None, 0),
        ("b", "nurse", "y", [("job_summary", "care")], None, None, 1),
        ("a", "data engineer two", "x", [("job_summary", "spark sql tuning")], None, None, 2),
        (None, "no id", "z", [], None, None, 3),
        (None, "no id either", "z", [], None, None, 4),
    ]
    return spark.createDataFrame(rows, POSTING)


def test_text_to_match(spark, tmp_path):
    prefix = str(tmp_path / "index")
    meta = matching.vectorize_postings(postings(spark), prefix, "test", ["seq"]).first()
    assert (meta.num_vectors, meta.dim, meta.model_name) == (4, 64, "hashing-64")
    assert meta.created_at.endswith("Z")
    index, _ = vector_store.load_index(spark, prefix)
    assert sorted((r.internal_id, r.job_id) for r in index.collect()) == [(0, "b"), (1, "a"), (2, "2"), (3, "3")]
    query = search.encode(spark.createDataFrame([(0, "spark sql")], "query_id int, text string"), "text")
    assert matching.match(index, query, 2).first().job_id == "a"
    likes = search.encode(spark.createDataFrame([(0, "nurse care")], "query_id int, text string"), "text")
    assert matching.match(index, query, 1, likes, F.lit(1.0)).first().job_id == "b"
    many = matching.match_many(index, query, 2).orderBy("rank").collect()
    assert [r.job_id for r in many][0] == "a" and len(many) == 2


def test_files_to_matches(spark, tmp_path):
    prefix = str(tmp_path / "index")
    matching.vectorize_postings(postings(spark), prefix, "test", ["seq"])
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.tex").write_text("spark sql")
    (tmp_path / "docs" / "two.txt").write_text("nurse care")
    (tmp_path / "likes.txt").write_text("nurse care")
    (tmp_path / "blank.txt").write_text(" \n")

    def best(**options):
        found = matching.match_files(spark, str(tmp_path / "docs"), prefix, 1, **options)
        return {r.query_id.rsplit("/", 1)[1]: r.job_id for r in found.collect()}

    alone = {"one.tex": "a", "two.txt": "b"}
    assert best() == alone
    assert best(preferences=str(tmp_path / "none.txt")) == alone
    assert best(preferences=str(tmp_path / "blank.txt"), weight="1") == alone
    assert best(preferences=str(tmp_path / "likes.txt"), weight="1") == {"one.tex": "b", "two.txt": "b"}
    assert best(preferences=str(tmp_path / "likes.txt"), weight="?") == alone
    with pytest.raises(ValueError):
        best(encoder=search.HashingEncoder(32))


def test_index_needs_both_parts_and_one_model(spark, tmp_path):
    prefix = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        vector_store.load_index(spark, prefix)
    vector_store.save_index(vectors(spark, [(0, [1.0, 2.0])]), prefix, "m", "s")
    _, meta = vector_store.load_index(spark, prefix)
    vector_store.check_model(meta, "m", 2)
    with pytest.raises(ValueError):
        vector_store.check_model(meta, "other", 2)
    with pytest.raises(Exception, match="different sizes"):
        vector_store.index_meta(vectors(spark, [(0, [1.0]), (1, [1.0, 2.0])]), "m", "s").collect()
