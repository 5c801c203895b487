"""Saved generation, versioned files, list files in ranges and resuming from broken input."""

import io
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postweave.operators import generation
from postweave.sources import file_sink, json_lists, postings, versions


def asked_in(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def failing_generator(folder, bad):
    """Writes down every prompt that it is asked alone or together; fails for some."""

    def generate(prompts, temperature, max_tokens):
        import os
        import uuid

        for p in prompts:
            with open(os.path.join(str(folder), uuid.uuid4().hex), "w") as out:
                out.write(p)
        if any(p in bad for p in prompts):
            raise ConnectionError("away")
        return [p.upper() for p in prompts]

    return generate


def test_a_second_run_asks_only_for_what_failed(spark, tmp_path):
    store, first, second = (tmp_path / n for n in ("store", "first", "second"))
    first.mkdir(), second.mkdir()
    texts = [f"p{i}" for i in range(100)] + ["p1"] * 30 + [None]
    prompts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "reply_to long, prompt string").repartition(3)
    found = generation.generate_saved(prompts, str(store), failing_generator(first, {"p7", "p57"}), "m", saved_together=10)
    rows = {(r["prompt"], r["reply"], r["error"]) for r in found.collect()}
    assert len(rows) == 101 and ("p7", None, "ConnectionError: away") in rows and ("p1", "P1", None) in rows and (None, None, "no prompt") in rows
    assert found.count() == len(texts) and set(asked_in(first)) == {f"p{i}" for i in range(100)}
    found = generation.generate_saved(prompts, str(store), failing_generator(second, {"p57"}), "m")
    assert {r["prompt"] for r in found.filter("error is not null").collect()} == {"p57", None}
    assert set(asked_in(second)) == {"p7", "p57"}
    third = tmp_path / "third"
    third.mkdir()
    generation.generate_saved(prompts, str(store), failing_generator(third, {"p57"}), "m")
    assert set(asked_in(third)) == {"p57"}
    assert [r["failures"] for r in generation.quarantined(spark, str(store)).collect()] == [3]
    generation.generate_saved(prompts, str(store), failing_generator(third, set()), "m")
    assert set(asked_in(third)) == {"p57"} and len(asked_in(third)) <= 3  # set aside
    generation.generate_saved(prompts.limit(1).filter("prompt is not null"), str(store), failing_generator(first, set()), "other model")
    assert len(asked_in(third)) <= 3


def test_replies_of_a_job_that_ended_midway_stay(spark, tmp_path):
    store = str(tmp_path / "store")
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string").coalesce(1)

    def dies(texts, temperature, max_tokens):
        if "p30" in texts:
            raise SystemExit  # no Exception: the task itself fails
        return [t.upper() for t in texts]

    with pytest.raises(Exception):
        generation.generate_saved(prompts, store, dies, "m", batch_size=4, saved_together=4)
    kept = generation.saved_replies(spark, store).count()
    assert kept >= 4
    seen = tmp_path / "seen"
    seen.mkdir()
    generation.generate_saved(prompts, store, failing_generator(seen, set()), "m")
    assert len(asked_in(seen)) == 40 - kept and generation.saved_replies(spark, store).filter("reply is not null").count() == 40


def test_no_prompts(spark, tmp_path):
    none = spark.createDataFrame([], "prompt string")
    assert generation.generate_saved(none, str(tmp_path / "s"), failing_generator(tmp_path, set()), "m").collect() == []


def files_of(spark, root):
    return {r["name"]: open(r["path"]).read() for r in file_sink.read_version(spark, root).collect()}


def test_versions_of_files(spark, tmp_path):
    root = str(tmp_path / "out")
    made = lambda rows: spark.createDataFrame(rows, "name string, body string, path string")
    file_sink.write_version(made([("a", "1", "x"), ("b", None, "x"), ("c", "3", "x")]).repartition(3), root)
    file_sink.write_version(made([("b", "new", "x")]), root)
    assert files_of(spark, root) == {"a": "1", "b": "new", "c": "3"}
    file_sink.write_version(made([("d", "only", "x")]), root, mode="overwrite")
    assert files_of(spark, root) == {"d": "only"}
    assert file_sink.write_version(made([]), root).count() == 1 and file_sink.read_version(spark, str(tmp_path / "none")).count() == 0


def test_a_job_that_fails_publishes_nothing_and_leaves_nothing(spark, tmp_path):
    root = tmp_path / "out"
    file_sink.write_version(spark.createDataFrame([("a", "1")], "name string, body string"), str(root))
    before = versions.latest(str(root)), sorted(p.name for p in root.iterdir())
    bad = spark.createDataFrame([(f"n{i}", "x") for i in range(20)] + [("../out", "x")], "name string, body string").repartition(4)
    with pytest.raises(Exception):
        file_sink.write_version(bad, str(root))
    assert (versions.latest(str(root)), sorted(p.name for p in root.iterdir())) == before and files_of(spark, str(root)) == {"a": "1"}


PARTS = ['[{"', "\\", '"', "}]", "{", "}", "[", "]", ",", "\n", "é", "a", '\\"', " "]


def some_value(draw, depth=0):
    kind = draw.random()
    if kind < 0.5 or depth > 2:
        return "".join(draw.choice(PARTS) for _ in range(draw.randrange(9)))
    if kind < 0.7:
        return [some_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {some_value(draw, 9): some_value(draw, depth + 1) for _ in range(draw.randrange(4))}


def objects_by_range(data, step):
    cuts, state, found = [*range(0, len(data), step), len(data)], json_lists.State(), []
    first = json_lists.first_byte(io.BytesIO(data), len(data))
    for start, stop in zip(cuts, cuts[1:]):
        found += [json.loads(x) for x in json_lists.objects(io.BytesIO(data), start, stop, len(data), state, first)]
        end = json_lists.summary(io.BytesIO(data), start, stop)[json_lists.STARTS.index(json_lists.State(state.inside, state.escaped))]
        state = json_lists.State(end.inside, end.escaped, state.depth + end.depth)
    return found, state


def test_lists_cut_anywhere(monkeypatch):
    draw = random.Random(3)
    for _ in range(800):
        monkeypatch.setattr(json_lists, "_BLOCK", draw.choice([1, 2, 3, 7, 50, 1000]))
        items = [{some_value(draw, 9): some_value(draw) for _ in range(draw.randrange(4))} for _ in range(draw.randrange(7))]
        data = json.dumps(items, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5).encode()
        data = b" \n" + data + b"\n" if draw.random() < 0.3 else data
        assert objects_by_range(data, draw.choice([1, 2, 3, 5, 11, 64])) == (items, json_lists.State())


@pytest.mark.parametrize("text", ["", "[{}][{}]", "[1]", '["a"]', "[{},[{}]]", "{}", "[{}]x", "x[{}]", "[{}] {}", "[null]", '[{"a": "b}]', "[{}"])
def test_files_that_are_no_list_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON list"):
        postings.read_jobs_json(spark, str(tmp_path / "a.json"), layout="ranges", range_bytes=3).collect()


def test_ranges_give_the_rows_of_the_array_layout(spark, tmp_path):
    draw = random.Random(4)
    for name in ("a.json", "b.json"):
        jobs = [{"id": str(i), "title": some_value(draw, 9), "details": {"job_summary": some_value(draw, 9), "x": [1, {"y": "]}"}]}} for i in range(200)]
        (tmp_path / name).write_text(json.dumps(jobs))
    plain = lambda df: Counter(str(r) for r in df.collect())
    ranged = postings.read_jobs_json(spark, str(tmp_path), layout="ranges", range_bytes=700)
    assert plain(ranged) == plain(postings.read_jobs_json(spark, str(tmp_path))) and ranged.count() == 400
    assert ranged.rdd.getNumPartitions() > 20
    with pytest.raises(FileNotFoundError):
        postings.read_jobs_json(spark, str(tmp_path / "none"), layout="ranges")
    (tmp_path / "c.json").write_text('[{"id": tru}]')
    with pytest.raises(Exception, match="JSON list"):
        postings.read_jobs_json(spark, str(tmp_path / "c.json"), layout="ranges").collect()


def test_one_broken_line_of_a_thousand(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "details": {"job_title": f"t{i}"}}) for i in range(1000)]
    lines[500] = lines[500][:-3]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "list.json").write_text(json.dumps([{"id": "l1"}, {"id": "l2", "details": {"error": "x"}}], indent=2))
    (tmp_path / "broken list.json").write_text('[\n{"id": "b1"},\n{"id": "b2"')
    state, rejects = postings.resume_with_rejects(spark, str(tmp_path))
    ids = {r["id"] for r in state.collect()}
    assert len(ids) == 1001 and {"l1", "l2"} <= ids and "500" not in ids and not any(i.startswith("b") for i in ids)
    found = {r["path"].rsplit("/", 1)[1]: r["line"] for r in rejects.collect()}
    assert found == {"lines.json": lines[500], "broken%20list.json": None}
    state, rejects = postings.resume_with_rejects(spark, str(tmp_path / "none"))
    assert state.count() == rejects.count() == 0


def test_clean_lines_have_no_rejects(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit('{"id": "'), "id", F.lit('"}')).alias("value"))
    rows.write.text(str(tmp_path / "lines"))
    state, rejects = postings.resume_with_rejects(spark, str(tmp_path / "lines"))
    assert state.count() == 50 and rejects.count() == 0
