import json

import pytest
from pyspark.sql import functions as F

from postweave.operators import documents as D
from postweave.operators import manifest, relay
from postweave.plans import preparing
from postweave.sources import generated, postings

DETAILS = {"job_title": "Role", "status_tags": ["x", "y"], "job_summary": 'a "quoted"\nline', "n": ""}
JOBS = [
    {"id": "1", "title": "T", "company": None, "details": DETAILS},
    {"id": "2", "title": "é", "details": {"error": "Timeout"}},
    {"id": 3, "details": None},
    {"title": "no id", "city": "C"},
]


def as_tuple(row):
    details = None if row.details is None else [(p.key, p.value) for p in row.details]
    return row.id, row.title, details, row.status_tags, row.error


WANTED = [
    (None, "no id", None, None, None),
    ("1", "T", [("job_title", "Role"), ("job_summary", 'a "quoted"\nline'), ("n", "")], ["x", "y"], None),
    ("2", "é", [("error", "Timeout")], None, "Timeout"),
    ("3", None, None, None, None),
]


def by_id(frame):
    return sorted((as_tuple(r) for r in frame.collect()), key=lambda t: str(t[0] or ""))


def test_jobs_file(spark, tmp_path):
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps(JOBS, indent=4, ensure_ascii=False), encoding="utf-8")
    assert by_id(postings.read_jobs_json(spark, str(path))) == WANTED


def test_jobs_lines_and_back(spark, tmp_path):
    path, again = tmp_path / "jobs.json", str(tmp_path / "again")
    path.write_text("\n".join(json.dumps(j) for j in JOBS), encoding="utf-8")
    frame = postings.read_jobs_json(spark, str(path), layout="lines")
    assert by_id(frame) == WANTED
    postings.write_snapshot(frame, again, "json")
    postings.write_snapshot(frame, again, "json")
    assert by_id(postings.read_jobs_json(spark, again, layout="lines")) == WANTED


def test_empty_list(spark, tmp_path):
    path = tmp_path / "jobs.json"
    path.write_text(" []")
    assert postings.read_jobs_json(spark, str(path)).count() == 0


@pytest.mark.parametrize("content", ['{"id": "1"}', '"x"', "[1, 2", "oops"])
def test_anything_but_a_list_is_an_error(spark, tmp_path, content):
    path = tmp_path / "jobs.json"
    path.write_text(content)
    with pytest.raises(Exception, match="JSON list"):
        postings.read_jobs_json(spark, str(path)).collect()


def test_missing_jobs_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        postings.read_jobs_json(spark, str(tmp_path / "none.json")).collect()


def test_resume(spark, tmp_path):
    path = tmp_path / "jobs.json"
    assert postings.resume_state(spark, str(path)).count() == 0
    path.write_text("\n".join(json.dumps(j) for j in JOBS))
    assert postings.resume_state(spark, str(path)).count() == 4
    path.write_text('{"id": "1"}\n{"id": ')
    assert postings.resume_state(spark, str(path)).count() == 0


def test_lenient_documents(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"caf\xc3\xa9 \xff\xfe ok\n")
    (tmp_path / "b.txt").write_bytes("kept �".encode())
    (tmp_path / "c.txt").write_bytes("kept � but ".encode() + b"\xff")
    texts = {r.path.rsplit("/", 1)[1]: (r.path, r.text) for r in postings.read_documents(spark, str(tmp_path)).collect()}
    assert texts["a.tex"][1] == b"caf\xc3\xa9 \xff\xfe ok\n".decode("utf-8", "ignore")
    assert (texts["b.txt"][1], texts["c.txt"][1]) == ("kept �", "kept � but ")
    known = texts["a.tex"][0]
    wanted = spark.createDataFrame([(known,), ("file:/none",)], "path string")
    lenient = postings.read_documents(spark, str(tmp_path), wanted, missing_ok=True).collect()
    assert {r.path: r.text for r in lenient}["file:/none"] == ""
    (tmp_path / "empty.txt").write_bytes(b"")
    asked = spark.createDataFrame([(str(tmp_path / "empty.txt"),), (known,)], "path string")
    read = {r.path: r.text for r in postings.read_documents(spark, str(tmp_path), asked).collect()}
    assert read == {str(tmp_path / "empty.txt"): "", known: texts["a.tex"][1]}
    with pytest.raises(Exception, match="file not found: file:/none"):
        postings.read_documents(spark, str(tmp_path), wanted).collect()


def test_generated_files(spark, tmp_path):
    root = str(tmp_path / "out")
    assert generated.list_generated(spark, root).count() == 0
    docs = spark.createDataFrame(
        [("a_b", "resume", "x\n\n"), ("a_b", "cover_letter", "é"), ("2", "resume", "")], "job_id string, kind string, body string"
    )
    for _ in range(2):  # writing again replaces
        written = generated.write_generated(docs, root)
    assert (tmp_path / "out" / "a_b_resume.tex").read_bytes() == b"x\n\n"
    keys = [("2", "resume"), ("a_b", "cover_letter"), ("a_b", "resume")]
    assert sorted((r.job_id, r.kind) for r in written.collect()) == keys
    listed = sorted((r.job_id, r.kind) for r in generated.list_generated(spark, root).collect())
    assert listed == keys[1:]  # the empty file is written, but file sources do not list it
    more = spark.createDataFrame([("3", "resume", "y")], "job_id string, kind string, body string")
    assert generated.write_generated(more, root).count() == 4  # the table holds all files
    (tmp_path / "out" / "notes.tex").write_text("x")
    assert generated.list_generated(spark, root).count() == 3
    asked = spark.createDataFrame([("a_b",), ("2",), ("2",), ("nine",), (None,), ("../x",)], "job_id string")
    present = sorted((r.job_id, r.kind, r.path) for r in generated.present_generated(asked, root).collect())
    assert present == [(j, k, f"{root}/{j}_{k}.tex") for j, k in keys]
    assert generated.present_generated(asked, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("job_id", ["../up", "a/b", None])
def test_names_stay_in_the_folder(spark, tmp_path, job_id):
    docs = spark.createDataFrame([(job_id, "resume", "x")], "job_id string, kind string, body string")
    with pytest.raises(Exception, match="not a file name"):
        generated.write_generated(docs, str(tmp_path / "out"))


DOC = "\\documentclass{a}\nx\n\\end{document}"


@pytest.mark.parametrize(
    "reply, wanted",
    [
        (f"Here:\n```latex\n{DOC}\n```\nbye", DOC),
        (f"```tex\n{DOC}\n```", DOC),
        (f"```\n{DOC}\n```", DOC),
        ("```latex\n\n```", ""),
        ("```latex\na\n```\n```latex\nb\n```", "a"),
        (f"Sure {DOC} and more \\end{{document}}", DOC),
        ("\\documentclass{a}\ncut", "\\documentclass{a}\ncut"),
        ("  plain \n", "plain"),
        ("", ""),
        (None, ""),
        (f"```python\n{DOC}\n```", DOC),
    ],
)
def test_extract_block(spark, reply, wanted):
    frame = spark.createDataFrame([(reply,)], "r string")
    row = frame.select(D.extract_block(F.col("r")).alias("b"), D.is_complete(D.extract_block(F.col("r"))).alias("c")).first()
    assert row.b == wanted
    assert row.c == ("\\end{document}" in wanted)
    assert frame.select(D.or_base(D.extract_block(F.col("r")), F.lit("base")).alias("b")).first().b == (wanted or "base")


@pytest.mark.parametrize(
    "path, wanted",
    [("/o/1_resume.tex", "/o/1_resume.pdf"), ("/o.d/x", "/o.d/x.pdf"), ("a..tex", "a..pdf"), ("/o/.tex", "/o/.tex.pdf")],
)
def test_pdf_path(spark, path, wanted):
    assert spark.createDataFrame([(path,)], "p string").select(D.pdf_path(F.col("p")).alias("p")).first().p == wanted


def test_suffix_any_case(spark):
    paths = spark.createDataFrame([("a.PDF",), ("b.tex",), ("c.pdf",)], "p string")
    assert D.with_suffix(paths, "p").count() == 2


POSTINGS = "id string, title string, company string, details array<struct<key:string,value:string>>, seq int"


def lookup_rows(spark):
    return spark.createDataFrame(
        [("1", "old", "c", [], 0), ("1", "new", "c", [], 1), ("2", "", None, [("job_title", "J"), ("organization", "O")], 2)],
        POSTINGS,
    )


def test_lookups(spark):
    chosen = spark.createDataFrame([("2", 1), ("9", 2), ("1", 3), ("2", 4)], "job_id string, rank int")
    inner = D.lookup_selected(chosen, lookup_rows(spark), ["seq"]).orderBy("rank")
    assert [(r.job_id, r.rank, r.title) for r in inner.collect()] == [("2", 1, ""), ("1", 3, "new"), ("2", 4, "")]
    left = D.display_defaults(D.lookup_for_display(chosen, lookup_rows(spark), ["seq"])).orderBy("rank")
    assert [(r.job_id, r.title, r.company) for r in left.collect()] == [
        ("2", "J", "O"), ("9", "(No title)", "(No company)"), ("1", "new", "c"), ("2", "J", "O"),
    ]


def test_record_json_loads(spark):
    frame = spark.createDataFrame([("é \"q\"\n", None)], "a string, b string")
    text = frame.select(D.record_json(["a", "b"]).alias("j")).first().j
    assert text == '{"a":"é \\"q\\"\\n","b":null}'


@pytest.mark.parametrize(
    "details",
    [
        {"job_title": "é \"q\"\\ \n\t\x01\x7f😀", "organization": "O", "division": "D", "status_tags": ["a", "ü"], "x": "y"},
        {"job_title": "J", "status_tags": [], "x": ""},
        {"status_tags": ["t"], "division": "D"},
        {"error": "Timeout"},
        {},
        None,
    ],
)
def test_posting_json_is_what_json_dumps_writes(spark, tmp_path, details):
    posting = {f: f"<{f}> é" for f in D.FLAT_FIELDS} | {"title": None, "details": details}
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps([posting]))
    frame = postings.read_jobs_json(spark, str(path))
    assert frame.select(D.posting_json().alias("j")).first().j == json.dumps(posting, indent=2)


def test_prompts_and_generator(spark):
    frame = spark.createDataFrame([("1", "{}")], "id string, record string")
    prompts = D.build_prompts(frame, F.col("record"), F.lit("BASE"))
    texts = {r.kind: r.prompt for r in prompts.collect()}
    assert texts["cover_letter"].startswith("Generate a complete LaTeX cover letter for this job.")
    assert "\n\nJob: {}\n\nBase template (" in texts["resume"] and ":\nBASE\n\nReturn ONLY" in texts["resume"]
    sizes = []

    def shout(batch, temperature, max_tokens):
        sizes.append(len(batch))
        return [f"{len(batch)} {p[:8].upper()} {temperature} {max_tokens}" for p in batch]

    replies = D.generate_replies(prompts.repartition(1), shout, batch_size=1)
    assert [r.reply for r in replies.collect()] == ["1 GENERATE 0 4000"] * 2


def test_fill_template_without_a_value(spark):
    names = list(D.PLACEHOLDERS.values())
    row = spark.range(1).select(
        D.fill_template(
            F.lit("[JOB_TITLE]/[COMPANY_NAME]/[JOB_TITLE]"),
            {n: F.lit("x" if n == "job_title" else None).cast("string") for n in names},
        ).alias("t")
    )
    assert row.first().t == "x//x"


def test_selection_to_uploads(spark, tmp_path):
    out, seen = str(tmp_path / "out"), []
    bases = {"resume": "RB", "cover_letter": "CB"}
    chosen = spark.createDataFrame([("2", 1), ("9", 2), ("1", 3), ("2", 4)], "job_id string, rank int")
    flat = [F.lit("x").alias(f) for f in ("division", "openings", "city", "level", "deadline")]
    rows = lookup_rows(spark).select("*", *flat, F.array(F.lit("tag")).alias("status_tags"))

    def reply(batch, temperature, max_tokens):
        return [f"```latex\n{DOC}\n```" if "resume" in p else " " for p in batch]

    prepared = preparing.prepare_documents(chosen, rows, ["seq"], bases, out, reply)
    got = sorted((r.rank, r.job_id, r.kind, r.body) for r in prepared.collect())
    assert got == [(n, j, k, DOC if k == "resume" else "CB") for n, j in ((1, "2"), (3, "1"), (4, "2")) for k in sorted(bases)]
    assert preparing.write_documents(prepared, out).count() == 4
    assert (tmp_path / "out" / "1_cover_letter.tex").read_text() == "CB"
    asked = spark.createDataFrame([("1", False, True, True), ("9", False, True, True)],
                                  "job_id string, prescreening boolean, resume_slot boolean, cover_slot boolean")
    plans = {r.job_id: r for r in preparing.plan_uploads(spark, asked, out, ".tex").collect()}
    assert (plans["1"].resume_action, plans["9"].cover_action) == ("upload", "skip")
    assert plans["1"].resume_path.endswith("/1_resume.tex") and plans["1"].cover_name == "Cover letter + 1"
    assert preparing.plan_uploads(spark, asked, None).filter("resume_action = 'upload'").count() == 0


def test_requests(spark):
    rows = spark.createDataFrame(
        [("groq", "q", None, None, 0.1, True, False), ("databricks", "q", "s", "m", 0.1, True, False), ("other", "q", "", "m", 0.1, True, True)],
        "provider string, prompt string, system string, model string, temperature double, has_key boolean, has_host boolean",
    )
    got = {r.provider: r for r in relay.build_requests(rows, "h").collect()}
    assert json.loads(got["groq"].payload)["model"] == "llama-3.1-8b-instant" and got["groq"].error is None
    assert got["databricks"].payload is None and got["databricks"].url is None and got["databricks"].error
    assert got["other"].payload is None and got["other"].error is None


def test_manifest_and_actions(spark):
    rows = spark.createDataFrame([("1",), ("1",), ("2",)], "job_id string")
    present = spark.createDataFrame([("1", "resume", "r"), ("2", "cover_letter", "c")], "job_id string, kind string, path string")
    got = sorted(tuple(map(str, r)) for r in manifest.upload_manifest(rows, present).collect())
    assert got == [("1", "r", "None")] * 2 + [("2", "None", "c")]
    assert manifest.no_directory(rows).filter("resume_path is null and cover_path is null").count() == 3
    plan = spark.createDataFrame(
        [(True, True, True, "r", "c"), (False, True, True, "r", None), (False, False, True, "r", "c")],
        "prescreening boolean, resume_slot boolean, cover_slot boolean, resume_path string, cover_path string",
    )
    acts = [(r.application, r.resume_action, r.cover_action) for r in manifest.upload_actions(plan).collect()]
    assert acts == [("cancel", "none", "none"), ("submit", "upload", "skip"), ("submit", "none", "upload")]


# ---- provider requests and replies ---------------------------------------------------------


def value(spark, column, **fields):
    schema = ", ".join(f"{k} string" for k in fields)
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "provider, model, wanted",
    [
        ("groq", None, "llama-3.1-8b-instant"), ("groq", "", "llama-3.1-8b-instant"), ("groq", "m", "m"),
        ("cohere", None, "own"), ("other", None, None), ("vapi", None, "default"),
    ],
)
def test_model(spark, provider, model, wanted):
    column = lambda: relay.resolve_model(F.col("p"), F.col("m"), {"cohere": "own"})
    assert value(spark, column(), p=provider, m=model) == wanted


@pytest.mark.parametrize(
    "provider, key, host, ok",
    [("groq", True, False, True), ("groq", False, True, False), ("databricks", True, False, False),
     ("databricks", True, True, True), ("other", False, False, True)],
)
def test_credentials(spark, provider, key, host, ok):
    message = value(spark, relay.credential_error(F.col("p"), F.lit(key), F.lit(host)), p=provider)
    assert (message is None) == ok


@pytest.mark.parametrize("system, roles", [(None, ["user"]), ("", ["user"]), ("s", ["system", "user"])])
def test_messages_and_prefix(spark, system, roles):
    got = value(spark, relay.chat_messages(F.col("s"), F.col("p")), s=system, p="")
    assert [m.role for m in got] == roles and got[-1].content == ""
    prefixed = value(spark, relay.prefix_system(F.col("s"), F.col("p")), s=system, p="q")
    assert prefixed == ("[system]: s\n\nq" if system else "q")


@pytest.mark.parametrize(
    "provider, keys",
    [("groq", ["model", "messages", "temperature", "stream"]), ("cohere", ["model", "message", "temperature"]),
     ("vapi", ["input", "model", "temperature"]), ("other", None)],
)
def test_payload(spark, provider, keys):
    payload = relay.request_payload(F.col("p"), F.lit("m"), F.lit(""), F.lit("q"), F.lit(0.2))
    text = value(spark, payload, p=provider)
    assert (list(json.loads(text)) if text else None) == keys


@pytest.mark.parametrize(
    "provider, base, wanted",
    [
        ("groq", None, "https://api.groq.com/openai/v1/chat/completions"),
        ("groq", "http://x/y//", "http://x/y/chat/completions"),
        ("cohere", "http://x/", "http://x/"),
        ("databricks", None, "https://h/api/2.0/ai/chat/completions"),
        ("vapi", None, "https://api.vapi.ai/v1/messages"),
        ("other", None, None),
    ],
)
def test_url(spark, provider, base, wanted):
    assert value(spark, relay.request_url(F.col("p"), F.lit("h"), F.col("b")), p=provider, b=base) == wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ('{"choices":[{"message":{"content":"x"}}]}', "x"), ("{}", None), ('{"choices":[]}', None),
        ('{"choices":null}', None), ('{"choices":[{"message":{"content":null}}]}', None), ("broken", None),
    ],
)
def test_reply_chat(spark, raw, wanted):
    assert value(spark, relay.reply_chat(F.col("r")), r=raw) == wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ('{"text":"a","output_text":"b"}', "a"), ('{"text":"","output_text":"b"}', "b"),
        ('{"text":"","generations":[{"text":"g"}]}', "g"), ('{"output_text":"","generations":[{"text":"g"}]}', ""),
        ('{"output_text":null,"generations":[{"text":"g"}]}', "g"), ('{"generations":[]}', None), ("{}", None),
    ],
)
def test_reply_text_chain(spark, raw, wanted):
    assert value(spark, relay.reply_text_chain(F.col("r")), r=raw) == wanted


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ('{"text":"a","output":"b"}', "a"), ('{"text":"","output":"b"}', "b"), ('{"output":"","message":"m"}', "m"),
        ('{"message":{"content":"x"}}', '{"content":"x"}'), ('{"text":"","message":""}', ""), ("{}", None),
    ],
)
def test_reply_output_chain(spark, raw, wanted):
    assert value(spark, relay.reply_output_chain(F.col("r")), r=raw) == wanted


def test_routing_and_output(spark):
    rows = spark.createDataFrame(
        [("groq", '{"choices":[{"message":{"content":"x"}}]}', None), ("other", "{}", None), ("vapi", "{}", "Missing"),
         ("vapi", "{}", None)],
        "provider string, raw string, error string",
    )
    routed = relay.route_replies(rows)
    assert [(r.code, r.output_text) for r in routed.collect()] == [(0, "x"), (2, None), (1, None), (0, None)]
    whole = relay.result_json(F.col("provider"), F.lit("m"), F.col("output_text"), F.col("raw"))
    shown = routed.select(
        whole.alias("w"), relay.select_output(F.lit(False), whole, F.col("output_text")).alias("t")
    ).collect()
    assert json.loads(shown[0].w) == {
        "provider": "groq", "model": "m", "output_text": "x", "raw": {"choices": [{"message": {"content": "x"}}]},
    }
    assert json.loads(shown[3].w)["output_text"] is None and shown[3].t == ""


def test_failure_message(spark):
    rows = spark.createDataFrame(
        [(404, "u", "b", None), (200, "u", "b", None), (None, "u", None, "timed out")],
        "code int, url string, body string, reason string",
    )
    got = rows.select(relay.failure_message(F.col("code"), F.col("url"), F.col("body"), F.col("reason")).alias("m"))
    assert [r.m for r in got.collect()] == ["HTTP 404 calling u: b", None, "Network error calling u: timed out"]
