"""Registered queries for selection, prompts, replies, paths and upload planning."""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import functions as F

from postweave.functions.text import WHITESPACE
from postweave.operators import documents as docs
from postweave.operators import flatten, generation, manifest
from postweave.plans import fixtures as fx
from postweave.plans import collecting, preparing
from postweave.plans.registry import query, table
from postweave.plans.source_queries import presence_table
from postweave.session import scratch_path
from postweave.sources import file_sink
from postweave.sources.postings import read_documents

OUT_DIR = "/out/personalized"
# The two base templates of the test plans.
BASES = {
    "resume": "\\documentclass{article}\n[JOB_TITLE] at [COMPANY_NAME]\n\\end{document}",
    "cover_letter": "\\documentclass{letter}\nDear [COMPANY_NAME], the [JOB_TITLE] role: [COMPANY_REASON]. "
    "I know [RELEVANT_SKILLS].\n\\end{document}",
}


def _sql(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


_BASE_SQL = f"CASE kind WHEN 'resume' THEN {_sql(BASES['resume'])} ELSE {_sql(BASES['cover_letter'])} END"
_KINDS_SQL = "(VALUES ('resume'), ('cover_letter')) AS k(kind)"


def _base():
    return F.when(F.col("kind") == "resume", BASES["resume"]).otherwise(BASES["cover_letter"])


# ---- look-up -------------------------------------------------------------------------------


def _selection(spark, sf_dir):
    """Selected ids in rank order; some are unknown and some come twice (``vec_id // 2 * 3``)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.expr("cast(vec_id div 2 * 3 as string)").alias("job_id"), F.col("vec_id").alias("rank"))


_SELECTION = "sel AS (SELECT CAST(vec_id // 2 * 3 AS VARCHAR) AS job_id, vec_id AS rank FROM embeddings)"


@query(
    "lookup_inner",
    f"WITH {fx.JOBS_SQL}, {_SELECTION} SELECT job_id, rank, title, company, city FROM sel JOIN jobs ON job_id = id",
)
def lookup_inner(spark, sf_dir):
    selection = docs.selected_ids(_selection(spark, sf_dir))
    found = docs.lookup_selected(selection, fx.jobs(spark, sf_dir), ["seq"])
    return found.select("job_id", "rank", "title", "company", "city")


_MARKED = """sel AS (SELECT CAST(doc_id * 2 AS VARCHAR) AS job_id, doc_id AS rank FROM labels)"""


def _labelled(spark, sf_dir):
    """Labels name the selected postings; the ids beyond the documents are unknown."""
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") * 2).cast("string").alias("job_id"), F.col("doc_id").alias("rank")
    )


_DISPLAY = f"""WITH {fx.JOBS_SQL}, {_MARKED},
shown AS (SELECT job_id, rank, coalesce(nullif(title, ''), d_job_title) AS title,
  coalesce(nullif(company, ''), d_organization) AS company FROM sel LEFT JOIN jobs ON job_id = id)"""


@query("lookup_left", f"{_DISPLAY} SELECT * FROM shown")
def lookup_left(spark, sf_dir):
    return docs.lookup_for_display(_labelled(spark, sf_dir), fx.jobs(spark, sf_dir), ["seq"])


@query(
    "display_defaults",
    f"""WITH {fx.JOBS_SQL} SELECT id, coalesce(nullif(title, ''), '(No title)') AS title,
  coalesce(nullif(company, ''), '(No company)') AS company FROM jobs""",
)
def display_defaults(spark, sf_dir):
    return docs.display_defaults(fx.jobs(spark, sf_dir).select("id", "title", "company"))


@query("application_count", "SELECT COUNT(*) AS applications FROM documents")
def application_count(spark, sf_dir):
    return docs.application_count(fx.jobs(spark, sf_dir))


# ---- prompts and replies -------------------------------------------------------------------

_RECORD_SQL = "to_json({'id': id, 'title': title, 'company': company, 'city': city, 'summary': d_job_summary})"


def _records(jobs):
    rows = jobs.select(
        "id", "title", "company", "city", flatten.detail(F.col("details"), "job_summary").alias("summary")
    )
    return rows.withColumn("record", docs.record_json(["id", "title", "company", "city", "summary"]))


@query("record_json", f"WITH {fx.JOBS_SQL} SELECT id, CAST({_RECORD_SQL} AS VARCHAR) AS record FROM jobs")
def record_json(spark, sf_dir):
    return _records(fx.jobs(spark, sf_dir)).select("id", "record")


def _prompt_sql(record: str) -> str:
    return f"""replace({_sql(docs.PROMPT_HEAD)}, '{{kind}}',
    CASE kind WHEN 'resume' THEN 'resume' ELSE 'cover letter' END) || {record}
  || {_sql(docs.PROMPT_MIDDLE)} || {_BASE_SQL} || {_sql(docs.PROMPT_TAIL)}"""


def _prompts_sql(jobs: str) -> str:
    return f"""WITH {jobs} SELECT id, kind, {_prompt_sql(f"CAST({_RECORD_SQL} AS VARCHAR)")} AS prompt
FROM jobs CROSS JOIN {_KINDS_SQL}"""


@query("build_prompts", _prompts_sql(fx.JOBS_SQL))
def build_prompts(spark, sf_dir):
    prompts = docs.build_prompts(_records(fx.jobs(spark, sf_dir)), F.col("record"), _base())
    return prompts.select("id", "kind", "prompt")


_SHOWN_SQL = """coalesce(nullif(title, ''), d_job_title, '') AS t, coalesce(nullif(company, ''), d_organization, '') AS c,
  'of ' || city AS reason, coalesce(d_required_skills, '') AS skills"""


def _filled_sql(template: str) -> str:
    names = {"[JOB_TITLE]": "t", "[COMPANY_NAME]": "c", "[COMPANY_REASON]": "reason", "[RELEVANT_SKILLS]": "skills"}
    for placeholder, column in names.items():
        template = f"replace({template}, '{placeholder}', {column})"
    return template


def template_generator(prompts: list[str], temperature: float, max_tokens: int) -> list[str]:
    """A model whose replies SQL can give as well: the template in the prompt, filled from the posting in the prompt.

    A last line holds the digest of the whole prompt and the settings, as a comment.
    """
    replies = []
    for prompt in prompts:
        record, reply = prompt.partition("\n\nJob: ")[2].removesuffix(docs.PROMPT_TAIL).split(docs.PROMPT_MIDDLE, 1)
        posting = json.loads(record)
        details = {d["key"]: d["value"] for d in posting["details"]}
        values = {
            "job_title": posting["title"] or details.get("job_title"),
            "company_name": posting["company"] or details.get("organization"),
            "company_reason": f"of {posting['city']}",
            "relevant_skills": details.get("required_skills"),
        }
        for placeholder, name in docs.PLACEHOLDERS.items():
            reply = reply.replace(placeholder, values[name] or "")
        replies.append(f"{reply}\n% {md5(prompt.encode()).hexdigest()} {temperature} {max_tokens}")
    return replies


# The whole posting, as the prompt holds it: of a failed one the message stands in the details.
_PAIRS_SQL = ", ".join(
    f"{{'key': '{k}', 'value': d_{k}}}" for k in ("job_title", "organization", "level", "job_summary", "required_skills", "notes")
)
_WHOLE_RECORD_SQL = f"""CAST(to_json({{{", ".join(f"'{f}': {f}" for f in docs.FLAT_FIELDS)},
  'details': CASE WHEN error IS NULL THEN [{_PAIRS_SQL}] ELSE [{{'key': 'error', 'value': error}}] END,
  'status_tags': CASE WHEN error IS NULL THEN [level, division] END, 'error': error}}) AS VARCHAR)"""


@query(
    "batch_generate",
    f"""WITH {fx.WHOLE_JOBS_SQL}, p AS (
  SELECT id, kind, {_prompt_sql(_WHOLE_RECORD_SQL)} AS prompt, {_SHOWN_SQL} FROM jobs CROSS JOIN {_KINDS_SQL})
SELECT id, kind, {_filled_sql(_BASE_SQL)} || chr(10) || '% ' || md5(prompt) || ' 0 4000' AS reply FROM p""",
)
def batch_generate(spark, sf_dir):
    """The generator runs as a plug on batches of whole prompts, each with the whole posting; its replies are whole too."""
    postings = fx.whole_jobs(spark, sf_dir).withColumn("record", docs.record_json(collecting.POSTING_COLUMNS))
    prompts = docs.build_prompts(postings.select("id", "record"), F.col("record"), _base())
    return docs.generate_replies(prompts, template_generator).select("id", "kind", "reply")


@query(
    "offline_replies",
    f"""WITH {fx.WHOLE_JOBS_SQL}, j AS (SELECT id, kind, {_SHOWN_SQL} FROM jobs CROSS JOIN {_KINDS_SQL})
SELECT id, kind, {_filled_sql(_BASE_SQL)} AS reply FROM j""",
)
def offline_replies(spark, sf_dir):
    """Replies of the offline generator: the base template with its placeholders filled."""
    shown = fx.whole_jobs(spark, sf_dir).select(
        "id",
        flatten.title_or_detail().alias("job_title"),
        flatten.company_or_detail().alias("company_name"),
        F.concat(F.lit("of "), "city").alias("company_reason"),
        flatten.detail(F.col("details"), "required_skills").alias("relevant_skills"),
    )
    prompts = docs.build_prompts(shown, docs.record_json(["id", "job_title", "company_name"]), _base())
    values = {name: F.col(name) for name in docs.PLACEHOLDERS.values()}
    replies = docs.generate_replies(prompts, offline=docs.fill_template(_base(), values))
    return replies.select("id", "kind", "reply")


_REPLY_SQL = """CASE doc_id % 4 WHEN 0 THEN 'Here it is:' || chr(10) || '```latex' || chr(10) || text || chr(10) || '```' || chr(10) || 'ok'
  WHEN 1 THEN 'Sure. \\documentclass{a}' || chr(10) || text || '\\end{document} bye'
  WHEN 2 THEN '  ' || text || chr(10) ELSE '' END"""
_BLOCK_SQL = f"""CASE doc_id % 4 WHEN 1 THEN '\\documentclass{{a}}' || chr(10) || text || '\\end{{document}}'
  WHEN 3 THEN '' ELSE trim(text, '{WHITESPACE}') END"""


def _replies(spark, sf_dir):
    reply = r"""case doc_id % 4 when 0 then concat('Here it is:\n```latex\n', text, '\n```\nok')
      when 1 then concat('Sure. \\documentclass{a}\n', text, '\\end{document} bye')
      when 2 then concat('  ', text, '\n') else '' end"""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(reply).alias("reply"))


@query(
    "extract_block",
    f"""WITH b AS (SELECT doc_id, {_BLOCK_SQL} AS body FROM documents)
SELECT doc_id, body, contains(body, '\\end{{document}}') AS complete FROM b""",
)
def extract_block(spark, sf_dir):
    bodies = _replies(spark, sf_dir).select("doc_id", docs.extract_block(F.col("reply")).alias("body"))
    return bodies.withColumn("complete", docs.is_complete(F.col("body")))


@query(
    "reply_fallback",
    f"""SELECT doc_id, coalesce(nullif({_BLOCK_SQL}, ''), {_sql(BASES['resume'])}) AS body FROM documents""",
)
def reply_fallback(spark, sf_dir):
    body = docs.or_base(docs.extract_block(F.col("reply")), F.lit(BASES["resume"]))
    return _replies(spark, sf_dir).select("doc_id", body.alias("body"))


@query(
    "fill_template",
    """SELECT p_partkey, 'The ' || p_name || ' role at ' || s_name || ' because of ' || p_type || ', ' || p_brand
  || '; ' || s_name || '.' AS letter FROM part JOIN supplier ON p_partkey % (SELECT COUNT(*) FROM supplier) = s_suppkey""",
)
def fill_template(spark, sf_dir):
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    count = suppliers.select(F.count("*").alias("n")).scalar()
    joined = parts.withColumn("s_suppkey", F.col("p_partkey") % count).join(suppliers, "s_suppkey")
    template = F.lit(
        "The [JOB_TITLE] role at [COMPANY_NAME] because of [COMPANY_REASON], [RELEVANT_SKILLS]; [COMPANY_NAME]."
    )
    names = ["p_name", "s_name", "p_type", "p_brand"]
    values = {v: F.col(c) for v, c in zip(docs.PLACEHOLDERS.values(), names)}
    return joined.select("p_partkey", docs.fill_template(template, values).alias("letter"))


# ---- paths ---------------------------------------------------------------------------------


def _paths(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"))
    tex = docs.tex_path(OUT_DIR, F.col("job_id"), F.col("kind"))
    return docs.with_kinds(ids).withColumn("tex", tex).withColumn("pdf", docs.pdf_path(F.col("tex")))


@query(
    "output_paths",
    f"""SELECT CAST(doc_id AS VARCHAR) AS job_id, kind, '{OUT_DIR}/' || doc_id || '_' || kind || '.tex' AS tex,
  '{OUT_DIR}/' || doc_id || '_' || kind || '.pdf' AS pdf FROM documents CROSS JOIN {_KINDS_SQL}""",
)
def output_paths(spark, sf_dir):
    return _paths(spark, sf_dir)


@query(
    "flatten_outputs",
    f"""SELECT CAST(doc_id AS VARCHAR) AS job_id, kind, CAST(n AS BIGINT) AS output_no,
  '{OUT_DIR}/' || doc_id || '_' || kind || CASE n WHEN 0 THEN '.tex' ELSE '.pdf' END AS path
FROM documents CROSS JOIN {_KINDS_SQL} CROSS JOIN (VALUES (0), (1)) AS o(n)""",
)
def flatten_outputs(spark, sf_dir):
    rows = docs.flatten_outputs(_paths(spark, sf_dir), "tex", "pdf")
    return rows.withColumn("output_no", F.col("output_no").cast("bigint"))


@query("suffix_count", "SELECT COUNT(*) AS n FROM pages WHERE ends_with(lower(url), '.html')")
def suffix_count(spark, sf_dir):
    return docs.with_suffix(table(spark, sf_dir, "pages"), "url", ".html").agg(F.count("*").alias("n"))


def _json_sql(text: str) -> str:
    """A JSON string in ASCII."""
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        text = f"replace({text}, {char if char.startswith('chr') else _sql(char)}, {_sql(escape)})"
    return rf"""coalesce('"' || array_to_string(list_transform(regexp_extract_all({text}, '[ -~]+|[^ -~]'),
      lambda c: CASE WHEN regexp_matches(c, '^[ -~]') THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
        ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')
      || '"', 'null')"""


def _members_sql(columns: dict[str, str], depth: int) -> str:
    return " || ',' || chr(10) || ".join(f"""'{" " * depth}"{n}": ' || {_json_sql(c)}""" for n, c in columns.items())


_HEADER = {"job_title": "d_job_title", "organization": "d_organization"}
_DETAILS = {n: f"d_{n}" for n in ("level", "job_summary", "required_skills", "notes")}
# The posting indented by two, as the prompt holds it: status tags follow the header.
_POSTING_SQL = f"""'{{' || chr(10) || {_members_sql({f: f for f in docs.FLAT_FIELDS}, 2)}
  || ',' || chr(10) || '  "details": {{' || chr(10) || CASE WHEN error IS NOT NULL THEN {_members_sql({"error": "error"}, 4)}
  ELSE {_members_sql(_HEADER, 4)} || ',' || chr(10) || '    "status_tags": [' || chr(10) || '      ' || {_json_sql("level")}
    || ',' || chr(10) || '      ' || {_json_sql("division")} || chr(10) || '    ],' || chr(10)
    || {_members_sql(_DETAILS, 4)} END || chr(10) || '  }}' || chr(10) || '}}'"""


@query(
    "prepare_documents",
    f"""WITH {fx.WHOLE_JOBS_SQL}, {_SELECTION},
j AS (SELECT sel.job_id, rank, kind, coalesce(nullif(title, ''), d_job_title, '') AS t,
    coalesce(nullif(company, ''), d_organization, '') AS c, coalesce(d_job_summary, '') AS reason,
    coalesce(d_required_skills, '') AS skills, {_POSTING_SQL} AS posting
  FROM sel JOIN jobs ON job_id = id CROSS JOIN {_KINDS_SQL})
SELECT job_id, rank, kind, {_prompt_sql("posting")} AS prompt, {_filled_sql(_BASE_SQL)} AS body, '{OUT_DIR}/' || job_id || '_' || kind || '.tex' AS path,
  '{OUT_DIR}/' || job_id || '_' || kind || '.pdf' AS pdf FROM j""",
)
def prepare_documents(spark, sf_dir):
    prepared = preparing.prepare_documents(
        _selection(spark, sf_dir), fx.whole_jobs(spark, sf_dir), ["seq"], BASES, OUT_DIR
    )
    return prepared.select("job_id", "rank", "kind", "prompt", "body", "path", "pdf")


# ---- upload planning -----------------------------------------------------------------------


def _manifest(spark, sf_dir):
    present = presence_table(spark, sf_dir).withColumn(
        "path", docs.pdf_path(docs.tex_path(OUT_DIR, F.col("job_id"), F.col("kind")))
    )
    postings = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), "doc_id")
    return manifest.upload_manifest(postings, present)


_MANIFEST = f"""WITH m AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS job_id,
    CASE WHEN quality = 1 THEN '{OUT_DIR}/' || d.doc_id || '_resume.pdf' END AS resume_path,
    CASE WHEN toxic = 0 THEN '{OUT_DIR}/' || d.doc_id || '_cover_letter.pdf' END AS cover_path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("upload_manifest", f"{_MANIFEST} SELECT job_id, resume_path, cover_path FROM m")
def upload_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).select("job_id", "resume_path", "cover_path")


@query(
    "document_names",
    """SELECT doc_id, 'Resume + ' || doc_id AS resume_name, 'Cover letter + ' || doc_id AS cover_name FROM documents""",
)
def document_names(spark, sf_dir):
    names = manifest.document_names(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in names.items()])


@query(
    "upload_actions",
    f"""{_MANIFEST}
SELECT job_id, CASE WHEN doc_id % 10 = 0 THEN 'cancel' ELSE 'submit' END AS application,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 1 THEN 'none' WHEN resume_path IS NOT NULL THEN 'upload' ELSE 'skip' END
    AS resume_action,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 3 = 1 THEN 'none' WHEN cover_path IS NOT NULL THEN 'upload' ELSE 'skip' END
    AS cover_action FROM m""",
)
def upload_actions(spark, sf_dir):
    offered = _manifest(spark, sf_dir).withColumns(
        {
            "prescreening": F.col("doc_id") % 10 == 0,
            "resume_slot": F.col("doc_id") % 7 != 1,
            "cover_slot": F.col("doc_id") % 3 != 1,
        }
    )
    return manifest.upload_actions(offered).select("job_id", "application", "resume_action", "cover_action")


@query(
    "plan_uploads",
    f"""WITH m AS (
  SELECT d.doc_id, d.doc_id % 10 = 0 AS pre, d.doc_id % 7 <> 1 AS first, d.doc_id % 3 <> 1 AS second,
    CASE WHEN quality = 1 THEN d.doc_id || '_resume.tex' END AS resume_file,
    CASE WHEN toxic = 0 THEN d.doc_id || '_cover_letter.tex' END AS cover_file
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS job_id, resume_file, cover_file, 'Resume + ' || doc_id AS resume_name,
  'Cover letter + ' || doc_id AS cover_name, CASE WHEN pre THEN 'cancel' ELSE 'submit' END AS application,
  CASE WHEN pre OR NOT first THEN 'none' WHEN resume_file IS NOT NULL THEN 'upload' ELSE 'skip' END AS resume_action,
  CASE WHEN pre OR NOT second THEN 'none' WHEN cover_file IS NOT NULL THEN 'upload' ELSE 'skip' END AS cover_action
FROM m""",
)
def plan_uploads(spark, sf_dir):
    """Documents written to files, then the plan for every posting from the files that exist."""
    root = scratch_path(spark, "uploads")
    present = presence_table(spark, sf_dir).select("job_id", "kind", F.col("job_id").alias("body"))
    preparing.write_documents(present, root)
    postings = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        (F.col("doc_id") % 10 == 0).alias("prescreening"),
        (F.col("doc_id") % 7 != 1).alias("resume_slot"),
        (F.col("doc_id") % 3 != 1).alias("cover_slot"),
    )
    planned = preparing.plan_uploads(spark, postings, root, ".tex")
    file = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return planned.select(
        "job_id", file("resume_path").alias("resume_file"), file("cover_path").alias("cover_file"),
        "resume_name", "cover_name", "application", "resume_action", "cover_action",
    )


# ---- generation that goes on, files as versions -------------------------------------------------


def _moody(refused: int):
    """A generator that measures its prompts and refuses those of every ``refused``-th posting (remainder 7)."""

    def generate(prompts: list[str], temperature: float, max_tokens: int) -> list[str]:
        import re

        if any(int(re.match(r"Job (\d+)", p)[1]) % refused == 7 for p in prompts):
            raise ValueError("refused")
        return [f"{len(p)} characters" for p in prompts]

    return generate


@query(
    "saved_generation",
    f"""WITH {fx.JOBS_SQL} SELECT id, CASE WHEN seq % 100 <> 7 THEN length('Job ' || id || chr(10) || coalesce(d_job_summary, '')) || ' characters' END AS reply,
  CASE WHEN seq % 100 = 7 THEN 'ValueError: refused' END AS error FROM jobs""",
)
def saved_generation(spark, sf_dir):
    """One prompt in fifty fails; the second run asks for those only, and half of them come."""
    store = scratch_path(spark, "replies")
    jobs = fx.jobs(spark, sf_dir)
    summary = F.coalesce(flatten.detail(F.col("details"), "job_summary"), F.lit(""))
    prompts = jobs.select("id", F.concat(F.lit("Job "), "id", F.lit("\n"), summary).alias("prompt"))
    generation.generate_saved(prompts, store, _moody(50), "test")
    return generation.generate_saved(prompts, store, _moody(100), "test").select("id", "reply", "error")


@query(
    "sink_versions",
    f"""WITH {fx.JOBS_SQL} SELECT id || '.tex' AS name,
  CASE WHEN seq % 3 = 0 THEN 'second ' ELSE 'first ' END || level || chr(10) || coalesce(d_job_summary, '') AS body FROM jobs""",
)
def sink_versions(spark, sf_dir):
    """Files of two versions: the second writes a third of the names again."""
    root = scratch_path(spark, "versions")
    jobs = fx.jobs(spark, sf_dir)
    text = F.concat("level", F.lit("\n"), F.coalesce(flatten.detail(F.col("details"), "job_summary"), F.lit("")))
    files = jobs.select("seq", F.concat("id", F.lit(".tex")).alias("name"), text.alias("text"))
    file_sink.write_version(files.select("name", F.concat(F.lit("first "), "text").alias("body")), root)
    again = files.filter("seq % 3 = 0").select("name", F.concat(F.lit("second "), "text").alias("body"))
    found = file_sink.write_version(again, root)
    return read_documents(spark, root, wanted=found.select("path")).join(found, "path").select("name", F.col("text").alias("body"))
