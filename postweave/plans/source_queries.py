"""Registered queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import lambda_sql
from postweave.operators import collect, documents, search
from postweave.plans import fixtures as fx
from postweave.plans.registry import query, table
from postweave.session import scratch_path, spread
from postweave.sources import generated, postings, vector_store
from postweave.streaming import progress


def _flat(jobs: DataFrame) -> DataFrame:
    """Postings with details and tags as one text each, to compare them as plain columns."""
    pairs = lambda_sql("transform", "details", lambda d: f"concat({d}.key, '=', {d}.value)")
    return jobs.select(
        *postings.FLAT_FIELDS,
        F.expr(f"array_join({pairs}, '|')").alias("details"),
        F.coalesce(F.array_join("status_tags", ","), F.lit("")).alias("tags"),
        "error",
    )


_FLAT_SQL = f"""WITH {fx.JOBS_SQL}
SELECT id, title, company, division, openings, city, level, deadline, error,
  CASE WHEN error IS NOT NULL THEN 'error=' || error ELSE
    'job_title=' || d_job_title || '|organization=' || d_organization || '|level=' || d_level
    || '|job_summary=' || d_job_summary || '|required_skills=' || d_required_skills || '|notes=' || d_notes
  END AS details,
  CASE WHEN error IS NOT NULL THEN '' ELSE level || ',' || division END AS tags
FROM jobs"""


@query("scan_jobs_json", _FLAT_SQL)
def scan_jobs_json(spark, sf_dir):
    path = scratch_path(spark, "jobs-json")
    postings.write_snapshot(fx.jobs(spark, sf_dir), path, "json")
    return _flat(postings.read_jobs_json(spark, path, layout="lines"))


LIST_POSTINGS, LIST_RANGE = 100, 1 << 16  # postings a list file, bytes a range


@query("scan_jobs_ranges", _FLAT_SQL)
def scan_jobs_ranges(spark, sf_dir):
    """List files cut into byte ranges without regard to where postings begin and end."""
    path = scratch_path(spark, "jobs-lists")
    jobs = fx.jobs(spark, sf_dir)
    texts = postings.postings_as_json(jobs)
    place = F.floor(F.col("id") / LIST_POSTINGS).cast("string")
    numbered = texts.select("value", F.get_json_object("value", "$.id").cast("bigint").alias("id")).select("value", place.alias("place"))
    files = numbered.groupBy("place").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]\n")).alias("body"))
    generated.write_files(files.select(F.concat("place", F.lit(".json")).alias("name"), "body"), path)
    return _flat(postings.read_jobs_json(spark, path, layout="ranges", range_bytes=LIST_RANGE))


@query("sink_snapshot", _FLAT_SQL)
def sink_snapshot(spark, sf_dir):
    path = scratch_path(spark, "jobs")
    rows = fx.jobs(spark, sf_dir).drop("seq")
    postings.write_snapshot(rows, path)
    postings.write_snapshot(rows, path)  # the second write replaces the first
    return _flat(spark.read.parquet(path))


@query("resume_state", f"WITH {fx.JOBS_SQL} SELECT id, error IS NULL AS done FROM jobs")
def resume_state(spark, sf_dir):
    path = scratch_path(spark, "resume")
    postings.write_snapshot(fx.jobs(spark, sf_dir), path, "json")
    return postings.resume_state(spark, path).select("id", collect.succeeded().alias("done"))


@query(
    "resume_rejects",
    f"""WITH {fx.JOBS_SQL} SELECT CASE WHEN seq % 50 <> 3 THEN id END AS id, seq % 50 <> 3 AND error IS NULL AS done,
  CASE WHEN seq % 50 = 3 THEN CAST(seq AS VARCHAR) END AS rejected FROM jobs""",
)
def resume_rejects(spark, sf_dir):
    """Saved postings with one broken line in fifty: the others go on, the broken ones are set aside."""
    path = scratch_path(spark, "broken-resume")
    jobs = fx.jobs(spark, sf_dir).filter("seq % 50 <> 3")
    broken = fx.jobs(spark, sf_dir).filter("seq % 50 = 3").select(F.concat(F.lit('{"id": "'), "id", F.lit('", "title": "cut of')).alias("value"))
    postings.postings_as_json(jobs).unionByName(broken).write.text(path)
    state, rejects = postings.resume_with_rejects(spark, path)
    kept = state.select("id", collect.succeeded().alias("done"), F.lit(None).cast("string").alias("rejected"))
    number = F.regexp_extract("line", '"id": "([0-9]+)"', 1)
    return kept.unionByName(rejects.select(F.lit(None).cast("string").alias("id"), F.lit(False).alias("done"), number.alias("rejected")))


@query("scan_text_docs", "SELECT doc_id, text FROM documents")
def scan_text_docs(spark, sf_dir):
    path = scratch_path(spark, "texts")
    docs = spread(table(spark, sf_dir, "documents"))
    generated.write_files(docs.select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("body")), path)
    files = postings.read_documents(spark, path, pattern="*.txt")
    return files.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), "text")


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def scan_pages(spark, sf_dir):
    return postings.read_pages(spark, f"{sf_dir}/pages.parquet")


@query(
    "sink_checkpointed",
    """WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT CAST(n // 10 AS BIGINT) AS batch, COUNT(*) AS saved, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id
FROM numbered GROUP BY 1""",
)
def sink_checkpointed(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    stream = progress.table_stream(spark, f"{sf_dir}/documents.parquet", schema).select("doc_id", "source")
    sink, marks = scratch_path(spark, "progress"), scratch_path(spark, "progress-marks")
    for _ in range(2):  # the second call finds nothing new
        progress.collect_available(stream, sink, marks, "doc_id", ["doc_id"])
    saved = collect.batch_numbers(spark.read.parquet(sink), ["doc_id"])
    return saved.groupBy("batch").agg(
        F.count("*").alias("saved"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


def embedding_index(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.build_index(rows, "embedding", F.concat(F.lit("job-"), "vec_id"), "vec_id")


def vector_values(index: DataFrame, vec: str, *keys: str) -> DataFrame:
    """One row per vector element, rounded."""
    rows = index.select(*keys, F.posexplode(vec).alias("pos", "value"))
    return rows.select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        (F.round(F.col("value").cast("double"), 6) + F.lit(0.0)).alias("value"),
    )


# Unit float32 vectors of the embeddings, one row per element.
UNIT_SQL = """
unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT)) AS vec
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n
        FROM embeddings)),
cells AS (
  SELECT vec_id, label, vec, unnest(range(0, len(vec))) AS pos, unnest(vec) AS value FROM unit)"""

INDEX_SQL = f"""WITH {UNIT_SQL},
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS internal_id FROM embeddings)
SELECT internal_id, 'job-' || CAST(vec_id AS VARCHAR) AS job_id, pos, round(CAST(value AS DOUBLE), 6) + 0.0 AS value
FROM cells JOIN ids USING (vec_id)"""


@query("index_write", INDEX_SQL)
def index_write(spark, sf_dir):
    prefix = scratch_path(spark, "index")
    vector_store.save_index(embedding_index(spark, sf_dir), prefix, "stored", "embeddings")
    return vector_values(spark.read.parquet(f"{prefix}/vectors"), "vec", "internal_id", "job_id")


@query(
    "index_read",
    f"""SELECT *, 'stored' AS model_name, (SELECT COUNT(*) FROM embeddings) AS num_vectors,
  (SELECT CAST(MAX(len(embedding)) AS BIGINT) FROM embeddings) AS dim FROM ({INDEX_SQL})""",
)
def index_read(spark, sf_dir):
    prefix = scratch_path(spark, "index")
    vector_store.save_index(embedding_index(spark, sf_dir), prefix, "stored", "embeddings")
    index, meta = vector_store.load_index(spark, prefix)
    known = [meta.select(c).scalar().alias(c) for c in ("model_name", "num_vectors", "dim")]
    return vector_values(index, "vec", "internal_id", "job_id").select("*", *known)


@query(
    "index_meta",
    "SELECT COUNT(*) AS num_vectors, 'stored' AS model_name, CAST(MAX(len(embedding)) AS BIGINT) AS dim FROM embeddings",
)
def index_meta(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vec"))
    return vector_store.meta_summary(vector_store.index_meta(vecs, "stored", "embeddings"))


READ_TASKS_A_CORE = 8


@query(
    "sink_documents",
    f"""WITH {fx.JOBS_SQL}
SELECT id AS job_id, kind, '% ' || kind || chr(10) || 'Job ' || id || ' in ' || city AS body
FROM jobs, (VALUES ('resume'), ('cover_letter')) AS k(kind)""",
)
def sink_documents(spark, sf_dir):
    root = scratch_path(spark, "documents")
    jobs = documents.with_kinds(fx.jobs(spark, sf_dir).select(F.col("id").alias("job_id"), "city"))
    body = F.concat(F.lit("% "), "kind", F.lit("\nJob "), "job_id", F.lit(" in "), "city")
    docs, later = jobs.withColumn("body", body), F.col("kind") == "resume"
    generated.write_generated(docs.filter(~later), root)
    written = generated.write_generated(docs.filter(later), root)  # the table names both runs' files
    # the table's files rather than a listing, which the driver would hold whole; dealt out by number, as a path is short
    wanted = written.select("path").repartition(READ_TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    texts = postings.read_documents(spark, root, wanted=wanted)
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return (
        written.withColumn("name", name("path"))
        .join(texts.select(name("path").alias("name"), F.col("text").alias("body")), "name")
        .select("job_id", "kind", "body")
    )


def presence_table(spark, sf_dir) -> DataFrame:
    """Which generated files exist, as a table: resume for quality 1, cover letter for toxic 0."""
    labels = table(spark, sf_dir, "labels").withColumn("job_id", F.col("doc_id").cast("string"))
    rows = documents.with_kinds(labels)
    return rows.filter(
        ((F.col("kind") == "resume") & (F.col("quality") == 1))
        | ((F.col("kind") == "cover_letter") & (F.col("toxic") == 0))
    ).select("job_id", "kind")


@query(
    "scan_presence",
    """SELECT CAST(d.doc_id AS VARCHAR) AS job_id, kind,
  coalesce((kind = 'resume' AND quality = 1) OR (kind = 'cover_letter' AND toxic = 0), false) AS present
FROM documents d CROSS JOIN (VALUES ('resume'), ('cover_letter')) AS k(kind)
LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def scan_presence(spark, sf_dir):
    root = scratch_path(spark, "presence")
    bodies = F.when(F.col("kind") == "resume", "").otherwise("x")  # empty files exist too
    generated.write_generated(presence_table(spark, sf_dir).withColumn("body", bodies), root)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"))
    found = generated.present_generated(docs, root)
    joined = documents.with_kinds(docs).join(found, ["job_id", "kind"], "left")
    return joined.select("job_id", "kind", F.col("path").isNotNull().alias("present"))
