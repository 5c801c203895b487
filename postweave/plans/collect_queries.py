"""Registered queries for incremental collection and text flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators import collect, flatten
from postweave.plans import fixtures as fx
from postweave.plans.registry import ORACLES, query, table
from postweave.session import scratch_path
from postweave.sources import collection_store
from postweave.streaming import attempts, progress

CAP = 500
RUN_LENGTH = 2

_LOG = ["ts", "event_id"]


def _failed():
    return F.col("event_type") == "error"


def _finished(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))


def _found(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


_SPLIT = """WITH old AS (SELECT DISTINCT d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND quality = 1),
new AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM old))"""


def _split(spark, sf_dir):
    """Documents that are finished, and those that are not."""
    found, done = _found(spark, sf_dir), _finished(spark, sf_dir)
    return found.join(done.distinct(), "id", "left_semi"), collect.only_new(found, done)


@query("success_filter", f"WITH {fx.JOBS_SQL} SELECT id FROM jobs WHERE error IS NULL")
def success_filter(spark, sf_dir):
    return collect.success_filter(fx.jobs(spark, sf_dir)).select("id")


@query("incremental_new", f"{_SPLIT} SELECT id FROM new")
def incremental_new(spark, sf_dir):
    return collect.only_new(_found(spark, sf_dir), _finished(spark, sf_dir))


@query("incremental_saved", f"{_SPLIT} SELECT id FROM new")
def incremental_saved(spark, sf_dir):
    """As ``incremental_new``, against a saved collection that stays in its buckets."""
    path = scratch_path(spark, "collection")
    name = "saved_" + path.rsplit("-", 1)[1]
    done = _finished(spark, sf_dir)
    first = F.col("id") % 3 == 0
    collection_store.save_collection(done.filter(first), name, path)
    collection_store.save_collection(done.filter(~first), name, path, mode="append")
    return collection_store.only_unsaved(_found(spark, sf_dir), name)


@query(
    "resolve_attempts",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, event_type = 'error' AS failed, props, n FROM a WHERE n <= 2)
SELECT user_id, bool_or(NOT failed) AS ok,
  CAST(coalesce(MIN(CASE WHEN NOT failed THEN n END), MAX(n)) AS BIGINT) AS attempts,
  CASE WHEN NOT bool_or(NOT failed) THEN arg_max(props, n) END AS error
FROM t GROUP BY user_id""",
)
def resolve_attempts(spark, sf_dir):
    return collect.resolve_attempts(table(spark, sf_dir, "events"), "user_id", _LOG, _failed(), F.col("props"))


@query(
    "cap_rows",
    f"""{_SPLIT}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM new)
SELECT id FROM old UNION ALL
SELECT id FROM r WHERE n <= greatest({CAP} - (SELECT COUNT(*) FROM old), 1)""",
)
def cap_rows(spark, sf_dir):
    old, new = _split(spark, sf_dir)
    return collect.cap_rows(old, new, CAP, ["id"])


@query(
    "failure_runs",
    f"""WITH e AS (
  SELECT user_id, event_id, ts, event_type = 'error' AS failed,
    SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
  FROM events)
SELECT user_id, COUNT(*) AS run_length, arg_min(event_id, (ts, event_id)) AS first_event_id,
  arg_max(event_id, (ts, event_id)) AS last_event_id
FROM e WHERE failed GROUP BY user_id, island HAVING COUNT(*) >= {RUN_LENGTH}""",
)
def failure_runs(spark, sf_dir):
    return collect.failure_runs(table(spark, sf_dir, "events"), "user_id", _LOG, _failed(), RUN_LENGTH)


def _followed(spark, sf_dir):
    """The events in three sessions, each followed as it comes."""
    events = table(spark, sf_dir, "events")
    cuts = events.select(F.percentile_approx("ts", [0.3, 0.7]).alias("cuts")).first().cuts
    folder, sink, marks = (scratch_path(spark, n) for n in ("sessions", "changes", "changes-marks"))
    session = F.when(F.col("ts") < cuts[0], 0).when(F.col("ts") < cuts[1], 1).otherwise(2)
    for number in range(3):
        events.filter(session == number).write.mode("append").parquet(folder)
        log = progress.posting_stream(spark, folder, events.schema)
        changes = attempts.follow(log, "user_id", _LOG, _failed(), F.col("props"), at_least=RUN_LENGTH)
        attempts.collect_changes(changes, sink, marks)
    return sink


@query("followed_attempts", ORACLES["resolve_attempts"])
def followed_attempts(spark, sf_dir):
    return attempts.saved_attempts(spark, _followed(spark, sf_dir), "user_id")


@query("followed_runs", ORACLES["failure_runs"])
def followed_runs(spark, sf_dir):
    return attempts.saved_runs(spark, _followed(spark, sf_dir), "user_id", "event_id")


@query(
    "page_advance",
    """WITH p AS (SELECT user_id, event_id, event_type AS first_key,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_key FROM events)
SELECT *, first_key IS DISTINCT FROM previous_key AS advanced FROM p""",
)
def page_advance(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    advanced = collect.page_advance(pages, "user_id", _LOG, F.col("event_type"))
    return advanced.select("user_id", "event_id", "first_key", "previous_key", "advanced")


@query(
    "append_union",
    f"""{_SPLIT}, u AS (SELECT id, 0 AS part FROM old UNION ALL SELECT id, 1 FROM new)
SELECT id, row_number() OVER (ORDER BY part, id) - 1 AS place FROM u""",
)
def append_union(spark, sf_dir):
    return collect.append_union(*_split(spark, sf_dir), ["id"])


@query(
    "outcome_summary",
    f"""WITH {fx.JOBS_SQL} SELECT COUNT(*) AS total, COUNT(*) FILTER (error IS NULL) AS successful,
  COUNT(*) FILTER (error IS NOT NULL) AS failed FROM jobs""",
)
def outcome_summary(spark, sf_dir):
    return collect.outcome_summary(fx.jobs(spark, sf_dir))


@query(
    "last_wins",
    """SELECT user_id, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def last_wins(spark, sf_dir):
    rows = collect.last_wins(table(spark, sf_dir, "events"), "user_id", _LOG)
    return rows.select("user_id", "event_id", "event_type", "value", "props")


@query(
    "falsy_coalesce",
    f"""WITH {fx.WHOLE_JOBS_SQL} SELECT id, coalesce(nullif(title, ''), d_job_title) AS title,
  coalesce(nullif(company, ''), d_organization) AS company FROM jobs""",
)
def falsy_coalesce(spark, sf_dir):
    return fx.whole_jobs(spark, sf_dir).select(
        "id", flatten.title_or_detail().alias("title"), flatten.company_or_detail().alias("company")
    )


def _values(jobs, values):
    rows = jobs.select("id", F.posexplode(values).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


_PRIORITY = "list_filter([d_job_summary, d_required_skills], lambda x: x IS NOT NULL AND x <> '')"
_RESIDUAL = """list_filter([d_organization, d_level, d_notes, error],
  lambda x: x IS NOT NULL AND length(x) BETWEEN 1 AND 2000)"""


def _values_sql(values: str) -> str:
    return f"""WITH {fx.JOBS_SQL}, v AS (SELECT id, {values} AS vals FROM jobs)
SELECT id, unnest(range(0, len(vals))) AS pos, unnest(vals) AS value FROM v"""


@query("priority_fields", _values_sql(_PRIORITY))
def priority_fields(spark, sf_dir):
    return _values(fx.jobs(spark, sf_dir), flatten.priority_values(F.col("details")))


@query("residual_fields", _values_sql(_RESIDUAL))
def residual_fields(spark, sf_dir):
    return _values(fx.jobs(spark, sf_dir), flatten.residual_values(F.col("details")))


# The flattened text of each posting, as a further WITH entry after the postings.
TEXT_SQL = f"""
texts AS (
  SELECT seq, id, array_to_string(list_concat(list_concat(
    list_filter([coalesce(nullif(title, ''), d_job_title), coalesce(nullif(company, ''), d_organization)],
                lambda x: x IS NOT NULL AND x <> ''), {_PRIORITY}), {_RESIDUAL}), ' ' || chr(10) || ' ') AS text
  FROM jobs)"""


@query("posting_text", f"WITH {fx.WHOLE_JOBS_SQL}, {TEXT_SQL} SELECT id, text FROM texts")
def posting_text(spark, sf_dir):
    return flatten.with_posting_text(fx.whole_jobs(spark, sf_dir)).select("id", "text")
