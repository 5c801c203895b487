"""Registered queries for HTML pages. List and detail pages are made from table rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.functions.text import WHITESPACE, last_number, normalize_key
from postweave.operators import flatten, markup
from postweave.plans import collecting
from postweave.plans import fixtures as fx
from postweave.plans.registry import query, table
from postweave.session import spread

_CHARS = WHITESPACE  # the same characters for DuckDB's trim
_REST_SQL = r"""[^>=]*(?:=\s*(?:"[^"]*"|''[^'']*'')?[^>=]*)*>"""  # the rest of a tag


@query(
    "html_tokens",
    r"""WITH t AS (
  SELECT page_id, regexp_extract_all(
    regexp_replace(html, '(?is)<script\bREST.*?</script\s*>|<style\bREST.*?</style\s*>|<!--.*?-->', '', 'g'),
    '</?[a-zA-Z!]REST|[^<]+|<') AS tokens FROM pages),
u AS (SELECT page_id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS raw FROM t)
SELECT page_id, pos, raw, lower(regexp_extract(raw, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM u""".replace("REST", _REST_SQL),
)
def html_tokens(spark, sf_dir):
    return markup.html_tokens(spread(table(spark, sf_dir, "pages")))


def _part_rows(spark, sf_dir):
    return markup.list_rows(fx.part_pages(spark, sf_dir))


_PART = f"""WITH p AS (
  SELECT *, p_partkey // {fx.ROWS_PER_PAGE} AS page_id, p_partkey % 10 AS kind,
    row_number() OVER (PARTITION BY p_partkey // {fx.ROWS_PER_PAGE} ORDER BY p_partkey) - 1 AS row_no FROM part)"""


def _row_key():
    return "page_id", F.col("row_no").cast("bigint").alias("row_no")


@query(
    "html_rows",
    f"""{_PART} SELECT page_id, row_no, CAST(CASE WHEN kind = 3 THEN 7 ELSE 8 END AS BIGINT) AS n_cells,
  CAST(CASE WHEN kind = 5 THEN 0 ELSE 1 END AS BIGINT) AS n_heads FROM p""",
)
def html_rows(spark, sf_dir):
    return _part_rows(spark, sf_dir).select(
        *_row_key(),
        F.size("cells").cast("bigint").alias("n_cells"),
        F.size("heads").cast("bigint").alias("n_heads"),
    )


@query("html_cell_guard", f"{_PART} SELECT page_id, row_no FROM p WHERE kind <> 3")
def html_cell_guard(spark, sf_dir):
    return markup.enough_cells(_part_rows(spark, sf_dir)).select(*_row_key())


@query("title_link_guard", f"{_PART} SELECT page_id, row_no, kind <> 4 AS linked FROM p")
def title_link_guard(spark, sf_dir):
    title_cell = F.when(F.size("heads") >= 1, F.get("cells", F.lit(0))).otherwise(F.get("cells", F.lit(1)))
    return _part_rows(spark, sf_dir).select(*_row_key(), markup.has_title_link(title_cell).alias("linked"))


_FULL = """page_id, row_no, CASE WHEN kind = 6 THEN 'none' ELSE CAST(p_partkey AS VARCHAR) END AS id,
  p_name AS title, p_brand || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'West' ELSE '' END AS company,
  p_type || CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'in' ELSE '' END AS division, CAST(p_size AS VARCHAR) AS openings,
  'city' AS city, 'level' AS level, 'deadline' AS deadline"""
_LIST = ["id", "title", *markup.CELL_FIELDS]


@query("list_rows_full", f"{_PART} SELECT {_FULL} FROM p WHERE kind NOT IN (3, 4)")
def list_rows_full(spark, sf_dir):
    return markup.list_rows_full(_part_rows(spark, sf_dir)).select(*_row_key(), *_LIST)


_SUPPLIER = f"""s AS (
  SELECT *, s_suppkey // {fx.ROWS_PER_PAGE} AS page_id,
    row_number() OVER (PARTITION BY s_suppkey // {fx.ROWS_PER_PAGE} ORDER BY s_suppkey) - 1 AS row_no FROM supplier)"""
_DIRECT = """page_id, row_no, CAST(s_suppkey AS VARCHAR) AS id, s_name || ' & Co' AS title,
  'Company ' || CAST(s_nationkey AS VARCHAR) AS company, '' AS division, CAST(s_nationkey AS VARCHAR) AS openings,
  'city' AS city, 'level' AS level, 'deadline' AS deadline"""


@query("list_rows_direct", f"WITH {_SUPPLIER} SELECT {_DIRECT} FROM s WHERE s_suppkey % 10 <> 4")
def list_rows_direct(spark, sf_dir):
    rows = markup.list_rows(fx.supplier_pages(spark, sf_dir))
    return markup.list_rows_direct(rows).select(*_row_key(), *_LIST)


@query(
    "list_rows_dispatch",
    f"""{_PART}, {_SUPPLIER}
SELECT 'full' AS layout, {_FULL} FROM p WHERE kind NOT IN (3, 4)
UNION ALL SELECT 'direct' AS layout, {_DIRECT} FROM s WHERE s_suppkey % 10 <> 4""",
)
def list_rows_dispatch(spark, sf_dir):
    pages = fx.part_pages(spark, sf_dir).unionByName(fx.supplier_pages(spark, sf_dir))
    layout = F.when(F.contains(F.col("url"), F.lit(markup.DIRECT_LAYOUT_URL)), "direct").otherwise("full")
    rows = markup.list_rows_dispatch(markup.list_rows(pages))
    return rows.select(layout.alias("layout"), *_row_key(), *_LIST)


@query(
    "last_number_id",
    f"""SELECT page_id, coalesce(regexp_extract_all(url, '[0-9]+')[-1], trim(url, '{_CHARS}')) AS id FROM pages""",
)
def last_number_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", last_number(F.col("url")).alias("id"))


@query(
    "strip_fields",
    f"""SELECT doc_id, trim(chr(9) || ' ' || text || chr(160) || chr(10), '{_CHARS}') AS text,
  trim(source || chr(8195), '{_CHARS}') AS source FROM documents""",
)
def strip_fields(spark, sf_dir):
    padded = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("\t "), "text", F.lit("\xa0\n")).alias("text"),
        F.concat("source", F.lit(" ")).alias("source"),
    )
    return markup.strip_fields(padded, "text", "source")


@query(
    "normalize_key",
    f"""SELECT doc_id, translate(lower(trim(text, '{_CHARS}')), ' /:', '__') AS key
FROM documents""",
)
def normalize_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_key(F.col("text")).alias("key"))


_DOCS = f"""WITH d AS (
  SELECT doc_id, lang, source, trim(text, '{_CHARS}') AS body, doc_id % 6 AS kind, doc_id % 41 = 40 AS bare,
    doc_id % 82 = 81 AS unread FROM documents)"""


@query(
    "detail_header",
    f"""{_DOCS} SELECT doc_id,
  CASE WHEN bare OR kind = 1 THEN NULL WHEN kind = 2 THEN 'N/A' ELSE 'Role ' || CAST(doc_id AS VARCHAR) END AS job_title,
  CASE WHEN bare OR kind IN (1, 3) THEN NULL WHEN kind = 2 THEN 'Org'
       ELSE 'Org ' || CAST(doc_id % 17 AS VARCHAR) END AS organization,
  CASE WHEN bare OR kind IN (1, 3) THEN NULL ELSE 'Div' END AS division FROM d""",
)
def detail_header(spark, sf_dir):
    headers = markup.detail_headers(fx.detail_pages(spark, sf_dir))
    names = ["job_title", "organization", "division"]
    return headers.select("doc_id", *[flatten.detail(F.col("header"), n).alias(n) for n in names])


@query(
    "detail_tags",
    f"""{_DOCS} SELECT doc_id, CAST(CASE WHEN bare OR kind = 4 THEN 0 ELSE 2 END AS BIGINT) AS n_tags,
  CASE WHEN bare OR kind = 4 THEN '' ELSE lang || '|' || source END AS tags FROM d""",
)
def detail_tags(spark, sf_dir):
    tagged = markup.detail_tags(fx.detail_pages(spark, sf_dir))
    return tagged.select(
        "doc_id",
        F.size("status_tags").cast("bigint").alias("n_tags"),
        F.array_join("status_tags", "|").alias("tags"),
    )


# Sections of a detail page as they must come out: number, key, first part, later parts, value.
_SECTIONS = f"""{_DOCS},
parts AS (
  SELECT *, 'Source' || chr(10) || source || chr(10) || 'end' || chr(10) || chr(10)
    || 'one' || chr(10) || 'two & three' AS siblings FROM d WHERE NOT bare),
s AS (
  SELECT doc_id, kind, 0 AS section_no, 'level' AS section, lang || ', Senior, ' AS first_part, 0 AS n_later,
    lang || ', Senior, ' AS value FROM parts
  UNION ALL SELECT doc_id, kind, 1, 'job_summary', body, 2,
    CASE WHEN body = '' THEN siblings ELSE body || chr(10) || chr(10) || siblings END FROM parts
  UNION ALL SELECT doc_id, kind, 2, 'work_term', '', 0, 'N/A' FROM parts
  UNION ALL SELECT doc_id, kind, 3, 'job_title', 'ignored', 0, 'ignored' FROM parts
  UNION ALL SELECT doc_id, kind, 5, 'targeted_degrees_and_disciplines',
    CASE WHEN doc_id % 4 = 0 THEN 'N/A' ELSE lang || chr(10) || chr(10) || 'D ' || CAST(doc_id AS VARCHAR) END, 0,
    CASE WHEN doc_id % 4 = 0 THEN 'N/A' ELSE lang || chr(10) || chr(10) || 'D ' || CAST(doc_id AS VARCHAR) END
    FROM parts
  UNION ALL SELECT doc_id, kind, 6, 'additional_information', source || chr(10) || 'Row' || CAST(doc_id AS VARCHAR), 0,
    source || chr(10) || 'Row' || CAST(doc_id AS VARCHAR) FROM parts
  UNION ALL SELECT doc_id, kind, 7, 'contact_web_site_', '', 1, 'a' || chr(10) || 'b' || chr(10) || 'c' FROM parts
  UNION ALL SELECT doc_id, kind, 8, 'division', 'Second ' || CAST(doc_id % 19 AS VARCHAR), 0,
    'Second ' || CAST(doc_id % 19 AS VARCHAR) FROM parts)"""


@query(
    "detail_sections",
    f"""{_SECTIONS} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, section,
  CAST(n_later AS BIGINT) AS n_later, value FROM s""",
)
def detail_sections(spark, sf_dir):
    rows = markup.detail_sections(fx.detail_pages(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "section_no", "section", "n_later", "value")


@query("detail_content_rule", f"{_SECTIONS} SELECT doc_id, section, first_part FROM s")
def detail_content_rule(spark, sf_dir):
    rows = markup.detail_sections(fx.detail_pages(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "section", "first_part")


_MERGED = f"""{_SECTIONS},
head AS (
  SELECT doc_id, -3 AS place, 'job_title' AS key,
    CASE WHEN kind = 2 THEN 'N/A' ELSE 'Role ' || CAST(doc_id AS VARCHAR) END AS value FROM parts WHERE kind <> 1
  UNION ALL SELECT doc_id, -2, 'organization',
    CASE WHEN kind = 2 THEN 'Org' ELSE 'Org ' || CAST(doc_id % 17 AS VARCHAR) END FROM parts WHERE kind NOT IN (1, 3)
  UNION ALL SELECT doc_id, -1, 'division', 'Div' FROM parts WHERE kind NOT IN (1, 3)),
every AS (
  SELECT doc_id, place, key, value FROM head
  UNION ALL SELECT doc_id, section_no, section, value FROM s WHERE section <> 'job_title'),
merged AS (SELECT doc_id, key, MIN(place) AS place, arg_max(value, place) AS value FROM every GROUP BY doc_id, key)"""


@query(
    "detail_record",
    f"""{_MERGED}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, key, value, NULL::VARCHAR AS error
FROM merged
UNION ALL SELECT doc_id, NULL, NULL, NULL, CASE WHEN unread THEN 'Empty detail page' END FROM d WHERE bare""",
)
def detail_record(spark, sf_dir):
    records = markup.detail_records(fx.detail_pages(spark, sf_dir))
    rows = records.select("doc_id", "error", F.posexplode_outer("details").alias("pos", "d"))
    return rows.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("d.key").alias("key"),
        F.col("d.value").alias("value"),
        "error",
    )


@query(
    "collect_postings",
    f"""{_MERGED}, {_PART.removeprefix("WITH ")},
l AS (SELECT {_FULL} FROM p WHERE kind NOT IN (3, 4)),
shown AS (SELECT doc_id, string_agg(key || '=' || value, chr(1) ORDER BY place) AS details FROM merged GROUP BY doc_id)
SELECT l.id, title, company, deadline, CASE WHEN bare AND NOT unread THEN '' ELSE details END AS details,
  CASE WHEN bare AND NOT unread THEN '' WHEN bare OR d.doc_id IS NULL THEN NULL WHEN d.kind = 4 THEN ''
       ELSE lang || '|' || source END AS status_tags,
  CASE WHEN d.doc_id IS NULL THEN 'No detail page' WHEN unread THEN 'Empty detail page' END AS error
FROM l LEFT JOIN d ON l.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN shown ON shown.doc_id = d.doc_id""",
)
def collect_postings(spark, sf_dir):
    """List pages of ``part`` joined with the detail pages of ``documents`` by posting id."""
    pages = fx.detail_pages(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    found = collecting.postings_from_pages(fx.part_pages(spark, sf_dir), pages)
    details, tags = F.array_join(F.transform("details", _PAIRS), "\x01"), F.array_join("status_tags", "|")
    return found.select(
        "id", "title", "company", "deadline", details.alias("details"), tags.alias("status_tags"), "error"
    )


_PAIRS = lambda d: F.concat(d.key, F.lit("="), d.value)


@query(
    "collect_round",
    f"""{_MERGED}, {_PART.removeprefix("WITH ")}, {fx.WHOLE_JOBS_SQL.strip()},
l AS (SELECT {_FULL} FROM p WHERE kind NOT IN (3, 4)),
new AS (
  SELECT *, row_number() OVER (ORDER BY page_id, row_no) + (SELECT MAX(seq) FROM jobs) AS seq FROM l
  WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE jobs.id = l.id AND error IS NULL)),
shown AS (SELECT doc_id, string_agg(key || '=' || value, chr(1) ORDER BY place) AS details FROM merged GROUP BY doc_id)
SELECT seq, id, title, company, CASE WHEN error IS NOT NULL THEN 'error=' || error ELSE concat_ws(chr(1),
    'job_title=' || d_job_title, 'organization=' || d_organization, 'level=' || d_level,
    'job_summary=' || d_job_summary, 'required_skills=' || d_required_skills, 'notes=' || d_notes) END AS details, error
FROM jobs
UNION ALL
SELECT seq, id, title, company, CASE WHEN bare AND NOT unread THEN '' ELSE details END,
  CASE WHEN d.doc_id IS NULL THEN 'No detail page' WHEN unread THEN 'Empty detail page' END
FROM new LEFT JOIN d ON id = CAST(d.doc_id AS VARCHAR) LEFT JOIN shown ON shown.doc_id = d.doc_id""",
)
def collect_round(spark, sf_dir):
    """The list pages of ``part`` after the postings of ``documents`` were saved: failed ones are read again."""
    pages = fx.detail_pages(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    rows = collecting.collect_round(fx.whole_jobs(spark, sf_dir), fx.part_pages(spark, sf_dir), pages)
    details = F.array_join(F.transform("details", _PAIRS), "\x01")
    return rows.select("seq", "id", "title", "company", details.alias("details"), "error")


@query(
    "quarantine",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 7 = 0 THEN 'unreadable props' END AS error FROM events""",
)
def quarantine(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.expr("if(event_id % 7 = 0, concat('x', props), props)").alias("props")
    )
    parsed = events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    marked = parsed.withColumn("error", F.when(F.col("k").isNull(), "unreadable props"))
    good, bad = markup.split_quarantine(marked)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
