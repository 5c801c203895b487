"""Registered queries for vectors and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.functions import vectors as V
from postweave.operators import cells, prefilter, search
from postweave.operators.ordering import dense_ids
from postweave.plans import fixtures as fx
from postweave.plans import matching
from postweave.plans.collect_queries import TEXT_SQL
from postweave.plans.registry import query, table
from postweave.plans.source_queries import INDEX_SQL, UNIT_SQL, embedding_index, vector_values
from postweave.session import scratch_path, spread
from postweave.sources import generated, vector_store

TOP_K = 4
DIM = 64


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _cells(rows: str, keys: str, vec: str) -> str:
    """One row per vector element, rounded."""
    return f"""SELECT {keys}, pos, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM (
  SELECT {keys}, unnest(range(0, len({vec}))) AS pos, unnest({vec}) AS value FROM {rows})"""


def _hash_sql(prefix: str, source: str, key: str) -> str:
    """WITH entries that encode ``source(key, text)`` by signed hashing into ``<prefix>(k, pos, value)``."""
    return f"""
{prefix}_tok AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {source}),
{prefix}_sum AS (
  SELECT k, CAST('0x' || substr(md5(t), 1, 4) AS INT) % {DIM} AS pos,
    SUM(CASE WHEN CAST('0x' || substr(md5(t), 5, 1) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s
  FROM {prefix}_tok GROUP BY 1, 2),
{prefix}_len AS (SELECT k, sqrt(SUM(s * s)) AS n FROM {prefix}_sum GROUP BY k),
{prefix} AS (
  SELECT r.{key} AS k, CAST(g.pos AS BIGINT) AS pos, coalesce(s / nullif(n, 0), 0.0) AS value
  FROM {source} r CROSS JOIN range({DIM}) AS g(pos)
  LEFT JOIN {prefix}_sum v ON v.k = r.{key} AND v.pos = g.pos LEFT JOIN {prefix}_len l ON l.k = r.{key})"""


@query(
    "encode_corpus",
    f"WITH {_hash_sql('v', 'documents', 'doc_id')} SELECT k AS doc_id, pos, round(value, 6) + 0.0 AS value FROM v",
)
def encode_corpus(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return vector_values(search.encode(docs, "text"), "vec", "doc_id")


@query(
    "encode_query",
    f"WITH {_hash_sql('v', 'benchmark', 'item_id')} SELECT k AS item_id, pos, round(value, 6) + 0.0 AS value FROM v",
)
def encode_query(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return vector_values(search.encode(items, "text"), "vec", "item_id")


_TRIPLED = """list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE CAST(x AS DOUBLE) * 3 END)"""


@query(
    "l2_normalize",
    f"""WITH t AS (SELECT vec_id, {_TRIPLED} AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t),
u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vec FROM n)
{_cells('u', 'vec_id', 'vec')}""",
)
def l2_normalize(spark, sf_dir):
    zero = F.col("vec_id") % 10 == 0
    tripled = _embeddings(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda x: F.when(zero, 0.0).otherwise(x.cast("double") * 3)).alias("v")
    )
    return vector_values(search.l2_normalize(tripled, "v"), "vec", "vec_id")


@query(
    "to_float32",
    f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / 3 AS FLOAT)) AS vec
FROM embeddings) {_cells('t', 'vec_id', 'vec')}""",
)
def to_float32(spark, sf_dir):
    thirds = F.transform("embedding", lambda x: x.cast("double") / 3)
    return vector_values(
        _embeddings(spark, sf_dir).select("vec_id", V.to_float32(thirds).alias("vec")), "vec", "vec_id"
    )


@query("dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS internal_id FROM documents")
def dense(spark, sf_dir):
    return dense_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "id_mapping",
    """SELECT vec_id AS internal_id, coalesce('job-' || CAST(doc_id AS VARCHAR), CAST(vec_id AS VARCHAR)) AS job_id
FROM embeddings LEFT JOIN labels ON vec_id = doc_id""",
)
def id_mapping(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("internal_id"), F.concat(F.lit("job-"), "doc_id").alias("job_id")
    )
    return search.map_ids(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("internal_id")), known)


@query("index_build", INDEX_SQL)
def index_build(spark, sf_dir):
    return vector_values(embedding_index(spark, sf_dir), "vec", "internal_id", "job_id")


@query(
    "vector_profile",
    """SELECT COUNT(*) AS num_vectors, CAST(MIN(len(embedding)) AS BIGINT) AS min_dim,
  CAST(MAX(len(embedding)) AS BIGINT) AS max_dim FROM embeddings""",
)
def vector_profile(spark, sf_dir):
    return search.vector_profile(_embeddings(spark, sf_dir), "embedding")


def _units(spark, sf_dir):
    """The embeddings as unit float32 vectors ``(internal_id, vec, label)``."""
    units = search.l2_normalize(_embeddings(spark, sf_dir), "embedding")
    return units.select(F.col("vec_id").alias("internal_id"), V.to_float32(F.col("vec")).alias("vec"), "label")


_BLEND = """list_transform(list_zip({q}, {c}),
  lambda x: (1.0 - {w}) * CAST(x[1] AS DOUBLE) + {w} * CAST(x[2] AS DOUBLE))"""


def _norm_sql(vec: str) -> str:
    return f"sqrt(list_sum(list_transform({vec}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query(
    "blend_query",
    f"""WITH {UNIT_SQL},
m AS (
  SELECT q.vec_id, q.vec AS qv, CASE WHEN q.vec_id % 3 <> 0 AND c.vec IS NOT NULL
    THEN {_BLEND.format(q="q.vec", c="c.vec", w="0.2")} END AS mixed
  FROM unit q LEFT JOIN unit c ON c.vec_id = q.vec_id + 1),
u AS (SELECT vec_id, CASE WHEN mixed IS NULL THEN list_transform(qv, lambda x: CAST(x AS DOUBLE))
  ELSE list_transform(mixed, lambda x: x / n) END AS vec FROM (SELECT *, {_norm_sql("mixed")} AS n FROM m))
{_cells('u', 'vec_id', 'vec')}""",
)
def blend_query(spark, sf_dir):
    units = _units(spark, sf_dir)
    queries = units.select(F.col("internal_id").alias("query_id"), V.to_float32(F.col("vec")).alias("vec"))
    likes = units.select(
        (F.col("internal_id") - 1).alias("query_id"),
        F.when((F.col("internal_id") - 1) % 3 == 0, " \n").otherwise("remote work").alias("text"),
        "vec",
    )
    blended = search.blend_queries(queries, likes).withColumnRenamed("query_id", "vec_id")
    return vector_values(blended, "vec", "vec_id")


@query(
    "clamp_weight",
    """WITH w AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN ' 0.3 '
  WHEN 3 THEN '-1' WHEN 4 THEN 'nan' WHEN 5 THEN 'inf' WHEN 6 THEN '0.5d'
  ELSE '0.' || CAST(json_extract(props, '$.k') AS VARCHAR) END AS w FROM events)
SELECT event_id, greatest(0.0, least(1.0, coalesce(TRY_CAST(w AS DOUBLE), CAST(0.2 AS DOUBLE)))) AS weight FROM w""",
)
def clamp_weight(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        V.clamp_weight(
            F.expr(
                """case event_id % 8 when 0 then 'x' when 1 then null when 2 then ' 0.3 ' when 3 then '-1'
                   when 4 then 'nan' when 5 then 'inf' when 6 then '0.5d'
                   else concat('0.', get_json_object(props, '$.k')) end"""
            )
        ).alias("weight"),
    )


_DOT = """list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"""


def _first(units):
    return units.filter("internal_id = 0").select(F.col("internal_id").alias("query_id"), "vec")


@query(
    "inner_product",
    f"""WITH {UNIT_SQL} SELECT c.vec_id AS internal_id, round({_DOT.format(a="c.vec", b="q.vec")}, 6) + 0.0 AS score
FROM unit c, unit q WHERE q.vec_id = 0""",
)
def inner_product(spark, sf_dir):
    units = _units(spark, sf_dir)
    scored = search.score_all(units, _first(units))
    return scored.select("internal_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def _top_sql(where: str, k: int, query_where: str = "q.vec_id = 0") -> str:
    return f"""WITH {UNIT_SQL},
s AS (SELECT q.vec_id AS query_id, c.vec_id AS internal_id, round({_DOT.format(a="c.vec", b="q.vec")}, 9) AS score
  FROM unit c, unit q WHERE {query_where} AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, internal_id) AS rank FROM s)
SELECT query_id, rank, internal_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {k}"""


def _rounded(rows, *keys):
    return rows.select(*keys, (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("topk_search", f"SELECT rank, internal_id, score FROM ({_top_sql('true', TOP_K)})")
def topk_search(spark, sf_dir):
    units = _units(spark, sf_dir)
    return _rounded(search.topk(units, _first(units), TOP_K), "rank", "internal_id")


@query("topk_short", f"SELECT rank, internal_id, score FROM ({_top_sql('true', 100000)})")
def topk_short(spark, sf_dir):
    """More neighbours asked for than there are: all come back and none is padding."""
    units = _units(spark, sf_dir)
    return _rounded(search.topk(units, _first(units), 100_000), "rank", "internal_id")


@query("prefilter_match", f"SELECT rank, internal_id, score FROM ({_top_sql('c.label = 3', TOP_K)})")
def prefilter_match(spark, sf_dir):
    units = _units(spark, sf_dir)
    return _rounded(search.topk(units.filter("label = 3"), _first(units), TOP_K), "rank", "internal_id")


@query("match_batch", _top_sql("true", TOP_K, "q.vec_id % 50 = 0"))
def match_batch(spark, sf_dir):
    """Every fiftieth vector is a query, against all vectors."""
    units = _units(spark, sf_dir)
    queries = units.filter("internal_id % 50 = 0").select(F.col("internal_id").alias("query_id"), "vec")
    found = search.topk_many(spread(units.select("internal_id", "vec")), queries, TOP_K)
    return _rounded(found, "query_id", "rank", "internal_id")


@query("match_cells", _top_sql("true", TOP_K, "q.vec_id % 50 = 0"))
def match_cells(spark, sf_dir):
    """As ``match_batch``, over an index in cells of which those are left out that cannot win."""
    units = _units(spark, sf_dir)
    prefix = scratch_path(spark, "cells")
    cells.write_cells(units.select("internal_id", "vec"), prefix)
    queries = units.filter("internal_id % 50 = 0").select(F.col("internal_id").alias("query_id"), "vec")
    return _rounded(cells.search_cells(spark, prefix, queries, TOP_K), "query_id", "rank", "internal_id")


MATCH_SQL = f"""WITH {UNIT_SQL},
m AS (SELECT {_BLEND.format(q="q.vec", c="c.vec", w="0.2")} AS mixed FROM unit q, unit c
  WHERE q.vec_id = 0 AND c.vec_id = 1),
u AS (SELECT list_transform(mixed, lambda x: x / n) AS vec FROM (SELECT *, {_norm_sql("mixed")} AS n FROM m)),
s AS (SELECT c.vec_id, round({_DOT.format(a="c.vec", b="u.vec")}, 9) AS score FROM unit c, u),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT rank, coalesce('job-' || CAST(doc_id AS VARCHAR), CAST(vec_id AS VARCHAR)) AS job_id, round(score, 6) + 0.0 AS score
FROM r LEFT JOIN labels ON vec_id = doc_id WHERE rank <= {TOP_K}"""


@query("match_documents", MATCH_SQL)
def match_documents(spark, sf_dir):
    """Query vector 0 with preference vector 1, top 4, ids mapped: the flagship."""
    units = _units(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("internal_id"), F.concat(F.lit("job-"), "doc_id").alias("job_id")
    )
    likes = units.filter("internal_id = 1").select(
        (F.col("internal_id") - 1).alias("query_id"), F.lit("near home").alias("text"), "vec"
    )
    index = units.select("internal_id", "vec")
    return _rounded(matching.match(index, _first(units), TOP_K, likes, ids=known), "rank", "job_id")


@query(
    "build_index",
    f"""WITH {fx.JOBS_SQL}, {TEXT_SQL}, {_hash_sql('v', 'texts', 'seq')}
SELECT row_number() OVER (PARTITION BY pos ORDER BY k) - 1 AS internal_id, CAST(k AS VARCHAR) AS job_id, pos,
  round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value, 'hashing-{DIM}' AS model_name,
  (SELECT COUNT(*) FROM texts) AS num_vectors, CAST({DIM} AS BIGINT) AS dim FROM v""",
)
def build_index(spark, sf_dir):
    prefix = scratch_path(spark, "jobs-index")
    matching.vectorize_postings(fx.jobs(spark, sf_dir), prefix, "documents", ["seq"])
    index, meta = vector_store.load_index(spark, prefix)
    known = [meta.select(c).scalar().alias(c) for c in ("model_name", "num_vectors", "dim")]
    return vector_values(index, "vec", "internal_id", "job_id").select("*", *known)


def _earlier(jobs):
    """The postings as an earlier run saw them: some are not there yet, some had another text, some are gone by now."""
    number = F.col("seq")
    title = F.when(number % 10 == 4, F.concat(F.lit("Earlier "), "id")).otherwise(F.col("title"))
    gone = jobs.filter(number % 25 == 7).withColumn("id", F.concat(F.lit("old-"), "id")).withColumn("seq", number + 0)
    return jobs.filter(number % 10 != 3).withColumn("title", title).unionByName(gone)


_REFRESHED_SQL = f"""WITH {fx.JOBS_SQL}, {TEXT_SQL}, {_hash_sql('v', 'texts', 'seq')}
SELECT row_number() OVER (PARTITION BY pos ORDER BY k) - 1 AS internal_id, CAST(k AS VARCHAR) AS job_id, pos,
  round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM v"""


@query("refresh_index", _REFRESHED_SQL)
def refresh_index(spark, sf_dir):
    """An index of earlier postings, brought up to all postings: it equals a full build."""
    prefix = scratch_path(spark, "refreshed-index")
    jobs = fx.jobs(spark, sf_dir)
    matching.vectorize_postings(_earlier(jobs), prefix, "documents", ["seq"])
    matching.refresh_index(jobs, prefix, "documents", ["seq"])
    return vector_values(vector_store.load_index(spark, prefix)[0], "vec", "internal_id", "job_id")


@query(
    "index_changes",
    f"""WITH {fx.JOBS_SQL}
SELECT id AS job_id, CASE WHEN seq % 10 = 3 THEN 'added' WHEN seq % 10 = 4 THEN 'changed' ELSE 'same' END AS change FROM jobs
UNION ALL SELECT 'old-' || id, 'gone' FROM jobs WHERE seq % 25 = 7""",
)
def index_changes(spark, sf_dir):
    """What a second run of the index finds added, changed, gone and unchanged."""
    prefix = scratch_path(spark, "changed-index")
    jobs = fx.jobs(spark, sf_dir)
    matching.vectorize_postings(_earlier(jobs), prefix, "documents", ["seq"])
    return matching.refresh_index(jobs, prefix, "documents", ["seq"])


_PAY = """case {n} % 6 when 0 then concat('From 2024 on $', 20 + {n} % 15, ' - $', 30 + {n} % 15, '.50 per hour')
  when 1 then concat('CAD ', 60 + {n} % 9, ',000 to ', 75 + {n} % 9, ',000 a year') when 2 then concat('€', 45 + {n} % 7, '-', 55 + {n} % 7, 'k annually')
  when 3 then concat('We pay USD ', 3000 + {n} % 4000, ' per month') when 4 then 'Competitive' end"""
_RULES = [
    ("location", "in", "City 3"), ("location", "in", "city 8 "), ("location", "in", "city 12"), ("location", "not_in", "City 8"),
    ("title", "any_word", "EN"), ("title", "any_word", "fr"), ("title", "no_word", "src1"),
    ("pay", "currency", "usd"), ("pay", "at_least", "60000"), ("pay", "at_most", "90000"),
]


@query(
    "prefilter_postings",
    f"""WITH {fx.JOBS_SQL}, {TEXT_SQL}, {_hash_sql('v', 'texts', 'seq')}, {_hash_sql('b', 'benchmark', 'item_id')},
titled AS (SELECT *, coalesce(nullif(title, ''), d_job_title) AS t,
  CASE seq % 6 WHEN 0 THEN (20 + seq % 15) * 2080 WHEN 3 THEN (3000 + seq % 4000) * 12 END AS low,
  CASE seq % 6 WHEN 0 THEN (30.5 + seq % 15) * 2080 WHEN 3 THEN (3000 + seq % 4000) * 12 END AS high FROM jobs),
kept AS (SELECT seq FROM titled WHERE city IN ('City 3', 'City 12') AND low <= 90000 AND high >= 60000
  AND (' ' || lower(t) || ' ' LIKE '% en %' OR ' ' || lower(t) || ' ' LIKE '% fr %') AND NOT ' ' || lower(t) || ' ' LIKE '% src1 %'),
s AS (SELECT v.k AS seq, round(SUM(b.value * CAST(CAST(v.value AS FLOAT) AS DOUBLE)), 9) AS score
  FROM b JOIN v USING (pos) JOIN kept ON v.k = kept.seq WHERE b.k = (SELECT min(item_id) FROM benchmark) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM s)
SELECT rank, CAST(seq AS VARCHAR) AS job_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10""",
)
def prefilter_postings(spark, sf_dir):
    """Postings that meet the rules on location, title and pay, the best ten of them for a text."""
    prefix = scratch_path(spark, "filtered-index")
    jobs = prefilter.with_filter_columns(fx.jobs(spark, sf_dir), F.expr(_PAY.format(n="seq")))
    matching.vectorize_postings(jobs, prefix, "documents", ["seq"], keep=prefilter.FILTER_COLUMNS)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    query_row = search.encode(items.orderBy("query_id").limit(1), "text")
    rules = spark.createDataFrame(_RULES, "field string, test string, value string")
    return _rounded(matching.match_where(vector_store.load_index(spark, prefix)[0], query_row, rules, 10), "rank", "job_id")


_MATCHED_SQL = f"""WITH {fx.JOBS_SQL}, {TEXT_SQL}, {_hash_sql('v', 'texts', 'seq')}, {_hash_sql('b', 'benchmark', 'item_id')},
s AS (SELECT b.k AS query_id, v.k AS seq, round(SUM(b.value * CAST(CAST(v.value AS FLOAT) AS DOUBLE)), 9) AS score
  FROM b JOIN v USING (pos) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM s)
SELECT query_id, rank, CAST(seq AS VARCHAR) AS job_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {TOP_K}"""


@query("match_postings", _MATCHED_SQL)
def match_postings(spark, sf_dir):
    """Text to text: every benchmark text against the index of all postings."""
    index = matching.index_postings(fx.jobs(spark, sf_dir), ["seq"])
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = search.encode(items, "text").select("query_id", "vec")
    return _rounded(matching.match_many(index, queries, TOP_K), "query_id", "rank", "job_id")


@query("match_files", _MATCHED_SQL)
def match_files(spark, sf_dir):
    """File to posting: every benchmark text as a file against the written index of all postings."""
    folder, prefix = scratch_path(spark, "wishes"), scratch_path(spark, "wishes-index")
    items = table(spark, sf_dir, "benchmark")
    names = F.concat(F.col("item_id").cast("string"), F.lit(".txt"))
    generated.write_files(items.select(names.alias("name"), F.col("text").alias("body")), folder)
    matching.vectorize_postings(fx.jobs(spark, sf_dir), prefix, "documents", ["seq"])
    found = matching.match_files(spark, f"{folder}/*.txt", prefix, TOP_K)
    item = F.regexp_extract("query_id", r"([0-9]+)\.txt$", 1).cast("bigint")
    return _rounded(found.withColumn("query_id", item), "query_id", "rank", "job_id")
