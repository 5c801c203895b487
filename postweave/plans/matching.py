"""Whole plans: postings to an index, documents to matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.functions.vectors import clamp_weight, to_float32
from postweave.operators import search
from postweave.operators.collect import last_wins
from postweave.operators.flatten import with_posting_text
from postweave.operators.ordering import dense_ids
from postweave.operators.prefilter import prefilter
from postweave.session import cut_lineage
from postweave.sources import vector_store
from postweave.sources.postings import read_documents


def _settled(postings: DataFrame, order: list[str], drop_failed: bool, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The texts of all postings, written once with a row number, and the numbered last versions.

    Texts: ``_row, text``. Versions: ``internal_id, job_id, _row, text_hash`` and the columns to keep, settled and numbered on their keys
    alone. Rows with one key and one order are told apart by the row number; postings without an id all stay.
    """
    spark = postings.sparkSession
    rows = with_posting_text(postings, drop_failed).select(
        F.monotonically_increasing_id().alias("_row"), F.col("id").cast("string").alias("_id"),
        *[F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)], "text", F.md5("text").alias("text_hash"), *keep,
    )
    texts = cut_lineage(rows)
    places = [c for c in texts.columns if c.startswith("_order_")]
    keys = texts.drop("text")
    version_key = F.coalesce("_id", F.concat(F.lit("no id\x01"), F.col("_row").cast("string")))
    latest = last_wins(keys.withColumn("_key", version_key), "_key", [*places, "_row"])
    numbered = dense_ids(latest.drop("_key"), *places, "_row")
    job_id = F.coalesce("_id", F.col("internal_id").cast("string"))
    return texts.select("_row", "text"), numbered.select("internal_id", job_id.alias("job_id"), "_row", "text_hash", *keep)


def index_postings(
    postings: DataFrame, order: list[str], encoder=None, batch_size: int = search.ENCODE_BATCH, drop_failed: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Last version of each posting, flattened, encoded and numbered: ``internal_id, job_id, vec, text_hash``.

    ``keep``: flat columns that the index is to hold as well, such as those that rules read.

    Versions are settled and numbered on their keys alone. The texts cross the network once, to
    meet their number, and only texts that stay are encoded. Where ``order`` repeats or is null, rows
    still get one number each.
    """
    texts, numbered = _settled(postings, order, drop_failed, keep)
    encoded = search.encode(texts.join(numbered, "_row"), "text", encoder, batch_size)
    return encoded.select("internal_id", "job_id", to_float32(F.col("vec")).alias("vec"), "text_hash", *keep)


def vectorize_postings(
    postings: DataFrame, prefix: str, source: str, order: list[str], encoder=None, keep: Sequence[str] = ()
) -> DataFrame:
    """Build and write the index; returns its metadata."""
    model = encoder or search.HashingEncoder()
    return vector_store.save_index(index_postings(postings, order, model, keep=keep), prefix, model.name, source)


def refresh_index(
    postings: DataFrame, prefix: str, source: str, order: list[str], encoder=None, drop_failed: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Bring the index at ``prefix`` up to the given postings; returns the change of each posting: ``job_id, change``.

    Only texts whose hash the index does not hold reach the encoder, each distinct text once; other vectors are taken
    over by the hash. Postings that are not given any more go. The result is what a full build gives, as a new version
    beside the old one. An index of another model, or one without hashes, is built anew.
    """
    spark = postings.sparkSession
    model = encoder or search.HashingEncoder()
    old, meta = vector_store.load_index(spark, prefix)
    usable = meta.first().model_name == model.name and "text_hash" in old.columns
    texts, numbered = _settled(postings, order, drop_failed, keep)
    numbered = cut_lineage(numbered)
    held = old.select("text_hash", "vec") if usable else old.select(F.lit("").alias("text_hash"), "vec").limit(0)
    held = held.dropDuplicates(["text_hash"])
    missing = numbered.groupBy("text_hash").agg(F.min("_row").alias("_row"))  # one row of each text
    missing = missing.join(held.select("text_hash"), "text_hash", "left_anti")
    fresh = search.encode(texts.join(missing, "_row"), "text", model).select("text_hash", to_float32(F.col("vec")).alias("vec"))
    fresh = cut_lineage(fresh)  # encoded once
    # copies of one text may be many, and the exchanges of this join stand alone, so a hot hash is split
    index = numbered.drop("_row").join(held.unionByName(fresh), "text_hash")
    vector_store.save_version(index.select("internal_id", "job_id", "vec", "text_hash", *keep), prefix, model.name, source)
    return index_changes(old, vector_store.load_index(spark, prefix)[0])


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``job_id, change`` between two versions: ``added``, ``changed``, ``gone`` or ``same``; vectors are not read."""
    known = F.col("text_hash") if "text_hash" in before.columns else F.lit(None).cast("string")
    old = before.select("job_id", known.alias("_old"), F.lit(True).alias("_was"))
    new = after.select("job_id", "text_hash", F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "gone")
        .when(F.col("_old").eqNullSafe(F.col("text_hash")), "same").otherwise("changed")
    )
    return old.join(new, "job_id", "full").select("job_id", change.alias("change"))


def match(
    index: DataFrame,
    query: DataFrame,
    k: int = search.DEFAULT_TOP_K,
    preferences: DataFrame | None = None,
    weight: Column | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Matches of one query vector: ``rank, job_id, score``. ``query``: one row ``(query_id, vec)``.

    ``ids``: ``(internal_id, job_id)`` when the index does not hold the posting ids itself. They
    meet the k best rows only; a match without a known id is named by its internal id.
    """
    units = search.l2_normalize(query, "vec")
    if preferences is not None:
        units = search.blend_queries(units, search.l2_normalize(preferences, "vec"), weight=weight)
    best = search.topk(index, units, k)
    known = index.select("internal_id", "job_id") if ids is None else ids
    return (search.map_few_ids if k <= search.SMALL_TOP_K else search.map_ids)(best, known).select("rank", "job_id", "score").orderBy("rank")


def match_where(
    index: DataFrame, query: DataFrame, rules: DataFrame | list[tuple[str, str, str]], k: int = search.DEFAULT_TOP_K, **options
) -> DataFrame:
    """Matches among the postings that meet the rules; the index has to hold ``FILTER_COLUMNS``."""
    return match(prefilter(index, rules), query, k, **options)


def match_many(index: DataFrame, queries: DataFrame, k: int = search.DEFAULT_TOP_K) -> DataFrame:
    """Matches of many query vectors: ``query_id, rank, job_id, score``."""
    best = search.topk_many(index, search.l2_normalize(queries, "vec"), k)
    ids = index.select("internal_id", "job_id")
    return best.join(ids, "internal_id").select("query_id", "rank", "job_id", "score")


def match_files(
    spark: SparkSession,
    documents: str,
    prefix: str,
    k: int = search.DEFAULT_TOP_K,
    preferences: str | None = None,
    weight: str | None = None,
    encoder=None,
) -> DataFrame:
    """Matches of each document file: ``query_id`` (its path), ``rank, job_id, score``.

    ``preferences``: one file whose text is blended in, unless it is missing or blank. The index
    must come from the same encoder.
    """
    model = encoder or search.HashingEncoder()
    index, meta = vector_store.load_index(spark, prefix)
    texts = read_documents(spark, documents).withColumnRenamed("path", "query_id")
    queries = cut_lineage(search.encode(texts, "text", model).select("query_id", "vec"))  # encoded once
    sample = queries.select(F.size("vec").alias("dim")).first()
    vector_store.check_model(meta, model.name, sample.dim if sample else meta.first().dim)
    likes = None if preferences is None else _read_if_there(spark, preferences)
    if likes is not None:
        likes = search.encode(likes, "text", model)
        wanted = {c: likes.select(c).scalar() for c in ("text", "vec")}
        each = queries.select("query_id", *[v.alias(c) for c, v in wanted.items()])
        queries = search.blend_queries(queries, each, weight=clamp_weight(F.lit(weight).cast("string")))
    return match_many(index, queries, k)


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_documents(spark, path)
    except AnalysisException:
        return None
