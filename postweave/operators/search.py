"""Vectors, the exact inner-product index and top-k search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.functions import vectors as V
from postweave.functions.text import strip
from postweave.operators.ordering import dense_ids
from postweave.session import cut_lineage

# Fixed values.
DEFAULT_TOP_K = 10
ENCODE_BATCH = 64
SCORE_DECIMALS = 9  # scores this close are ties, broken by id; sums in another order stay equal

SMALL_TOP_K = 100_000  # rows that one task may merge
BROADCAST_LIMIT = 64 << 20  # bytes of query vectors that may be sent to every executor
PART_LIMIT = 256 << 20  # bytes of corpus vectors that meet one slice of the queries in one task
CANDIDATE_LIMIT = 1 << 24  # rows (queries times k) that one task may hold
BLOCK_BYTES = 1 << 20  # bytes of one packed block of vectors
CANDIDATES_HELD = 1 << 18  # rows of candidates before a task cuts them back, or four times what stays
SCORES_AT_ONCE = 1 << 20  # scores that a task holds
KNOWN_TOKENS = 1 << 17  # tokens whose places a worker remembers

Encoder = Callable[[list[str]], np.ndarray]


# ---- encoding ------------------------------------------------------------------------------


class _TokenPlaces(dict):
    """Token to ``2 * bucket + (1 for a negative sign)``, worked out when first seen."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        digest = hashlib.md5(token.encode()).hexdigest()
        place = self[token] = 2 * (int(digest[:4], 16) % self.dim) + int(digest[4], 16) % 2
        return place


class HashingEncoder:
    """Signed feature hashing: the offline stand-in for a neural encoder.

    Tokens ``[a-z0-9]+`` of the lower-cased text; bucket from the first four hex digits of the
    token's md5, sign from the parity of the fifth.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashing-{dim}"
        self.places = _TokenPlaces(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            tokens = re.findall("[a-z0-9]+", text.lower())
            places = np.fromiter(map(self.places.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            counts = np.bincount(places, minlength=2 * self.dim)
            out[row] = counts[0::2] - counts[1::2]
        return out


def encode(
    df: DataFrame, text: str, encoder: Encoder | None = None, batch_size: int = ENCODE_BATCH, out: str = "vec"
) -> DataFrame:
    """Add the unit vector of a text column: a map-only stage, ``batch_size`` texts per call."""
    model = encoder or HashingEncoder()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            groups = (batch.slice(i, batch_size).to_pylist() for i in range(0, len(batch), batch_size))
            parts = [_unit_rows(model([t or "" for t in group])) for group in groups]
            yield _list_array(np.concatenate(parts) if parts else np.zeros((0, 1)))

    # Called non-deterministic so that no filter or generator makes the optimizer run it twice.
    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _list_array(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as one list array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def l2_normalize(df: DataFrame, vec: str, out: str = "vec") -> DataFrame:
    """Scale to unit length; a zero vector stays zero."""
    return df.withColumn(out, V.unit(F.col(vec)))


def blend_queries(
    queries: DataFrame, preferences: DataFrame, key: str = "query_id", weight: Column | None = None
) -> DataFrame:
    """Mix each query vector with its preference vector, if the preference text is not blank.

    ``preferences``: ``(key, text, vec)``, one row per query at most.
    """
    w = weight if weight is not None else F.lit(V.DEFAULT_WEIGHT)
    usable = preferences.filter(strip(F.col("text")) != "").select(key, F.col("vec").alias("_pref"))
    mixed = queries.join(usable, key, "left").withColumn(
        "_mixed", F.when(F.col("_pref").isNotNull(), V.blend(F.col("vec"), F.col("_pref"), w))
    )
    normed = l2_normalize(mixed, "_mixed", "_unit")
    return normed.withColumn("vec", F.coalesce("_unit", "vec")).drop("_pref", "_mixed", "_unit")


# ---- index ---------------------------------------------------------------------------------


def map_ids(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Add ``job_id`` from ``id_map (internal_id, job_id)``; the internal id where none is known."""
    joined = rows.join(id_map, "internal_id", "left")
    return joined.withColumn("job_id", F.coalesce("job_id", F.col("internal_id").cast("string")))


def map_few_ids(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """As :func:`map_ids` for rows of a known small number (the k best): they are written once, the map stays where
    it is, and only what its tasks find for these rows is joined."""
    rows = cut_lineage(rows)
    found = id_map.join(F.broadcast(rows.select("internal_id")), "internal_id", "left_semi")
    return map_ids(rows, F.broadcast(found))


def vector_profile(index: DataFrame, vec: str = "vec") -> DataFrame:
    """Count and dimension; ``min_dim`` differs from ``max_dim`` when sizes are mixed."""
    size = F.size(vec).cast("bigint")
    return index.agg(
        F.count("*").alias("num_vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    )


def build_index(rows: DataFrame, vec: str, job_id: Column, *order: str) -> DataFrame:
    """Index table ``(internal_id, job_id, vec float32 unit)`` numbered in the given order.

    The vectors are written once, so that a model behind them runs once a row, and cross the network once, in the
    exchange that numbers them. Rows whose order columns repeat get numbers of their own, in no defined order among them.
    """
    units = l2_normalize(rows, vec, "vec")
    keys = {c: f"_order_{i}" for i, c in enumerate(order)}
    slim = units.select(*[F.col(c).alias(k) for c, k in keys.items()], job_id.alias("job_id"), V.to_float32(F.col("vec")).alias("vec"))
    numbered = dense_ids(cut_lineage(slim), *keys.values())
    internal = F.col("internal_id").cast("string")
    return numbered.select("internal_id", F.coalesce("job_id", internal).alias("job_id"), "vec")


# ---- search --------------------------------------------------------------------------------


def score_all(corpus: DataFrame, query: DataFrame) -> DataFrame:
    """Add ``score``: the inner product with the one row of ``query`` (a scalar subquery)."""
    with_query = corpus.withColumn("_query", query.select("vec").scalar())
    return with_query.withColumn("score", V.dot(F.col("vec"), F.col("_query"))).drop("_query")


def topk(corpus: DataFrame, query: DataFrame, k: int = DEFAULT_TOP_K, key: str = "internal_id") -> DataFrame:
    """Top-k rows for one query: each task keeps k rows, one merge gives ``rank, key, score``."""
    scored = score_all(corpus.select(key, "vec"), query)
    scored = scored.select(key, F.round("score", SCORE_DECIMALS).alias("score"))
    # a score is null without a vector or a query, and may be no number; both come last and go after the limit, so
    # that no filter repeats the product
    known = F.col("score").isNotNull() & ~F.isnan("score")
    if k > SMALL_TOP_K:  # too many for one merge: number all rows, best first
        placed = dense_ids(scored.filter(known).withColumn("_least", -F.col("score")), "_least", key, name="rank")
        return placed.filter(F.col("rank") < k).select((F.col("rank") + 1).alias("rank"), key, "score")
    order = [(-F.col("score")).asc_nulls_last(), F.col(key)]
    best = scored.orderBy(*order).limit(k)
    place = F.row_number().over(Window.orderBy(*order))  # k rows
    return best.select(place.cast("bigint").alias("rank"), key, "score").filter(known)


def topk_many(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    key: str = "internal_id",
    query_key: str = "query_id",
    broadcast_limit: int = BROADCAST_LIMIT,
    part_limit: int = PART_LIMIT,
    candidate_limit: int = CANDIDATE_LIMIT,
) -> DataFrame:
    """Top-k rows for every query: ``query_id, rank, key, score``.

    A query matrix whose size is checked goes to every executor and the corpus stays where it is;
    each task hands on k rows per query. Beyond the limit both sides travel as packed blocks
    that meet in matrix products, again with k rows per query handed on; a part holds
    ``part_limit`` bytes of the corpus. So they do where ``k`` rows for each query would be more than
    ``candidate_limit``: a task then holds the rows of some of the queries at a time. Rows without
    a vector match nothing.
    """
    types = [(c, d.schema[c].dataType.simpleString()) for c, d in ((query_key, queries), (key, corpus))]
    schema = ", ".join(f"{c} {t}" for c, t in types) + ", score double"
    names = [query_key, key, "score"]
    corpus = corpus.filter(F.col("vec").isNotNull())
    # written once, so that a model behind the vectors sees each query text once
    queries = cut_lineage(queries.select(query_key, "vec").filter(F.col("vec").isNotNull()))
    held = F.size("vec") * 8 + F.octet_length(F.col(query_key).cast("string"))
    total = queries.agg(F.coalesce(F.sum(held), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    slices = max(-(-total.bytes // broadcast_limit), min(total.rows, -(-total.rows * k // candidate_limit)))
    if slices <= 1:
        kernel = _topk_against(_collect_matrix(queries, query_key), k, names)
        partial = corpus.select(key, "vec").mapInArrow(kernel, schema)
    else:
        corpus_bytes = corpus.agg(F.sum(F.size("vec") * 8).alias("n")).first().n or 0
        parts = -(-corpus_bytes // part_limit)
        at_once = max(1, candidate_limit // max(1, k))
        pairs = _block_pairs(corpus.select(key, "vec"), queries, slices, parts, at_once)
        partial = pairs.mapInArrow(_topk_of_pairs(k, names), schema)
    best = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    ranked = partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(query_key, F.col("rank").cast("bigint").alias("rank"), key, "score")


def _matrix(vecs: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a double matrix."""
    if len(vecs) == 0:
        return np.zeros((0, 0))
    flat = np.asarray(vecs.flatten(), dtype=np.float64)
    if len(flat) % len(vecs) or len(set(np.diff(np.asarray(vecs.offsets)))) > 1:
        raise ValueError("vectors of different sizes in one table")
    return flat.reshape(len(vecs), -1)


class _Candidates:
    """The best rows seen so far per query, cut back to k whenever they pile up."""

    def __init__(self, k: int, names: list[str]):
        self.k, self.names = k, names
        self.parts: list[pd.DataFrame] = []
        self.rows, self.limit = 0, CANDIDATES_HELD

    def add(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Score every query against every row, some queries at a time, and keep the best."""
        by_id = np.argsort(ids, kind="stable")
        ids, columns = ids[by_id], rows[by_id].T
        tile = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for i in range(0, len(query_ids), tile):
            scores = np.round(queries[i : i + tile] @ columns, SCORE_DECIMALS)
            q, c = _best(scores, self.k)
            part = dict(zip(self.names, (query_ids[i : i + tile][q], ids[c], scores[q, c])))
            self.parts.append(pd.DataFrame(part))
            self.rows += len(q)
            if self.rows > self.limit:
                self.parts = [self.best()]
                self.rows = len(self.parts[0])
                self.limit = max(self.limit, 4 * self.rows)

    def best(self) -> pd.DataFrame:
        query, key, score = self.names
        rows = pd.concat(self.parts, ignore_index=True)
        rows = rows.sort_values([query, score, key], ascending=[True, False, True], kind="stable")
        return rows.groupby(query, sort=False).head(self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_pandas(self.best(), preserve_index=False)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best scores per row; columns come in id order for ties."""
    count, width = scores.shape
    if width <= k:
        return np.repeat(np.arange(count), width), np.tile(np.arange(width), count)
    picks = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    bar = np.take_along_axis(scores, picks, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= bar[:, None]).sum(axis=1) > k):  # the k-th score is shared
        above = np.flatnonzero(scores[row] > bar[row])
        equal = np.flatnonzero(scores[row] == bar[row])[: k - len(above)]
        picks[row] = np.concatenate([above, equal])
    return np.repeat(np.arange(count), k), picks.ravel()


def _collect_matrix(queries: DataFrame, query_key: str):
    """The checked query set as ``(ids, matrix)`` in a broadcast variable."""
    found = queries.select(F.col(query_key).alias("id"), F.col("vec").cast("array<double>").alias("vec")).toArrow()
    vecs = found.column("vec").combine_chunks()
    pair = (found.column("id").to_numpy(), _matrix(vecs))
    return queries.sparkSession.sparkContext.broadcast(pair)


def _topk_against(shared, k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        found = _Candidates(k, names)
        for batch in batches:
            if batch.num_rows and len(query_ids):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                found.add(query_ids, matrix, ids, _matrix(batch.column(1)))
        yield from found.batches()

    return run


def _block_pairs(
    corpus: DataFrame, queries: DataFrame, slices: int, least_parts: int = 1, queries_at_once: int | None = None
) -> DataFrame:
    """Packed corpus and query blocks joined on (slice, part).

    Each query block lies in one slice and is copied to every part; each corpus block lies in one
    part and is copied to every slice. Both are even by construction, so no key is hot. There are
    as many pairs (slice, part) as shuffle partitions, so queries are not copied more than needed,
    but never fewer parts than the size of the corpus asks for. A query block holds at most
    ``queries_at_once`` rows.
    """
    parts = max(1, least_parts, -(-int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")) // slices))
    q = _packed(queries, "q", queries_at_once).withColumn("slice", F.pmod(F.xxhash64("q_ids"), F.lit(slices)))
    c = _packed(corpus, "c").withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(parts)))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    c = c.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    return c.join(q, ["slice", "part"]).select("q_ids", "q_rows", "c_ids", "c_rows", "slice")


def _packed(rows: DataFrame, prefix: str, at_once: int | None = None) -> DataFrame:
    """Blocks of vectors: ``<prefix>_ids`` (array) and ``<prefix>_rows`` (doubles, row by row)."""
    key, vec = rows.columns
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column(0), _matrix(batch.column(1))
            step = max(1, BLOCK_BYTES // (8 * max(1, matrix.shape[1])))
            step = min(step, at_once or step)
            for i in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i : i + step].to_pylist()], pa.list_(ids.type)),
                        pa.array([np.ascontiguousarray(matrix[i : i + step]).tobytes()], pa.binary()),
                    ],
                    names=[f"{prefix}_ids", f"{prefix}_rows"],
                )

    return rows.mapInArrow(run, f"{prefix}_ids array<{key_type}>, {prefix}_rows binary")


def _topk_of_pairs(k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, current = _Candidates(k, names), None
        for batch in batches:
            for i in range(batch.num_rows):
                if (now := batch.column(4)[i].as_py()) != current:  # the queries of one slice at a time
                    yield from found.batches()
                    found, current = _Candidates(k, names), now
                query_ids, ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 2))
                queries, rows = (
                    np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1)
                    for c, n in ((1, query_ids), (3, ids))
                )
                found.add(query_ids, queries, ids, rows)
        yield from found.batches()

    return run
