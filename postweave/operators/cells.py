"""Exact top-k search that leaves out what cannot win: vectors grouped around pivots.

Each vector lies in the cell of the pivot that is nearest by angle, and a cell knows its widest angle and the lengths
of its vectors. For a query at angle a from a pivot, no vector of that cell is nearer than a less the widest angle, which
bounds every score in the cell. A search first reads, for each query, the cells with the best bounds that hold k rows; the
k-th score found there is the bar. Of the other cells only those are read whose bound reaches some query's bar. Cells
are folders of the table, so those left out are not opened. The result is that of a search over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.operators.search import BROADCAST_LIMIT, _matrix, topk_many
from postweave.session import cut_lineage

PIVOTS = 256
BOUNDS_LIMIT = 1 << 24  # queries times cells whose bounds the driver works out
NO_PIVOT = -1  # the cell of vectors of length zero, which have no angle
_SLACK = 1e-6  # for the rounding of stored vectors and scores


def write_cells(index: DataFrame, prefix: str, pivots: int = PIVOTS) -> None:
    """Write ``index (internal_id, .., vec)`` in cells under ``prefix``; rows without a vector are left out.

    The pivots are ``pivots`` rows of the index, or as many as the square root of its size, by the hash of their id.
    """
    rows = index.filter(F.col("vec").isNotNull())
    wanted = max(1, min(pivots, round(rows.count() ** 0.5)))
    chosen = rows.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("internal_id"), "internal_id").limit(wanted).select("vec").toArrow()
    matrix = _unit(_matrix(chosen.column("vec").combine_chunks()))  # of a bounded number of rows
    shared = index.sparkSession.sparkContext.broadcast(matrix)

    @F.arrow_udf("struct<cell: int, angle: double, length: double>")
    def nearest(vecs: pa.Array) -> pa.Array:
        found = _matrix(vecs)
        lengths = np.linalg.norm(found, axis=1)
        cell, angle = np.full(len(found), NO_PIVOT, np.int32), np.zeros(len(found))
        if len(shared.value) and found.size:
            cosines = _unit(found) @ shared.value.T
            best = cosines.argmax(axis=1)
            cell = np.where(lengths > 0, best, NO_PIVOT).astype(np.int32)
            angle = np.arccos(np.clip(cosines[np.arange(len(found)), best], -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle), pa.array(lengths)], ["cell", "angle", "length"])

    placed = rows.withColumn("_place", nearest(F.col("vec")))
    flat = placed.select(*rows.columns, F.col("_place.angle").alias("_angle"), F.col("_place.length").alias("_length"), F.col("_place.cell").alias("cell"))
    # cells together, large ones in several files
    flat.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{prefix}/cells")
    written = index.sparkSession.read.schema(flat.schema).parquet(f"{prefix}/cells")
    cells = written.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("_angle").alias("angle"), F.max("_length").alias("longest"), F.min("_length").alias("shortest")
    )
    by_cell = {r["cell"]: r for r in cells.toArrow().to_pylist()}  # a row for each pivot at most
    known = [(c, r["n"], r["angle"], r["longest"], r["shortest"], matrix[c].tolist() if c >= 0 else None) for c, r in by_cell.items()]
    schema = "cell int, n long, angle double, longest double, shortest double, pivot array<double>"
    index.sparkSession.createDataFrame(known, schema).coalesce(1).write.mode("overwrite").parquet(f"{prefix}/pivots")


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True) if rows.size else np.ones((len(rows), 1))
    return rows / np.where(lengths == 0, 1.0, lengths)


def bounds(queries: np.ndarray, cells: list) -> np.ndarray:
    """No score of a query (row) in a cell (column) is above this."""
    out = np.zeros((len(queries), len(cells)))
    lengths = np.linalg.norm(queries, axis=1)
    units = _unit(queries)
    for i, cell in enumerate(cells):
        if cell["pivot"] is None:
            continue  # vectors of length zero score zero
        to_pivot = np.arccos(np.clip(units @ np.array(cell["pivot"]), -1, 1))
        best = np.cos(np.maximum(0, to_pivot - cell["angle"]))
        out[:, i] = lengths * best * np.where(best > 0, cell["longest"], cell["shortest"])
    return out + _SLACK


def search_cells(
    spark: SparkSession, prefix: str, queries: DataFrame, k: int, key: str = "internal_id", query_key: str = "query_id", report: dict | None = None
) -> DataFrame:
    """The rows of :func:`topk_many` over all vectors in cells. ``report`` is told how many cells there are and were read.

    Too many queries for bounds on the driver are searched in all cells.
    """
    cells = sorted(spark.read.parquet(f"{prefix}/pivots").toArrow().to_pylist(), key=lambda c: c["cell"])
    corpus = spark.read.parquet(f"{prefix}/cells") if cells else None
    queries = cut_lineage(queries.select(query_key, "vec").filter(F.col("vec").isNotNull()))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec") * 8), F.lit(0)).alias("bytes")).first()
    if corpus is None:
        return queries.select(query_key, F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0.0).alias("score")).limit(0)
    if not size.n or size.n * len(cells) > BOUNDS_LIMIT or size.bytes > BROADCAST_LIMIT:
        return topk_many(corpus, queries, k, key, query_key)
    found = queries.toArrow()  # of a checked size
    ids = found.column(query_key).to_pylist()
    above = bounds(_matrix(found.column("vec").cast(pa.list_(pa.float64())).combine_chunks()), cells)
    order = np.argsort(-above, axis=1, kind="stable")
    counts = np.array([c["n"] for c in cells])
    # the cells with the best bounds that hold k rows, for each query
    enough = np.cumsum(counts[order], axis=1) - counts[order] < k
    first = np.zeros(len(cells), bool)
    first[np.unique(order[enough])] = True
    near = cut_lineage(topk_many(_of(corpus, cells, first), queries, k, key, query_key))
    bars = {r[query_key]: r["bar"] for r in near.filter(F.col("rank") == k).select(query_key, F.col("score").alias("bar")).toArrow().to_pylist()}
    bar = np.array([bars.get(i, -np.inf) for i in ids])
    second = (above >= bar[:, None]).any(axis=0) & ~first
    if report is not None:
        report.update(cells=len(cells), read=int(first.sum() + second.sum()))
    if not second.any():
        return near
    far = topk_many(_of(corpus, cells, second), queries, k, key, query_key)
    best = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    both = near.unionByName(far).withColumn("rank", F.row_number().over(best).cast("bigint"))
    return both.filter(F.col("rank") <= k)


def _of(corpus: DataFrame, cells: list, chosen: np.ndarray) -> DataFrame:
    return corpus.filter(F.col("cell").isin([cells[i]["cell"] for i in np.flatnonzero(chosen)]))
