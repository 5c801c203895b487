"""Search in cells equals search over all rows, and leaves cells out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.operators import cells, search


def vectors(spark, rows, name="internal_id"):
    made = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(made, f"{name} long, vec array<double>")


def same(found, expected):
    key = lambda df: sorted((r["query_id"], r["rank"], r["internal_id"], round(r["score"], 9)) for r in df.collect())
    return key(found) == key(expected)


def test_far_cells_are_not_read(spark, tmp_path):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    rows = centres[draw.integers(0, 12, 1500)] + draw.normal(scale=0.05, size=(1500, 16))
    corpus = vectors(spark, rows).repartition(3)
    cells.write_cells(corpus, str(tmp_path / "index"))
    queries = vectors(spark, centres[:3] + 0.01, "query_id")
    report = {}
    found = cells.search_cells(spark, str(tmp_path / "index"), queries, 5, report=report)
    assert same(found, search.topk_many(corpus, queries, 5))
    assert report["cells"] >= 20 and report["read"] < report["cells"] / 2


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_any_vectors(spark, tmp_path, k):
    draw = np.random.default_rng(k)
    rows = list(draw.normal(size=(300, 5)) * draw.uniform(0, 3, (300, 1))) + [[0] * 5] * 3 + [None] + [[1, 0, 0, 0, 0]] * 40
    corpus = vectors(spark, rows)
    cells.write_cells(corpus, str(tmp_path / "index"), pivots=9)
    queries = vectors(spark, [*draw.normal(size=(6, 5)), [0] * 5, [1, 0, 0, 0, 0], [-1, 0, 0, 0, 0], None], "query_id")
    assert same(cells.search_cells(spark, str(tmp_path / "index"), queries, k), search.topk_many(corpus, queries, k))


def test_no_rows_and_no_queries(spark, tmp_path):
    none = vectors(spark, [])
    cells.write_cells(none, str(tmp_path / "none"))
    some = vectors(spark, [[1, 0], [0, 1]])
    queries = some.select(F.col("internal_id").alias("query_id"), "vec")
    assert cells.search_cells(spark, str(tmp_path / "none"), queries, 3).collect() == []
    cells.write_cells(some, str(tmp_path / "some"))
    assert cells.search_cells(spark, str(tmp_path / "some"), queries.limit(0), 3).collect() == []
    assert cells.search_cells(spark, str(tmp_path / "some"), queries, 3).count() == 4


def test_too_many_queries_for_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BOUNDS_LIMIT", 3)
    draw = np.random.default_rng(9)
    corpus = vectors(spark, draw.normal(size=(100, 4)))
    cells.write_cells(corpus, str(tmp_path / "index"))
    queries = vectors(spark, draw.normal(size=(5, 4)), "query_id")
    assert same(cells.search_cells(spark, str(tmp_path / "index"), queries, 3), search.topk_many(corpus, queries, 3))
