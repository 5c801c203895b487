"""Whole plans for collection: pages to postings, and one round that goes on from earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators import collect, markup
from postweave.operators.documents import FLAT_FIELDS
from postweave.operators.joins import thinned_keys

POSTING_COLUMNS = [*FLAT_FIELDS, "details", "status_tags", "error"]


def with_details(rows: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Add the details found on the page ``(id, html)`` of each posting; an error where there is none.

    Pages are parsed before the join: once each, however often a posting is listed, and spread as
    they are read.
    """
    joined = rows.join(markup.detail_records(detail_pages.select("id", "html")), "id", "left")
    missing = F.col("details").isNull() & F.col("error").isNull()
    return joined.withColumn("error", F.when(missing, "No detail page").otherwise(F.col("error")))


def postings_from_pages(list_pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Rows of the list pages with the details of their detail page."""
    return with_details(markup.list_rows_dispatch(markup.list_rows(list_pages)), detail_pages)


def collect_round(
    saved: DataFrame, list_pages: DataFrame, detail_pages: DataFrame, max_rows: int | None = None, strict: bool = False
) -> DataFrame:
    """Saved postings, then the listed ones that no earlier round collected successfully.

    ``list_pages``: ``(page_id, url, html)`` in the order of ``page_id``. Postings that failed
    before are tried again, so their ids repeat; the last version counts later on. Places (``seq``)
    and the cap are settled on the list rows, and only detail pages of new postings are parsed.
    """
    order = ["page_id", "row_no"]
    listed = markup.list_rows_dispatch(markup.list_rows(list_pages)).select(*order, *FLAT_FIELDS)
    new = collect.only_new(listed, collect.success_filter(saved), "id")
    if max_rows is not None:
        n_saved = saved.select(F.count("*").alias("n")).scalar()
        new = collect.within_cap(new, n_saved, max_rows, order, strict)
    placed = collect.placed_after(saved, new, order, "seq")  # checkpointed, so read twice below
    pages = detail_pages.join(thinned_keys(placed, "id"), "id", "left_semi")
    detailed = with_details(placed, pages).select(*POSTING_COLUMNS, "seq")
    kept = [c for c in saved.columns if c == "other_details"]  # of postings that were read from JSON
    return saved.select(*POSTING_COLUMNS, *kept, "seq").unionByName(detailed, allowMissingColumns=True)
