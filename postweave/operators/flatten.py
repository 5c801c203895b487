"""Postings to one text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import is_truthy, or_else

# Field order, length limit and separator of the flattened text.
PRIORITY_FIELDS = [
    "job_summary",
    "job_responsibilities",
    "required_skills",
    "additional_information",
    "compensation_and_benefits",
    "targeted_degrees_and_disciplines",
]
MAX_RESIDUAL_CHARS = 2000
SEPARATOR = " \n "
FALSY_JSON = ["0", "0.0", "-0.0", "false", "[]", "{}"]


def other_details(postings: DataFrame) -> Column:
    """Details that are no strings, as JSON by key; null where the table has none."""
    if "other_details" in postings.columns:
        return F.col("other_details")
    return F.lit(None).cast("map<string,string>")


def detail(details: Column, key: str) -> Column:
    """Value of a detail key, null when absent (keys are unique, see ``merge_pairs_sql``)."""
    return F.get(F.filter(details, lambda d: d.key == key), F.lit(0)).getField("value")


def _known(details: Column, others: Column | None, key: str) -> Column:
    """The detail, or the JSON of one that is no string, unless that is false or empty."""
    if others is None:
        return detail(details, key)
    other = F.try_element_at(others, F.lit(key))
    return F.coalesce(detail(details, key), F.when(~other.isin(FALSY_JSON), other))


def title_or_detail(others: Column | None = None) -> Column:
    return or_else(F.col("title"), _known(F.col("details"), others, "job_title"))


def company_or_detail(others: Column | None = None) -> Column:
    return or_else(F.col("company"), _known(F.col("details"), others, "organization"))


def priority_values(details: Column, others: Column | None = None) -> Column:
    return F.filter(F.array(*[_known(details, others, k) for k in PRIORITY_FIELDS]), is_truthy)


def residual_values(details: Column) -> Column:
    """Other string values in page order, 1 to 2000 characters long."""
    left_out = ["job_title", *PRIORITY_FIELDS]
    kept = F.filter(
        details, lambda d: ~d.key.isin(left_out) & F.length(d.value).between(1, MAX_RESIDUAL_CHARS)
    )
    return F.transform(kept, lambda d: d.value)


def posting_text(others: Column | None = None) -> Column:
    """Title, company and details. Of ``others`` (JSON by key) the named fields count, the rest is no text."""
    details = F.col("details")
    heads = F.filter(F.array(title_or_detail(others), company_or_detail(others)), is_truthy)
    nothing = F.array().cast("array<string>")
    rest = F.concat(
        heads,
        F.coalesce(priority_values(details, others), nothing),
        F.coalesce(residual_values(details), nothing),
    )
    return F.array_join(rest, SEPARATOR)


def with_posting_text(postings: DataFrame, drop_failed: bool = False) -> DataFrame:
    rows = postings.filter(F.col("error").isNull()) if drop_failed else postings
    others = other_details(rows) if "other_details" in rows.columns else None
    return rows.withColumn("text", posting_text(others))
