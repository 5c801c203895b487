"""Rules on location, title and pay that postings have to meet before any of them is scored.

The rules read flat columns that are stored with the index (``FILTER_COLUMNS``), so the scan prunes all others and
skips row groups by their statistics. Rules come as a table ``(field, test, value)``:

    location  in, not_in          a place, compared without case; several ``in`` rows: any of them
    title     any_word, no_word   a word; several ``any_word`` rows: any of them
    pay       currency            a code
    pay       at_least, at_most   an amount a year: the range has to reach it, or to begin below it
    pay       unknown             ``keep`` or ``drop`` (the default) for postings that say nothing about pay
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.functions.pay import with_pay
from postweave.functions.text import strip
from postweave.operators.flatten import detail, title_or_detail

FILTER_COLUMNS = ["location", "title_words", "pay_currency", "pay_yearly_low", "pay_yearly_high"]
TESTS = {"location": ("in", "not_in"), "title": ("any_word", "no_word"), "pay": ("currency", "at_least", "at_most", "unknown")}
MOST_RULES = 1000


def with_filter_columns(postings: DataFrame, pay: Column | None = None) -> DataFrame:
    """Add the columns that rules read. ``pay`` is the text about pay, by default the detail about compensation."""
    text = detail(F.col("details"), "compensation_and_benefits") if pay is None else pay
    paid = with_pay(postings.withColumn("_pay_text", text), F.col("_pay_text")).drop("_pay_text", "pay_low", "pay_high", "pay_unit")
    words = F.regexp_replace(F.lower(title_or_detail()), r"[^\p{L}\p{N}+#]+", " ")
    return paid.withColumns({"location": F.lower(strip(F.col("city"))), "title_words": F.concat(F.lit(" "), strip(words), F.lit(" "))})


def read_rules(rules: DataFrame) -> list[tuple[str, str, str]]:
    """The rules of a table, which has to be a small one."""
    found = [(r["field"], r["test"], r["value"]) for r in rules.select("field", "test", "value").limit(MOST_RULES + 1).toArrow().to_pylist()]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return found


def rule_predicate(rules: list[tuple[str, str, str]]) -> Column:
    """All rules as one condition on the filter columns; no rules let everything through."""
    values: dict[tuple[str, str], list[str]] = {}
    for field, test, value in rules:
        if test not in TESTS.get(field, ()) or value is None:
            raise ValueError(f"no such rule: {field} {test} {value}")
        values.setdefault((field, test), []).append(value)
    met: list[Column] = []
    for (field, test), given in values.items():
        low = sorted({v.strip().lower() for v in given})
        if field == "location":
            among = F.col("location").isin(low)
            met.append(among if test == "in" else F.coalesce(~among, F.lit(True)))
        elif field == "title":
            holds = reduce(lambda a, b: a | b, [F.contains("title_words", F.lit(f" {w} ")) for w in low])
            met.append(holds if test == "any_word" else F.coalesce(~holds, F.lit(True)))
        elif test != "unknown":
            met.append(_pay_rule(test, given, ("pay", "unknown"), values))
    return reduce(lambda a, b: a & b, met, F.lit(True))


def _pay_rule(test: str, given: list[str], key: tuple[str, str], values: dict) -> Column:
    if test == "currency":
        column, holds = "pay_currency", F.col("pay_currency").isin(sorted({v.strip().upper() for v in given}))
    elif test == "at_least":
        column, holds = "pay_yearly_high", F.col("pay_yearly_high") >= max(map(float, given))
    else:
        column, holds = "pay_yearly_low", F.col("pay_yearly_low") <= min(map(float, given))
    unknown = {v.strip().lower() for v in values.get(key, ["drop"])}
    if len(unknown) > 1 or not unknown <= {"keep", "drop"}:
        raise ValueError("unknown pay is either kept or dropped")
    return holds | F.col(column).isNull() if unknown == {"keep"} else holds


def prefilter(rows: DataFrame, rules: DataFrame | list[tuple[str, str, str]]) -> DataFrame:
    """Rows that meet all rules."""
    return rows.filter(rule_predicate(read_rules(rules) if isinstance(rules, DataFrame) else rules))
