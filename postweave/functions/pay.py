"""Pay texts to ranges, with built-in functions only.

``$25 - $30.50 per hour``, ``CAD 60,000 to 75,000 a year``, ``€45-55k`` and the like give a currency, a lowest and a
highest amount and a unit. Only a number beside a currency or before a unit word is pay; other numbers (a
year, a street) are passed over. Without a unit word an amount of 1,000 or more is yearly and a smaller one hourly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Currency marks, unit words, and how many of a unit a year of 40-hour weeks has.
CURRENCIES = {"US$": "USD", "CA$": "CAD", "C$": "CAD", "$": "USD", "€": "EUR", "£": "GBP", "USD": "USD", "CAD": "CAD", "EUR": "EUR", "GBP": "GBP"}
UNITS = {
    "hourly": "hour", "hour": "hour", "hr": "hour", "h": "hour", "daily": "day", "day": "day", "weekly": "week", "week": "week",
    "monthly": "month", "month": "month", "annually": "year", "annum": "year", "yearly": "year", "year": "year", "yr": "year",
}
A_YEAR = {"hour": 2080, "day": 260, "week": 52, "month": 12, "year": 1}

_AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?)\b"
_MARK = "(" + "|".join(m.replace("$", r"\$") for m in CURRENCIES) + ")"
_UNIT = r"(?:\s*(?:(?i:per|an?)\s|/)?\s*(?i:(" + "|".join(UNITS) + r")\b))"
_RANGE = rf"{_AMOUNT}(?:(?:\s?{_MARK})?\s*(?:-|–|to)\s*(?:{_MARK}\s?)?{_AMOUNT})?"
_PAY = rf"(?:{_MARK}\s?)?{_RANGE}(?:\s?{_MARK})?{_UNIT}?"  # groups: mark, low, k, mark, mark, high, k, mark, unit
_FIRST = rf"{_MARK}\s?{_RANGE}{_UNIT}?|{_RANGE}(?:\s?{_MARK}{_UNIT}?|{_UNIT})"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def with_pay(rows: DataFrame, text: Column, prefix: str = "pay_") -> DataFrame:
    """Add ``currency, low, high, unit, yearly_low, yearly_high`` of the first pay in a text, all null where there is none.

    Step by step, so that each pattern is matched once a row.
    """
    step = rows.withColumn("_pay", F.regexp_extract(text, _FIRST, 0))
    groups = {f"_pay{i}": F.nullif(F.regexp_extract("_pay", _PAY, i), F.lit("")) for i in range(1, 10)}
    step = step.withColumns(groups)
    plain = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).cast("double")
    step = step.withColumns({"_low": plain("_pay2"), "_high": plain("_pay6")})
    # of 45-55k both are thousands
    low_in_thousands = F.col("_pay3").isNotNull() | (F.col("_pay7").isNotNull() & (F.col("_low") < F.col("_high")))
    step = step.withColumns(
        {
            "_low": F.when(low_in_thousands, F.col("_low") * 1000).otherwise(F.col("_low")),
            "_high": F.when(F.col("_pay7").isNotNull(), F.col("_high") * 1000).otherwise(F.col("_high")),
        }
    )
    unit = F.coalesce(F.try_element_at(_table(UNITS), F.lower("_pay9")), F.when(F.col("_low") >= 1000, "year").when(F.col("_low") < 1000, "hour"))
    step = step.withColumns({f"{prefix}unit": unit, "_high": F.coalesce("_high", "_low")})
    a_year = F.try_element_at(_table(A_YEAR), F.col(f"{prefix}unit"))
    found = step.withColumns(
        {
            f"{prefix}currency": F.try_element_at(_table(CURRENCIES), F.coalesce("_pay1", "_pay4", "_pay5", "_pay8")),
            f"{prefix}low": F.least("_low", "_high"), f"{prefix}high": F.greatest("_low", "_high"),
            f"{prefix}yearly_low": F.least("_low", "_high") * a_year, f"{prefix}yearly_high": F.greatest("_low", "_high") * a_year,
        }
    )
    names = [f"{prefix}{n}" for n in ("currency", "low", "high", "unit", "yearly_low", "yearly_high")]
    return found.select(*rows.columns, *names)
