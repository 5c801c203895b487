"""Pay texts, rules, and the scan that they reach."""

import pytest
from pyspark.sql import functions as F

from postweave.functions.pay import with_pay
from postweave.operators import prefilter, search
from postweave.plans import matching
from postweave.plans import fixtures as fx
from postweave.sources import vector_store

PAYS = [
    ("$25 - $30.50 per hour", ("USD", 25.0, 30.5, "hour", 52000.0, 63440.0)),
    ("Base pay: CAD 60,000 to 75,000 a year, plus bonus", ("CAD", 60000.0, 75000.0, "year", 60000.0, 75000.0)),
    ("€45-55k annually", ("EUR", 45000.0, 55000.0, "year", 45000.0, 55000.0)),
    ("In 2025 we pay C$4,000/month", ("CAD", 4000.0, 4000.0, "month", 48000.0, 48000.0)),
    ("£300 daily", ("GBP", 300.0, 300.0, "day", 78000.0, 78000.0)),
    ("80000 USD", ("USD", 80000.0, 80000.0, "year", 80000.0, 80000.0)),
    ("$22", ("USD", 22.0, 22.0, "hour", 45760.0, 45760.0)),
    ("40 per hour", (None, 40.0, 40.0, "hour", 83200.0, 83200.0)),
    ("$90k – $70k", ("USD", 70000.0, 90000.0, "year", 70000.0, 90000.0)),
    ("US$1,200 weekly", ("USD", 1200.0, 1200.0, "week", 62400.0, 62400.0)),
    ("Founded in 1999, 12 people", (None,) * 6),
    ("Competitive", (None,) * 6),
    ("", (None,) * 6),
    (None, (None,) * 6),
]


def test_pay_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAYS)], "i long, t string")
    found = with_pay(rows, F.col("t")).orderBy("i").collect()
    assert [tuple(r)[2:] for r in found] == [p for _, p in PAYS]


def filtered(spark, rules, rows):
    columns = "id long, city string, title string, pay string"
    made = spark.createDataFrame(rows, columns).withColumn("details", F.lit(None).cast("array<struct<key:string,value:string>>"))
    return [r["id"] for r in prefilter.prefilter(prefilter.with_filter_columns(made, F.col("pay")), rules).orderBy("id").collect()]


ROWS = [
    (1, " Toronto\n", "Data Engineer", "$40 per hour"), (2, "toronto", "Senior engineer (C++)", "$100k"), (3, "Ottawa", "Engineering lead", None),
    (4, None, "Engineer", "€50k"), (5, "Ottawa", None, "70,000 USD to 80,000 USD"),
]


@pytest.mark.parametrize(
    "rules, kept",
    [
        ([], [1, 2, 3, 4, 5]),
        ([("location", "in", "TORONTO")], [1, 2]),
        ([("location", "not_in", "ottawa")], [1, 2, 4]),
        ([("title", "any_word", "engineer")], [1, 2, 4]),
        ([("title", "any_word", "c++"), ("title", "any_word", "lead")], [2, 3]),
        ([("title", "no_word", "senior")], [1, 3, 4, 5]),
        ([("pay", "at_least", "80000")], [1, 2, 5]),
        ([("pay", "at_least", "90000"), ("pay", "unknown", "keep")], [2, 3]),
        ([("pay", "currency", "usd"), ("pay", "at_most", "75000")], [5]),
        ([("pay", "currency", "EUR"), ("location", "in", "Ottawa")], []),
    ],
)
def test_rules(spark, rules, kept):
    assert filtered(spark, rules, ROWS) == kept


def test_bad_rules_are_errors(spark):
    for rule in [("place", "in", "x"), ("pay", "in", "x"), ("title", "any_word", None), ("pay", "at_least", "much")]:
        with pytest.raises(ValueError):
            prefilter.rule_predicate([rule])
    with pytest.raises(ValueError):
        prefilter.rule_predicate([("pay", "at_least", "1"), ("pay", "unknown", "maybe")])
    many = spark.range(prefilter.MOST_RULES + 1).selectExpr("'location' as field", "'in' as test", "string(id) as value")
    with pytest.raises(ValueError):
        prefilter.read_rules(many)


def test_rules_reach_the_scan(spark, sf_dir, tmp_path):
    prefix = str(tmp_path / "index")
    jobs = prefilter.with_filter_columns(fx.jobs(spark, sf_dir), F.lit("$50 per hour"))
    matching.vectorize_postings(jobs, prefix, "s", ["seq"], keep=prefilter.FILTER_COLUMNS)
    index, _ = vector_store.load_index(spark, prefix)
    query = index.limit(1).select(F.col("internal_id").alias("query_id"), "vec")
    rules = [("location", "in", "City 3"), ("title", "any_word", "en"), ("pay", "at_least", "60000")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = search.topk(prefilter.prefilter(index, rules), query, 4)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.splitlines() if "location" in line and "PushedFilters" in line]
    assert pushed and all(x in pushed[0] for x in ("location,city 3", "StringContains(title_words", "GreaterThanOrEqual(pay_yearly_high"))
    assert "text_hash" not in pushed[0] and "job_id" not in pushed[0].split("ReadSchema")[1]
