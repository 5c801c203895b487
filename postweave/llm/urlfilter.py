"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A URL that a rule covers is labelled by it. Boosted trees learn from those labels and judge the other
URLs by length, host length, depth, digit ratio, character entropy, numbers of parameters, dots and hyphens,
and by statistics of the host's last label and last two labels (how many labelled URLs have them, and
the smoothed share blocked). Everything is DataFrame expressions and Spark's own trees.

The trees are fitted on a sample of at most ``SAMPLE_ROWS`` labelled URLs, by hash; suffix statistics
count all of them. A null URL, or one without "://", has an empty host and path. Where no URL is labelled
everything is allowed; where all labels agree they decide. Repeated rows are all judged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.operators.joins import even_join
from postweave.session import scratch_path

# fixed values: verdict, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SAMPLE_ROWS = 20_000
SAMPLE_PARTS = 4
TREES = 20
DEPTH = 4
SEED = 7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "dots", "hyphens", "seen1", "blocked1", "seen2", "blocked2"]


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, verdict: string>")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def features(urls: DataFrame) -> DataFrame:
    """Lexical features of ``url`` (not null), ``host`` and ``path``."""
    url = F.col("url")
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.split(url, "")
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n),
        F.lit(0.0), lambda total, share: total - share * F.log2(share),
    )
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0.0).otherwise((_count(query, "&") + 1).cast("double")).alias("parameters"),
        _count(url, ".").cast("double").alias("dots"),
        _count(url, "-").cast("double").alias("hyphens"),
        F.element_at(labels, -1).alias("suffix1"),
        F.concat_ws(".", F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2)).alias("suffix2"),
    )


def _with_suffixes(rows: DataFrame, labelled: DataFrame, share: float) -> DataFrame:
    """Number of labelled URLs with the suffix (log) and their smoothed share blocked."""
    for i in ("1", "2"):
        counts = labelled.groupBy(f"suffix{i}").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
        counts = counts.select(
            f"suffix{i}", F.log1p("n").alias(f"seen{i}"), ((F.col("bad") + 10 * share) / (F.col("n") + 10)).alias(f"blocked{i}")
        )
        rows = even_join(rows, counts, f"suffix{i}", "left").na.fill({f"seen{i}": 0.0, f"blocked{i}": share})
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, blocked (the method's probability)."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    parsed = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("by"))
    path = scratch_path(spark, "urls")
    features(ruled.select("*", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("ruled")).drop("by")).drop("url").write.parquet(path)
    rows = spark.read.parquet(path)
    labelled = rows.where("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    counts = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    output = ["page_id", "host", "path", "rule"]
    if not counts["n"] or counts["bad"] in (0, counts["n"]):
        blocked = F.lit(float(bool(counts["n"] and counts["bad"])))
        judged = rows.withColumn("blocked", blocked)
    else:
        share = counts["bad"] / counts["n"]
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
        # a cut by hash to about the bound, then the bound itself
        near = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20))
        cut = labelled.where(near < int(min(1.0, 1.2 * sample_rows / counts["n"]) * (1 << 20)) + 1)
        sample = cut.orderBy(near, "page_id", "host", "path").limit(sample_rows)
        place = scratch_path(spark, "urlsample")
        ready.transform(_with_suffixes(sample, labelled, share)).select("label", "features").write.parquet(place)
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED)
        model = trees.fit(spark.read.parquet(place).coalesce(SAMPLE_PARTS))
        scored = model.transform(ready.transform(_with_suffixes(rows, labelled, share)))
        judged = scored.withColumn("blocked", vector_to_array(F.col("probability"))[1])
    verdict = F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return judged.select(*output, verdict.alias("verdict"), "blocked")
