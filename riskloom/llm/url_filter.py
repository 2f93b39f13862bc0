"""URL filter: host and path rules, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialise

#: Rules as (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with its own.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules are one expression, so their number is bounded.
MAX_RULES = 1000

#: The small labelled table, 1 for block; callers may bring their own.
LABELLED = [
    ("http://casino-win.example.com/en/12", 1), ("http://www.casino.example.net/play/", 1), ("https://online-casino.example.org/fr/bonus", 1), ("https://m.casino-win.example.net/de/301.html", 1),
    ("http://free-bets.example.com/en/7", 1), ("http://www.bets.example.net/odds", 1), ("https://best-bets.example.org/es/44/", 1), ("https://blog.free-bets.example.net/en/908", 1),
    ("http://cheap-pills.example.com/de/6", 1), ("https://pills.example.net/order", 1), ("http://www.cheap-pills.example.org/fr/31", 1), ("https://cheap-meds.example.com/en/buy/", 1),
    ("http://poker.example.net/bonus", 1), ("https://jackpot-win.example.org/en/5#top", 1), ("http://payday-loans.example.com/apply", 1), ("https://www.cheap-loans.example.net/es/1", 1),
    ("http://news.example.com/en/12", 0), ("http://www.library.example.net/catalogue/", 0), ("https://docs.example.org/fr/manual", 0), ("https://m.museum.example.net/de/301.html", 0),
    ("http://science.example.com/en/7", 0), ("http://www.weather.example.net/today", 0), ("https://recipes.example.org/es/44/", 0), ("https://blog.history.example.net/en/908", 0),
    ("http://school.example.com/de/6", 0), ("https://garden.example.net/plants", 0), ("http://www.music.example.org/fr/31", 0), ("https://travel.example.com/en/trains/", 0),
    ("http://forum.example.net/topics", 0), ("https://sports.example.org/en/5#top", 0), ("http://city-council.example.com/apply", 0), ("https://www.health.example.net/es/1", 0),
    ("https://blog.example.com/en/2024", 0), ("http://example.org/", 0), ("https://www.example.com/about", 0), ("http://m.example.net/fr/home", 0),
    ("https://thesis.example.org/de/881", 0), ("http://lighthouse.example.com/es/73.html", 0), ("https://northern.example.net/en/64/", 0), ("http://station.example.org/fr/5", 0),
]

GRAMS = (3, 4, 5)
FEATURES = 1 << 12
PENALTY = 1e-3
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _gram(mark: str, text: Column, n: int):
    return lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by part; ends of the parts count as characters."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.lower(path), F.lit("$")))):
        for n in GRAMS:
            at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
            parts.append(F.transform(at, _gram(mark, text, n)))
    return F.concat(*parts)


def _features(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__uf_grams", outputCol="__uf_features")
    return hashing.transform(urls.withColumn("__uf_grams", grams(F.col("host"), F.col("path")))).drop("__uf_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """LABELLED as (url, label)."""
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(v)).alias("label")) for u, v in LABELLED])
    return spark.range(1).select(F.inline(rows))


def learn(labelled: DataFrame) -> LogisticRegressionModel:
    """Logistic regression on a small table (url, label); one ordered partition makes it reproducible."""
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    rows = materialise(rows, "labelled-urls")
    ordered = _features(rows.coalesce(1).sortWithinPartitions("host", "path", "label"))
    model = LogisticRegression(featuresCol="__uf_features", labelCol="label", regParam=PENALTY, maxIter=40, standardization=False)
    return model.setProbabilityCol("__uf_probability").setRawPredictionCol("__uf_raw").setPredictionCol("__uf_prediction").fit(ordered)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page, in one pass without a shuffle.

    A NULL url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the model's view of nothing.  Repeated rows are judged one
    by one; other columns play no part.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(_features(rows)).withColumn("score", vector_to_array("__uf_probability")[1])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "score")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``judge`` with a model learnt from ``labelled`` (url, label 1 for block), LABELLED by default."""
    return judge(pages, learn(labelled_urls(pages.sparkSession) if labelled is None else labelled), rules)
