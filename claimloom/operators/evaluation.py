"""Corpus statistics and agreement with a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claims_per_article(claims: DataFrame, articles: DataFrame, topic: str = "topic", article: str = "article_id") -> DataFrame:
    """Per topic: articles, claims, and mean, sample and population deviation of claims per article (none counts as 0)."""
    n = claims.groupBy(article).agg(F.count(F.lit(1)).alias("n"))
    rows = articles.select(article, topic).join(n, article, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(topic).agg(F.count(F.lit(1)).alias("articles"), F.sum("n").alias("claims"), F.avg("n").alias("mean_claims"), F.stddev_samp("n").alias("sd_claims"), F.stddev_pop("n").alias("sd_pop_claims"))


def precision_recall(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall and F1 (null where undefined)."""
    hit = lambda c: F.count_if(c)
    n = pairs.agg(hit(F.col(predicted) & F.col(actual)).alias("tp"), hit(F.col(predicted) & ~F.col(actual)).alias("fp"), hit(~F.col(predicted) & F.col(actual)).alias("fn"))
    n = n.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched_claims(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """One row per distinct key of either side with ``predicted`` and ``actual``, for precision_recall."""
    a, b = found.select(*key).distinct().withColumn("predicted", F.lit(True)), gold.select(*key).distinct().withColumn("actual", F.lit(True))
    return a.join(b, key, "full").fillna(False, ["predicted", "actual"])
