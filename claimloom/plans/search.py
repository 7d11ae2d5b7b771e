"""Vector search queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import vector
from claimloom.sources.tables import table


def _with_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector beside vector 0: one row, so the product is a broadcast of one vector."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return e.join(F.broadcast(q))


def vec_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors to vector 0 by squared distance."""
    hits = vector.top_k(_with_query(spark, sf_dir), F.col("q"), 5)
    return hits.select("vec_id", "label", F.round("similarity_score", 5).alias("similarity_score"))


def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors to vector 0 by cosine."""
    hits = vector.top_k(_with_query(spark, sf_dir), F.col("q"), 5, metric="cosine")
    return hits.select("vec_id", "label", F.round("similarity_score", 5).alias("similarity_score"))


def vec_topk_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind switch: even labels are the title matrix, odd ones the body; the body is searched."""
    store = _with_query(spark, sf_dir).withColumn("kind", F.when(F.col("label") % 2 == 0, "title").otherwise("body"))
    use = vector.resolve_kind("body", ("title", "body"))
    hits = vector.top_k(store.filter(F.col("kind") == use), F.col("q"), 5)
    return hits.select("vec_id", F.lit(use).alias("search_type"), F.round("similarity_score", 5).alias("similarity_score"))


_D = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_C = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_FROM = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0 LIMIT 1) q"

QUERIES = {"vec_topk_l2": vec_topk_l2, "vec_topk_cosine": vec_topk_cosine, "vec_topk_by_kind": vec_topk_by_kind}
ORACLES = {
    "vec_topk_l2": f"SELECT vec_id, label, round(1 - {_D} * {_D} / 100, 5) AS similarity_score {_FROM} ORDER BY {_D}, vec_id LIMIT 5",
    "vec_topk_cosine": f"SELECT vec_id, label, round({_C}, 5) AS similarity_score {_FROM} ORDER BY {_C} DESC, vec_id LIMIT 5",
    "vec_topk_by_kind": f"SELECT vec_id, 'body' AS search_type, round(1 - {_D} * {_D} / 100, 5) AS similarity_score {_FROM} WHERE label % 2 = 1 ORDER BY {_D}, vec_id LIMIT 5",
}
