"""Exact vector search: distances as column expressions, top-k as TakeOrderedAndProject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("combined", "title", "body")


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences in double; null where the lengths differ."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector has norm zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_score(distance: Column) -> Column:
    """The published score of a squared distance: 1 - d / 100."""
    return F.lit(1.0) - distance / F.lit(100.0)


def top_k(vectors: DataFrame, query: Sequence[float] | Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k best rows, best first, ties by id; ``distance`` or ``cosine`` and ``similarity_score``.

    ``metric`` is ``l2`` (score 1 - d/100) or ``cosine`` (a null score, from a zero vector, sorts last).
    """
    q = query if isinstance(query, Column) else _literal(query)
    if metric == "l2":
        d = squared_l2(F.col(vec_col), q)
        return vectors.withColumn("similarity_score", l2_score(d)).orderBy(F.col("similarity_score").desc_nulls_last(), id_col).limit(k)
    if metric != "cosine":
        raise ValueError(f"metric is l2 or cosine, not {metric!r}")
    return vectors.withColumn("similarity_score", cosine(F.col(vec_col), q)).orderBy(F.col("similarity_score").desc_nulls_last(), id_col).limit(k)


def resolve_kind(kind: str | None, available: Sequence[str]) -> str:
    """The matrix that a search uses: an unknown or missing kind falls back to ``combined``."""
    return kind if kind in KINDS and kind in available else "combined"


def search(store: DataFrame, query: Sequence[float], k: int | None = 5, kind: str | None = "combined", available: Sequence[str] = KINDS, metric: str = "l2") -> DataFrame:
    """Top-k over a store of (article_id, kind, embedding); adds similarity_score and search_type.

    ``k`` of None means the default 5.
    """
    use = resolve_kind(kind, available)
    hits = top_k(store.filter(F.col("kind") == use), query, k or 5, id_col="article_id", metric=metric)
    return hits.withColumn("search_type", F.lit(use))


def augmented(articles: DataFrame, store: DataFrame, query: Sequence[float], k: int = 3) -> DataFrame:
    """The k best articles in order, and ``current_article``: the text, else the content, of the best one, else empty."""
    hits = search(store, query, k).select("article_id", "similarity_score", "search_type")
    rows = articles.join(F.broadcast(hits), "article_id")  # k rows
    held = [F.when(F.col(c) != "", F.col(c)) for c in ("text", "content") if c in articles.columns]
    best = rows.select(F.coalesce(*held, F.lit("")).alias("current_article"), "similarity_score", "article_id").orderBy(F.col("similarity_score").desc_nulls_last(), "article_id").limit(1).select("current_article")
    return rows.join(F.broadcast(best)).orderBy(F.col("similarity_score").desc_nulls_last(), "article_id")
