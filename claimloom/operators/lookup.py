"""Keyed retrieval, resumption and nested summaries over article tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def id_list(spark: SparkSession, ids: Sequence) -> DataFrame:
    """(pos, id) of a request, in order, repeats kept; bounded by what a caller types."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, id {'bigint' if all(isinstance(x, int) for x in ids) else 'string'}")


def by_ids(articles: DataFrame, ids: DataFrame, id_col: str = "article_id") -> DataFrame:
    """The requested articles in request order (``pos``), repeats kept; of repeated article rows the last by ``_row`` wins.

    Without a column ``_row`` the article rows are taken as unique.
    """
    rows = articles
    if "_row" in articles.columns:
        rows = articles.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
        rows = rows.groupBy(id_col).agg(*[F.max_by(c, "_row").alias(c) for c in articles.columns if c not in (id_col, "_row")])
    return rows.join(ids.withColumnRenamed("id", id_col), id_col).orderBy("pos")


def missing_ids(articles: DataFrame, ids: DataFrame, id_col: str = "article_id") -> DataFrame:
    """(pos, id) of the requests that no article has."""
    return ids.join(articles.select(F.col(id_col).alias("id")), "id", "left_anti").orderBy("pos").select("pos", "id")


def _digest(row: Column) -> Column:
    """A hash of a struct, so that of equal keys the same row is taken wherever it lies."""
    return F.xxhash64(F.to_json(row))


def resumable(checkpoints: DataFrame) -> DataFrame:
    """The latest checkpoint of each article, ties by a digest of the row, where it succeeded and has claims and agents."""
    latest = checkpoints.groupBy("article_id").agg(F.max_by(F.struct("*"), F.struct("timestamp", _digest(F.struct("*")))).alias("c")).select("c.*")
    return latest.filter((F.col("status") == "success") & F.col("claims").isNotNull() & F.col("agents_info").isNotNull())


def to_process(articles: DataFrame, done: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Articles without a usable checkpoint."""
    return articles.join(done.select(id_col), id_col, "left_anti")


def condensed(articles: DataFrame, claims: DataFrame, agents: DataFrame) -> DataFrame:
    """A row per article: its columns, ``claims`` in order and ``agents_info``, a map from name.

    articles: article_id, ...; claims: article_id, pos, claim; agents: article_id, agent_name, info. Articles
    without claims or agents get empty ones; of repeated article ids and agent names the row of least digest is taken.
    """
    once = articles.groupBy("article_id").agg(F.min_by(F.struct("*"), _digest(F.struct("*"))).alias("r")).select("r.*")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda x: x["claim"])
    listed = claims.groupBy("article_id").agg(in_order.alias("claims"))
    unique = agents.groupBy("article_id", "agent_name").agg(F.min_by("info", _digest(F.struct("info"))).alias("info"))
    mapped = unique.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent_name", "info")))).alias("agents_info"))
    both = once.join(listed, "article_id", "left").join(mapped, "article_id", "left")
    kinds = {c: both.schema[c].dataType for c in ("claims", "agents_info")}
    return both.withColumns({"claims": F.coalesce("claims", F.array().cast(kinds["claims"])), "agents_info": F.coalesce("agents_info", F.create_map().cast(kinds["agents_info"]))})


def totals(summary: DataFrame) -> DataFrame:
    """One row: the number of articles, claims and agents."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint")
    return summary.agg(F.count(F.lit(1)).alias("num_articles"), total("claims").alias("num_claims"), total("agents_info").alias("num_agents"))


def chronological(items: DataFrame, by: str, start: str = "start_date", end: str = "end_date", pos: str = "pos") -> DataFrame:
    """items with ``rank``: latest end first (none: still running, first of all), then latest start, then position."""
    order = [F.coalesce(end, F.lit("9999-99-99")).desc(), F.coalesce(start, F.lit("0000-00-00")).desc(), F.col(pos)]
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def last_attempts(events: DataFrame, key: str, attempt: str, details: str) -> DataFrame:
    """Per key: the number of attempts, the last one and its details."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(attempt).alias("last_attempt"), F.max_by(details, attempt).alias("last_details"))


def history(events: DataFrame, key: str) -> DataFrame:
    """(key, history): the events of each key in order of ``pos``, as an array of event and details (a string of JSON)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "event", "details")))  # a few events for each agent
    return events.groupBy(key).agg(F.transform(rows, lambda x: F.struct(x["event"].alias("event"), x["details"].alias("details"))).alias("history"))
