"""Checkpoints of processed articles: JSON per article in, an append-only table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from claimloom.functions.text import safe_filename

CLAIM = "STRUCT<agent_name: STRING, agent_description: STRING, agent_type: STRING, utterance_type: STRING, utterance_text: STRING, source_context: STRING>"
SCHEMA = f"""article_id STRING, title STRING, body STRING, date STRING, source_link STRING,
source_info STRUCT<name: STRING, domain: STRING, description: STRING, home_page_url: STRING, locations: ARRAY<STRUCT<city: STRING, country: STRING, state: STRING>>>,
claims ARRAY<{CLAIM}>,
agents_info MAP<STRING, STRUCT<name: STRING, type_of_agent: STRING, agent_description: STRING, wikidata_info: VARIANT,
  taxonomy_info: STRUCT<classification: STRING, confidence: STRING, explanation: STRING>, match_evaluation: STRING,
  extraction_history: ARRAY<STRUCT<event: STRING, details: VARIANT>>>>,
timestamp STRING, status STRING, error STRING"""


def read_json(spark: SparkSession, pattern: str) -> DataFrame:
    """Checkpoint files, one JSON document each; files that can't be parsed come with null columns and are left out."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(pattern).filter(F.col("article_id").isNotNull())


def append(rows: DataFrame, folder: str) -> None:
    """Adds a batch; of several rows per article the latest counts when read."""
    rows.write.mode("append").parquet(folder)


def failures(articles: DataFrame, error: Column, timestamp: Column) -> DataFrame:
    """Checkpoint rows of articles (article_id, title) whose processing failed: status error, no claims and no agents."""
    given = {"article_id": F.col("article_id"), "title": F.col("title"), "timestamp": timestamp, "status": F.lit("error"), "error": error}
    kinds = _parse_datatype_string(SCHEMA)
    return articles.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def successes(summary: DataFrame, timestamp: Column) -> DataFrame:
    """Checkpoint rows of finished articles (article_id, title, claims)."""
    given = {"article_id": F.col("article_id"), "title": F.col("title"), "claims": F.col("claims"), "timestamp": timestamp, "status": F.lit("success"), "agents_info": F.create_map()}
    kinds = _parse_datatype_string(SCHEMA)
    return summary.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def write_files(rows: DataFrame, folder: str) -> int:
    """One JSON file for each checkpoint row, ``article_<id>.json``, beside the table for tools that read files."""
    from claimloom.sources.articles import write_raw

    name = F.replace(safe_filename(F.col("article_id")), F.lit(".json"), F.lit(""))
    return write_raw(rows.select(F.lit("files").alias("topic"), name.alias("name"), F.to_json(F.struct("*")).alias("json")), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def claim_rows(checkpoints: DataFrame) -> DataFrame:
    """The claims as a long table with their position."""
    return checkpoints.select("article_id", F.posexplode("claims").alias("pos", "c")).select("article_id", "pos", "c.*")


def agent_rows(checkpoints: DataFrame) -> DataFrame:
    """The agents as a long table."""
    rows = checkpoints.select("article_id", F.explode("agents_info").alias("agent_name", "a"))
    entity = F.try_variant_get(F.col("a.wikidata_info"), "$.wikidata_id", "string")
    return rows.select("article_id", "agent_name", "a.type_of_agent", "a.agent_description", F.col("a.taxonomy_info.classification").alias("classification"), F.col("a.taxonomy_info.confidence").alias("confidence"), "a.match_evaluation", entity.alias("entity_id"))


def article_rows(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("article_id", "title", "body", "date", "source_link", F.col("source_info.name").alias("publisher"), F.col("source_info.domain").alias("domain"))
