"""Article corpora: one JSON file per article in topic folders, and the stored table with vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from claimloom.functions.text import article_id, combined_text, fix_text, or_default

RAW_SCHEMA = """title STRING, body STRING, content STRING, published_at STRING, summary STRUCT<sentences: ARRAY<STRING>>, author STRUCT<name: STRING>,
links STRUCT<permalink: STRING>, source STRUCT<name: STRING, domain: STRING, description: STRING, home_page_url: STRING,
locations: ARRAY<STRUCT<city: STRING, country: STRING, state: STRING>>>, _corrupt STRING"""


def read_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """``<data_dir>/<topic>/<id>.json``, one level deep; unreadable files are left out. Adds file_path."""
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{data_dir.rstrip('/')}/*/*.json")
    return raw.withColumn("file_path", F.col("_metadata.file_path")).filter(F.col("_corrupt").isNull()).drop("_corrupt")


def write_raw(rows: DataFrame, data_dir: str) -> int:
    """Writes (topic, name, json) as ``<data_dir>/<topic>/<name>.json``, from the tasks; a file appears whole. Returns their number.

    ``data_dir`` is a shared folder with its scheme, as checkpoints and corpora are.
    """
    from pyarrow import fs
    import pyarrow as pa

    def put(batches):
        n = 0
        for b in batches:
            for topic, name, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                system, base = fs.FileSystem.from_uri(f"{data_dir.rstrip('/')}/{topic}")
                system.create_dir(base, recursive=True)
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(text.encode())
                system.move(part, f"{base}/{name}.json")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("topic", "name", "json").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def normalised(raw: DataFrame) -> DataFrame:
    """Articles with defaults for what is missing; texts are repaired, so a null title becomes empty.

    A missing title and a null one look alike here; both give "No Title".
    """
    return raw.select(
        article_id(F.col("file_path")).alias("article_id"),
        fix_text(or_default(F.col("title"), "No Title")).alias("title"),
        fix_text(F.col("body")).alias("body"),
        F.transform(F.coalesce("summary.sentences", F.array().cast("array<string>")), lambda x: or_default(x, "")).alias("summary"),
        or_default(F.col("source.name"), "Unknown").alias("source"),
        or_default(F.col("author.name"), "Unknown").alias("author"),
        or_default(F.col("published_at"), "").alias("date"),
        or_default(F.col("links.permalink"), "").alias("source_link"),
        F.col("source").alias("source_info"),
        "file_path",
    )


def load_articles(spark: SparkSession, data_dir: str) -> DataFrame:
    return normalised(read_raw(spark, data_dir))


def embedded(articles: DataFrame, encoder: Callable, kinds: tuple[str, ...] = ("combined", "title", "body")) -> DataFrame:
    """(article_id, kind, embedding): ``encoder`` is a vectorised UDF from string to array<float>."""
    texts = {"combined": combined_text(F.col("title"), F.col("body")), "title": F.col("title"), "body": F.col("body")}
    rows = articles.select("article_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), texts[k].alias("text")) for k in kinds])).alias("t"))
    return rows.select("article_id", "t.kind", encoder(F.col("t.text")).alias("embedding"))


def save(articles: DataFrame, vectors: DataFrame, folder: str) -> None:
    articles.write.mode("overwrite").parquet(f"{folder}/articles")
    vectors.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/vectors")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/articles"), spark.read.parquet(f"{folder}/vectors")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/vectors/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_or_build(spark: SparkSession, data_dir: str, folder: str, encoder: Callable) -> tuple[DataFrame, DataFrame]:
    """The stored articles and vectors, built and stored first where there are none."""
    if not exists(spark, folder):
        articles = load_articles(spark, data_dir)
        save(articles, embedded(articles, encoder), folder)
    return load(spark, folder)


#: So that no character is lost: white space at the ends stays, and each end of line is told from those in values.
CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(articles: DataFrame, folder: str) -> tuple[int, list[str]]:
    """A flat export: nested columns as JSON; returns the row count and the column names. Null is nothing, an empty string is ``""``."""
    flat = articles.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in articles.dtypes])
    flat.write.mode("overwrite").options(**CSV).csv(folder)
    return articles.count(), articles.columns


def read_csv(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """An export's columns as strings, as they were written."""
    empty = uuid.uuid4().hex  # Spark takes what is its null value for null, quoted or not, so an empty string needs a name no text has
    back = spark.read.options(**CSV, multiLine=True, emptyValue=empty, maxCharsPerColumn=-1).schema(StructType([StructField(c, StringType()) for c in columns])).csv(folder)
    return back.select(*[F.when(F.col(c) == empty, F.lit("")).otherwise(F.col(c)).alias(c) for c in columns])


def write_summary(summary: DataFrame, folder: str) -> None:
    """The condensed summary as JSON lines, an article with its claims and agents on each."""
    summary.write.mode("overwrite").json(folder)
