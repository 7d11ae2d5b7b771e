"""What the corpus operators share: shared-folder tables, words, and Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the complement of a word's characters.
WORD = r"[^\x20\x09-\x0D]+"
_SLICE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(name: str) -> Column:
    """A text column's bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``, with its scheme; in the warehouse where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return qualified(spark, f"{base.rstrip('/')}/claimloom-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark gives it, so that tasks which write by themselves go to the same store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = folder or workspace(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a write's shuffle files go as soon as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder that stored() wrote and that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that stay small however long the text is."""
    if len(text) <= _SLICE:
        yield text.split()
        return
    start = 0
    while start < len(text):
        end = start + _SLICE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end].split()
        start = end


def binaries(column: pa.Array) -> list[bytes]:
    """The values of a binary column, null as empty."""
    return [x or b"" for x in column.to_pylist()]
