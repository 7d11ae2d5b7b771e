"""Resuming as a stream: new articles are processed once, whatever was interrupted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Applies ``process`` to each batch of new Parquet rows under ``source`` and appends the results to ``sink``.

    All that is there is read, then the query ends; run it again for what has come since. A batch
    that is repeated after a failure writes its own folder again, so the sink holds each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
