"""Row-wise stages over streams. An addition of this engine: stages that look at one row at a time run unchanged on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from auditloom.operators import classify, redact


def redacted_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Accepted, redacted rows of Parquet files (path, content) as they come into a folder."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return redact.redact(classify.classify(rows).filter("reason IS NULL").drop("reason"))


def each_batch(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run all there is through ``sink``, batch by batch; a batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
