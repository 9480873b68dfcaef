"""Change feed: the append-only log as a stream, joined with the current rows in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed(log: DataFrame, current: DataFrame, after: int, limit: int, key: str = "user_id", cursor: str = "event_id") -> DataFrame:
    """The page of changes after a cursor, with the present state of what changed."""
    return log.where(F.col(cursor) > after).orderBy(cursor).limit(limit + 1).join(current, key, "left")


def run(spark: SparkSession, source: str, current: DataFrame, sink: str, checkpoint: str, key: str = "user_id") -> None:
    """Reads what is new in source once, joins it and appends it to sink; the checkpoint remembers where it was."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.join(current, key, "left").write.mode("append").parquet(sink)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
