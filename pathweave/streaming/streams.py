"""Structured Streaming: windows with late data, latest state, incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows; works on a stream and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "1 day", step: str = "12 hours") -> DataFrame:
    """Counts in overlapping windows."""
    out = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """Sessions of each user: runs of events less than a gap apart."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def load_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Append the Parquet files that appeared in a folder since the last call; the checkpoint is
    the manifest."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_latest(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> None:
    """Merge a stream of events into a table of each key's last one, batch by batch."""
    from pathweave.operators.integrity import upsert

    def merge(batch: DataFrame, number: int) -> None:
        current = batch.sparkSession.read.parquet(f"{target}/v{number - 1}") if number else batch.limit(0)
        upsert(current, batch, [key], order).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
