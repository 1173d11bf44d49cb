"""Structured Streaming forms: windows, sessions, deduplication and per-file document summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as T


def read_stream(spark: SparkSession, folder: str, like: DataFrame, names: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of a batch read."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", names)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(folder)


def tumbling_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of event-time windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of user sessions."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sensitive_counts(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_ids) of ids standing in texts."""
    found = F.size(T.id_numbers_in(F.coalesce("text", F.lit(""))))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(found).alias("n_ids"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "complete") -> None:
    """Process what is there now, handing each batch's result to `sink`."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
