"""Event windows that run alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """window_start, event_type, n, total."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, watermark: str | None = None) -> DataFrame:
    """user_id, window_start, n."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("user_id", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """user_id, start_ts, n of sessions that end after a gap."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


def distinct_entries(events: DataFrame, watermark: str) -> DataFrame:
    """Repeats of an id within the watermark go."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def stream_of(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there into an in-memory table, for tests and small jobs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
