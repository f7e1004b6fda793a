"""Event streams: the same functions take a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduped(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """One event of each key; on a stream, state is kept for the lateness only."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def tumbling(events: DataFrame, width: str, by: list[str], value: str, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """(start, by..., n, total) of windows of one width."""
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """(key, start, n): runs of a key's events with no pause of gap or more."""
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def snapshot_sink(diff, previous: DataFrame, path: str):
    """A foreachBatch function that writes the difference of each batch to the previous snapshot."""

    def write(batch: DataFrame, number: int) -> None:
        diff(previous, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
