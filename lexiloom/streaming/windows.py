"""Event-time windows that read the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """``(start, event_type, n, total)`` per window; ``late`` is the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def follow_folder(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """A stream without repeated keys inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it as Parquet, and stop; a rerun goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
