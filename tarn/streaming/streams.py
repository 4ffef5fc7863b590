"""Structured Streaming forms of the incremental parts: ingest, cache with time to live, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, then stop; the checkpoint remembers what was read."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def review_queue(events: DataFrame, below: float, value: str = "value") -> DataFrame:
    return events.where(F.col(value) < below)


def windowed(events: DataFrame, ts: str, length: str, slide: str | None, late: str, by: list[str]) -> DataFrame:
    """Counts and sums in tumbling or sliding windows, with late rows allowed for ``late``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, write, checkpoint: str) -> None:
    """``write(batch, id)`` for each micro-batch that is there; ids repeat after a failure, so a version named by the id is idempotent."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
