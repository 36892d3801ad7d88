"""Streams of requests and artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def limited(hits: DataFrame, limit: int = 120, length: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Hits of each ``client`` in sliding event-time windows and whether they pass the limit; hits later
    than ``late`` are dropped by the watermark."""
    counted = hits.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "client").agg(F.count("*").alias("hits"))
    return counted.select("client", F.col("window.start").alias("window_start"), "hits", (F.col("hits") <= limit).alias("allowed"))


def first_of_key(requests: DataFrame, key: str = "idempotency_key", late: str = "10 minutes") -> DataFrame:
    """The first request of each idempotency key within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def without_key(requests: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Requests that change something and carry no idempotency key."""
    return requests.where(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE") & (F.trim(F.coalesce(key, F.lit(""))) == ""))


def traced(batch: DataFrame, batch_id: int, prefix: str = "batch") -> DataFrame:
    """The rows of a micro-batch with its ``trace_id``, the same whenever the batch is run again."""
    return batch.withColumn("trace_id", F.lit(f"{prefix}-{batch_id}"))


def sessions(hits: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = hits.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "client").agg(F.count("*").alias("hits"))
    return counted.select("client", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "hits")


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; the caller makes it idempotent by batch id. Ends when all input is read."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
