"""Streams of jobs and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_of_job(stream: DataFrame, keys: list[str], time: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """Drops repeats of a job inside the time to live; state older than the watermark is forgotten."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there, into Parquet under the shared ``folder``, and reads that back."""
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

