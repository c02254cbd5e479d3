"""Structured Streaming jobs over the events table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """``events`` with ts as a ``timestamp``, which watermarks ask for; on a stream with a watermark that lets rows be ``late``."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if out.isStreaming else out


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; works on a batch and on a stream alike.

    Event times are cast to ``timestamp``: watermarks refuse ``timestamp_ntz``.
    """
    rows = timed(events.select("ts", "event_type"), late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def distinct_events(events: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """One row of each key. On a stream a repeat is known for as long as the watermark has not passed the first by ``late``; the state then forgets it.

    In a batch all repeats are known; which row stays is not defined in either, so rows of one key should be alike. Null keys are alike; rows
    without a time are never late and hold no watermark back.
    """
    rows = timed(events, late)
    return rows.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet files that match ``path``, a folder or pattern, as a stream; ``files`` bounds those of one micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def append_to_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs ``stream`` over all that there is now, appends what is final to Parquet files in ``out``, and reads these.

    A later call with the same two folders goes on where the last ended, or broke off: what has been read is in ``checkpoint``, open windows and known keys
    are in its state, and the files' own log tells which of them count, so no row is written twice or lost. Both folders must be shared by all executors.
    """
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_to_table(spark: SparkSession, sf_dir: str, name: str, checkpoint: str) -> DataFrame:
    """All of the events table as one available-now stream, complete mode, into a memory table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
