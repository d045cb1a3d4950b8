"""Incremental loads as a stream: each run takes the files that arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def load_available(stream: DataFrame, target: str, checkpoint: str,
                   partition_by: list[str] | None = None) -> None:
    """Append everything available to Parquet files under ``target`` and stop.

    The checkpoint remembers the files already taken and the file sink commits whole batches, so
    running again, or after a crash, neither repeats nor loses rows.
    """
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", target)
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def unique_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; state older than that is forgotten."""
    zoned = stream.withColumn(time, F.col(time).cast("timestamp"))
    return zoned.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
