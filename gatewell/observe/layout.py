"""Advice on file sizes and partition columns, and the volume a rebuild would touch."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gatewell.functions import quoted, share

SMALL_FILE = 32 * 1024 * 1024
LARGE_FILE = 2 * 1024 * 1024 * 1024


def file_sizes(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Size and rows of every file behind the frames; no data column is read.

    The files are listed by their names, so those without rows are seen too. Rows are counted per
    file on the map side.
    """
    def one(name: str, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        # Whole-file records, of which only path and length are asked for: contents are not read.
        listed = (spark.read.format("binaryFile").load(df.inputFiles())
                  .select("path", F.col("length").alias("bytes")))
        rows = (df.select(F.col("_metadata.file_path").alias("path")).groupBy("path")
                .agg(F.count(F.lit(1)).alias("rows")))
        return listed.join(rows, "path", "left").select(
            F.lit(name).alias("table_name"), "path", "bytes",
            F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in frames.items()])


def file_size_advice(frames: Mapping[str, DataFrame], small: int = SMALL_FILE,
                     large: int = LARGE_FILE) -> DataFrame:
    """Per table: number of files, how many are too small or too large, and bytes per row."""
    stats = file_sizes(frames).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
        F.sum("rows").alias("rows"), F.count_if(F.col("bytes") < small).alias("small_files"),
        F.count_if(F.col("bytes") > large).alias("large_files"))
    advice = (F.when((F.col("files") > 1) & (F.col("small_files") * 2 > F.col("files")), "compact")
              .when(F.col("large_files") > 0, "split").otherwise("keep"))
    return stats.select("table_name", "files", "bytes", "rows", "small_files", "large_files",
                        share(F.col("bytes"), F.col("rows")).alias("bytes_per_row"),
                        advice.alias("advice"))


def partition_advice(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per candidate column: distinct values, rows per value, skew and share of nulls.

    Each column is read alone and reduced to its values on the map side.
    """
    def one(name: str) -> DataFrame:
        values = (df.groupBy(F.col(quoted(name)).alias("v"))
                  .agg(F.count(F.lit(1)).alias("n")))
        present = F.when(F.col("v").isNotNull(), F.col("n"))
        stats = values.agg(
            F.count("v").alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("_all"),
            F.coalesce(F.sum(present), F.lit(0)).alias("_rows"),
            F.coalesce(F.max(present), F.lit(0)).alias("max_rows"))
        average = share(F.col("_rows"), F.col("distinct_values"))
        return stats.select(
            F.lit(name).alias("column_name"), "distinct_values", average.alias("avg_rows"),
            "max_rows", F.when(average > 0, F.col("max_rows").cast("double") / average)
            .otherwise(F.lit(0.0)).alias("skew_ratio"),
            share(F.col("_all") - F.col("_rows"), F.col("_all")).alias("null_share"))
    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def volume_guard(df: DataFrame, time: str, start: str, end: str, bytes_per_row: int,
                 limit_bytes: int) -> DataFrame:
    """Rows and bytes a rebuild of the days from ``start`` to ``end`` would write, added up day by
    day, and whether approval is needed. The window runs over one row per day."""
    in_range = ((F.col(time) >= F.lit(start).cast("date"))
                & (F.col(time) < F.date_add(F.lit(end).cast("date"), 1)))
    daily = (df.where(in_range).groupBy(F.to_date(time).alias("day"))
             .agg(F.count(F.lit(1)).alias("rows")))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (daily.withColumn("bytes", F.col("rows") * F.lit(bytes_per_row).cast("bigint"))
            .withColumn("bytes_so_far", F.sum("bytes").over(so_far))
            .withColumn("needs_approval", F.col("bytes_so_far") > F.lit(limit_bytes)))
