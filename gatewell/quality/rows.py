"""Row-level views on quality: null counts, rows that break rules, unusual days."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewell.functions import quoted


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column from one aggregate. NaN is a value, not a null."""
    measures = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}")
                for i, c in enumerate(df.columns)]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"),
                     (F.col(f"n{i}") > 0).alias("is_issue")) for i, c in enumerate(df.columns)]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def null_percentages(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Null percentage of every listed column against the threshold."""
    total = F.count(F.lit(1)).alias("total")
    measures = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("total").alias("total_rows"),
                     F.col(f"n{i}").alias("null_rows")) for i, c in enumerate(columns)]
    counted = df.agg(total, *measures).select(F.inline(F.array(*rows)))
    percent = F.when(F.col("total_rows") > 0, F.col("null_rows").cast("double")
                     / F.col("total_rows").cast("double") * 100).otherwise(F.lit(0.0))
    return (counted.withColumn("null_percentage", percent)
            .withColumn("threshold", F.lit(float(threshold)))
            .withColumn("passed", F.col("null_percentage") <= F.col("threshold")))


def outside_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values outside the allowed set with their row counts; null is not a value."""
    value = F.col(quoted(column))
    return (df.where(value.isNotNull() & ~value.isin(*allowed))
            .groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows")))


def failing_rows(df: DataFrame, rules: Mapping[str, Column], order_by: list[str],
                 per_check: int) -> DataFrame:
    """The first rows behind every failed rule, for triage.

    Each rule is a filter with an ordered limit: tasks keep ``per_check`` rows on a heap, whatever
    the number of rows that fail, and nothing else is sorted or shuffled.
    """
    order = [F.col(c).asc() for c in order_by]
    samples = [df.where(~F.coalesce(rule, F.lit(False))).orderBy(*order).limit(per_check)
               .withColumn("check_name", F.lit(name)) for name, rule in rules.items()]
    window = Window.partitionBy("check_name").orderBy(*order)
    return reduce(DataFrame.unionByName, samples).withColumn(
        "sample_no", F.row_number().over(window).cast("bigint"))


def row_count_anomalies(df: DataFrame, time: str, days: int = 7, factor: float = 3.0) -> DataFrame:
    """Daily row counts against the mean and spread of the days before.

    A day without rows between the first and the last one has a line with the count 0. Rows
    without a time belong to no day. The window runs over one row per day, not over the data.
    """
    counted = (df.where(F.col(quoted(time)).isNotNull())
               .groupBy(F.to_date(quoted(time)).alias("day")).agg(F.count(F.lit(1)).alias("n")))
    days_between = counted.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(
        "a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    daily = days_between.join(counted, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    before = Window.orderBy("day").rowsBetween(-days, -1)
    history = daily.select(
        "day", "n", F.count("n").over(before).alias("h"), F.sum("n").over(before).alias("s"),
        F.sum(F.col("n") * F.col("n")).over(before).alias("ss"))
    # Variance from whole-number sums: exact until the last division, in any row order.
    h, s = F.col("h").cast("double"), F.col("s").cast("double")
    mean = F.when(F.col("h") > 0, s / h)
    spread = F.when(F.col("h") > 1, F.sqrt(
        (F.col("h") * F.col("ss") - F.col("s") * F.col("s")).cast("double") / (h * (h - 1))))
    return (history.withColumn("mean_before", mean).withColumn("sd_before", spread)
            .select("day", F.col("n").alias("row_count"), "mean_before", "sd_before",
                    F.coalesce(F.abs(F.col("n") - F.col("mean_before"))
                               > F.lit(factor) * F.col("sd_before"), F.lit(False))
                    .alias("is_anomaly")))
