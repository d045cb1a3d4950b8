"""Run time and cost of jobs from their run log, and alerts on unusual days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gatewell.functions import money, share
from gatewell.operators.ranking import group_quantiles


def runtime_stats(runs: DataFrame, exact: bool = True) -> DataFrame:
    """Runs, median, 95th percentile, total cost and error rate per job and day.

    Columns used: ``job, ts, cost, failed``. Exact percentiles are looked up by rank, so a job that
    makes up much of the log is not gathered in one task; ``exact=False`` uses a sketch in the same
    pass as the other measures.
    """
    daily = runs.withColumn("day", F.to_date("ts"))
    measures = [F.count(F.lit(1)).alias("runs"), F.sum(money("cost")).cast("double").alias("total"),
                F.count_if("failed").alias("_failed")]
    if not exact:
        measures += [F.percentile_approx("cost", 0.5).alias("p50"),
                     F.percentile_approx("cost", 0.95).alias("p95")]
    stats = daily.groupBy("job", "day").agg(*measures)
    if exact:
        quantiles = group_quantiles(daily, ["job", "day"], "cost", {"p50": 0.5, "p95": 0.95})
        # Null-safe and from the runs' side: a job without a name or without costs keeps its row.
        quantiles = quantiles.withColumnsRenamed({"job": "_job", "day": "_day"})
        stats = stats.join(quantiles, F.col("job").eqNullSafe(F.col("_job"))
                           & F.col("day").eqNullSafe(F.col("_day")), "left")
    return stats.select("job", "day", "runs", "p50", "p95", "total",
                        share(F.col("_failed"), F.col("runs")).alias("error_rate"))


def runtime_alerts(runs: DataFrame, budget: float, days: int = 7, factor: float = 1.5) -> DataFrame:
    """Cost per job and day against the mean over the days before it, and spent against the month's
    budget.

    The days before are calendar days: those on which the job did not run have no cost and do not
    count, and days further back never do. The windows run over one row per job and day.
    """
    daily = (runs.groupBy("job", F.to_date("ts").alias("day"))
             .agg(F.sum(money("cost")).alias("_cost")))
    daily = daily.withColumn("_day", F.unix_date("day"))
    before = Window.partitionBy("job").orderBy("_day").rangeBetween(-days, -1)
    month = (Window.partitionBy("job", F.trunc("day", "month")).orderBy("day")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    history = daily.select(
        "job", "day", F.col("_cost").cast("double").alias("cost"),
        F.sum("_cost").over(before).cast("double").alias("_sum"),
        F.count("_cost").over(before).cast("double").alias("_n"),
        F.sum("_cost").over(month).cast("double").alias("spent_in_month"))
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    return history.withColumn("mean_before", mean).select(
        "job", "day", "cost", "mean_before", "spent_in_month",
        F.coalesce(F.col("cost") > F.col("mean_before") * F.lit(factor), F.lit(False))
        .alias("is_unusual"),
        (F.col("spent_in_month") > F.lit(float(budget))).alias("over_budget"))
