"""Progress of builds through their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewell.functions import elapsed_micros, share
from gatewell.operators.running import MAX_GROUP, next_time

# The stages of a build, in order.
STAGES = ("planning", "querying", "notebook_generation", "quality_checks", "approval",
          "deployment", "completed")


def time_in_stage(log: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Visits and time spent per build and stage; the last stage of a build has no end yet."""
    timed = next_time(log, ["pipeline_id"], "ts", "event_id", "_next", max_group)
    spent = F.coalesce(elapsed_micros(F.col("ts"), F.col("_next")), F.lit(0))
    return timed.groupBy("pipeline_id", "stage").agg(
        F.count(F.lit(1)).alias("visits"), F.sum(spent).alias("micros_in_stage"))


def latest_stage(log: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("stage", "ts"), F.struct("ts", "event_id"))
    return (log.groupBy("pipeline_id").agg(last.alias("_last"))
            .select("pipeline_id", F.col("_last.stage").alias("stage"),
                    F.col("_last.ts").alias("since")))


def stage_reach(log: DataFrame) -> DataFrame:
    """How many builds ever reached each stage, and their share of all builds."""
    per_build = log.groupBy("pipeline_id").agg(*[
        F.max((F.col("stage") == stage).cast("int")).alias(stage) for stage in STAGES])
    totals = per_build.agg(F.count(F.lit(1)).alias("_all"), *[
        F.coalesce(F.sum(stage), F.lit(0)).alias(stage) for stage in STAGES])
    rows = [F.struct(F.lit(n + 1).cast("bigint").alias("stage_no"), F.lit(stage).alias("stage"),
                     F.col(stage).alias("builds"),
                     share(F.col(stage), F.col("_all")).alias("share"))
            for n, stage in enumerate(STAGES)]
    return totals.select(F.inline(F.array(*rows)))
