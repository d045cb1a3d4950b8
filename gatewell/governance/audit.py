"""Who did what and when: an append-only log that can be retried safely."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT_SCHEMA = "event_id bigint, ts timestamp_ntz, actor string, action string, details string"


def append_audit(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append a batch of audit rows below ``path``, one folder per batch and day.

    A batch that is written again, after a failure half-way, replaces itself and nothing else.
    """
    (rows.withColumn("batch_id", F.lit(batch_id)).withColumn("day", F.to_date("ts"))
     .hint("rebalance", "day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "day").parquet(path))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{AUDIT_SCHEMA}, batch_id string, day date").parquet(path)


def log_actions(spark: SparkSession, path: str, batch_id: str, ts: datetime.datetime, actor: str,
                actions: Sequence[tuple[str, Mapping[str, Any]]]) -> list[dict[str, Any]]:
    """Append a few actions of one actor, in order, and return the entries."""
    entries = [{"event_id": number, "ts": ts, "actor": actor, "action": action,
                "details": json.dumps(dict(details), sort_keys=True, default=str)}
               for number, (action, details) in enumerate(actions)]
    rows = [tuple(entry.values()) for entry in entries]
    append_audit(spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(1), path, batch_id)
    return entries
