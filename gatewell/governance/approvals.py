"""The state of approvals, folded from their event log."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.operators.running import MAX_GROUP, running_sum

REQUESTED, APPROVED, REJECTED, PENDING = "requested", "approved", "rejected", "pending"


def episodes(log: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per request: when it was opened and the first decision after it.

    A new request starts a new episode; later decisions in an episode, and decisions before any
    request, have no effect. Columns used: ``event_id, ts, approval_id, action``.
    """
    log = log.where(F.col("approval_id").isNotNull()).select("approval_id", "ts", "event_id",
                                                             "action")
    is_request = F.col("action") == REQUESTED
    numbered = running_sum(log, ["approval_id"], "ts", "event_id",
                           F.when(is_request, 1).otherwise(0), "episode", max_group)
    decision = F.when(F.col("action").isin(APPROVED, REJECTED),
                      F.struct("ts", "event_id", "action"))
    return (numbered.where(F.col("episode") > 0).groupBy("approval_id", "episode")
            .agg(F.min(F.when(F.col("action") == REQUESTED, F.col("ts"))).alias("requested_at"),
                 F.min(decision).alias("_first"))
            .select("approval_id", "episode", "requested_at",
                    F.coalesce("_first.action", F.lit(PENDING)).alias("state"),
                    F.col("_first.ts").alias("decided_at")))


def current_state(log: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """The latest episode per approval id, for every id that ever made a request."""
    latest = F.max_by(F.struct("state", "requested_at", "decided_at"), "episode")
    return (episodes(log, max_group).groupBy("approval_id")
            .agg(F.count(F.lit(1)).alias("episodes"), latest.alias("_last"))
            .select("approval_id", "episodes", "_last.state", "_last.requested_at",
                    "_last.decided_at"))


LOG_SCHEMA = ("event_id bigint, ts timestamp_ntz, approval_id string, pipeline_id string, "
              "stage string, action string, actor string, comment string, artifacts string")


class ApprovalLog:
    """Requests and decisions appended to a folder; the state is always folded from the events."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was appended yet
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def _append(self, ts, approval_id, pipeline_id, stage, action, actor, comment,
                artifacts=None) -> None:
        # Only the events of this approval are looked at; its events are numbered among themselves.
        latest = (self.events().where(F.col("approval_id") == approval_id)
                  .agg(F.max("event_id").alias("n")).first()["n"])
        row = (0 if latest is None else latest + 1, ts, approval_id, pipeline_id, stage, action,
               actor, comment, artifacts)
        (self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1)
         .write.mode("append").parquet(self.path))

    def request(self, pipeline_id: str, stage: str, description: str, ts: datetime.datetime,
                actor: str = "build", artifacts: Mapping[str, Any] | None = None) -> str:
        """Open a request; the same request at the same time has the same id.

        ``artifacts`` name what the request is about.
        """
        text = "|".join((pipeline_id, stage, description, ts.isoformat()))
        approval_id = f"{pipeline_id}_{stage}_{hashlib.sha256(text.encode()).hexdigest()[:16]}"
        self._append(ts, approval_id, pipeline_id, stage, REQUESTED, actor, description,
                     json.dumps(dict(artifacts or {}), sort_keys=True, default=str))
        return approval_id

    def artifacts(self, approval_id: str) -> dict[str, Any]:
        """What the latest request of an id is about; empty for an unknown id."""
        row = (self.events().where((F.col("approval_id") == approval_id)
                                   & (F.col("action") == REQUESTED))
               .agg(F.max_by("artifacts", "event_id").alias("a")).first())
        return json.loads(row["a"]) if row["a"] else {}

    def status(self, approval_id: str) -> str | None:
        """pending, approved or rejected; None for an id without a request."""
        row = current_state(self.events().where(F.col("approval_id") == approval_id)).first()
        return row["state"] if row else None

    def _decide(self, approval_id: str, action: str, actor: str, comment: str,
                ts: datetime.datetime) -> bool:
        if self.status(approval_id) != PENDING:
            return False
        request = self.events().where((F.col("approval_id") == approval_id)
                                      & (F.col("action") == REQUESTED)).first()
        self._append(ts, approval_id, request["pipeline_id"], request["stage"], action, actor,
                     comment)
        return True

    def approve(self, approval_id: str, approver: str, ts: datetime.datetime,
                comment: str = "") -> bool:
        """True when the request was pending; otherwise nothing changes."""
        return self._decide(approval_id, APPROVED, approver, comment, ts)

    def reject(self, approval_id: str, approver: str, ts: datetime.datetime,
               reason: str = "") -> bool:
        return self._decide(approval_id, REJECTED, approver, reason, ts)
