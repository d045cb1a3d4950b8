"""Versioned tables: every write is a new physical table, the public name is a view on one of them.

The version log is a table that is only appended to. A rollback appends too, so the history of
what was visible when is never lost.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gatewell.functions import quoted

LOG_SCHEMA = "name string, version bigint, physical_name string, action string, ts timestamp"
STAGED = "staged"
ATTEMPT = "gatewell.attempt"


class VersionedTable:
    """One public name and its physical tables. One writer at a time is assumed.

    The log also holds what was staged, without a version. A physical table belongs to one write or
    to one run, so nothing that waits can be overwritten by another build.
    """

    def __init__(self, spark: SparkSession, name: str, log: str):
        self.spark, self.name, self.log = spark, name, log

    def _log(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.log):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.table(self.log).where(F.col("name") == self.name)

    def _history(self) -> DataFrame:
        return self._log().where(F.col("action") != STAGED)

    def current(self) -> tuple[int, str] | None:
        """(version, physical table) the public name shows."""
        last = self._history().agg(F.max_by(F.struct("version", "physical_name"), "version")
                                   .alias("v")).first()["v"]
        return (last["version"], last["physical_name"]) if last else None

    def _next(self) -> int:
        now = self.current()
        return (now[0] if now else 0) + 1

    def _was_shown(self, physical: str) -> bool:
        return not self._history().where(F.col("physical_name") == physical).isEmpty()

    def staged_name(self, run_id: str) -> str:
        """The physical table of a run."""
        return f"{self.name}__r{hashlib.sha256(run_id.encode()).hexdigest()[:16]}"

    def stage(self, df: DataFrame, run_id: str, ts: datetime.datetime, *measures
              ) -> tuple[str, dict]:
        """Write a frame as the table of a run without showing it, and log that.

        A run that is tried again replaces what it staged, but never a table that was shown.
        ``measures`` are aggregates computed while the rows are written.
        """
        physical = self.staged_name(run_id)
        if self._was_shown(physical):
            raise ValueError(f"run {run_id} has already shown a version of {self.name}")
        seen = self._write(df, physical, *measures)
        self.spark.sql(f"ALTER TABLE {_quoted(physical)} SET TBLPROPERTIES "
                       f"('{ATTEMPT}' = '{uuid.uuid4().hex}')")
        if self._log().where((F.col("physical_name") == physical)
                             & (F.col("action") == STAGED)).isEmpty():
            self._append(physical, None, STAGED, ts)
        return physical, seen

    def attempt(self, physical: str) -> str | None:
        """Which try staged the rows that a table holds now; None if there is no such table."""
        if not self.spark.catalog.tableExists(physical):
            return None
        kept = {r["key"]: r["value"] for r in
                self.spark.sql(f"SHOW TBLPROPERTIES {_quoted(physical)}").collect()}
        return kept.get(ATTEMPT)

    def _write(self, df: DataFrame, physical: str, *measures) -> dict:
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures)
         .write.mode("overwrite").format("parquet").saveAsTable(physical))
        return seen.get

    def _append(self, physical: str, version: int | None, action: str, ts: datetime.datetime
                ) -> None:
        (self.spark.createDataFrame([(self.name, version, physical, action, ts)], LOG_SCHEMA)
         .coalesce(1).write.mode("append").format("parquet").saveAsTable(self.log))

    def _show(self, physical: str, version: int, action: str, ts: datetime.datetime) -> None:
        self._append(physical, version, action, ts)
        self.spark.sql(f"CREATE OR REPLACE VIEW {_quoted(self.name)} AS "
                       f"SELECT * FROM {_quoted(physical)}")

    def show(self, physical: str, ts: datetime.datetime) -> int:
        """Point the public name at a table that was staged for it and not shown yet."""
        staged = self._log().where((F.col("physical_name") == physical)
                                   & (F.col("action") == STAGED))
        if staged.isEmpty() or not self.spark.catalog.tableExists(physical):
            raise ValueError(f"{physical} is not staged for {self.name}")
        if self._was_shown(physical):
            raise ValueError(f"{physical} was already shown as {self.name}")
        version = self._next()
        self._show(physical, version, "write", ts)
        return version

    def discard(self, physical: str) -> bool:
        """Drop a staged table; one that was ever shown stays. True if it was dropped."""
        if self._was_shown(physical) or not physical.startswith(f"{self.name}__r"):
            return False
        self.spark.sql(f"DROP TABLE IF EXISTS {_quoted(physical)}")
        return True

    def write(self, df: DataFrame, ts: datetime.datetime) -> int:
        version = self._next()
        physical = f"{self.name}__v{version}"
        self._write(df, physical)
        self._show(physical, version, "write", ts)
        return version

    def rollback_last_change(self, ts: datetime.datetime) -> int:
        """Show again what was visible before the last change.

        A rollback is itself a change: the version it undoes is skipped when rolling back further.
        """
        rows = self._history().orderBy("version").collect()  # one row per publish of this table
        visible: list[str] = []
        for row in rows:
            if row["action"] == "rollback":
                visible.pop()
            else:
                visible.append(row["physical_name"])
        if len(visible) < 2:
            raise ValueError(f"{self.name} has no earlier version")
        version = rows[-1]["version"] + 1
        self._show(visible[-2], version, "rollback", ts)
        return version


def _quoted(name: str) -> str:
    return ".".join(quoted(p) for p in name.split("."))
