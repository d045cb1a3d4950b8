"""Running a declared build: load, transform, check, and show the result only if it passes."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

from pyspark.errors import (
    AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException,
    NumberFormatException, SparkRuntimeException,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.governance.approvals import APPROVED, REJECTED, ApprovalLog
from gatewell.governance.audit import log_actions
from gatewell.governance.lineage import column_edges
from gatewell.operators.steps import apply_steps
from gatewell.plans.spec import Check, Spec
from gatewell.quality.checks import SHAPED
from gatewell.quality.suite import QualityGateError, Suite, gate, report, roll_up, run_suite
from gatewell.sinks.tables import overwrite_partitions
from gatewell.sinks.versions import VersionedTable
from gatewell.sources.catalog import load_tables, require_tables

# What every build is checked for, beside its own checks.
STANDARD_CHECKS = (
    Check(name="null_counts", type="null_counts"),
    Check(name="duplicate_rows", type="duplicate_rows"),
    Check(name="not_empty", type="not_empty"),
)


@dataclass(frozen=True)
class BuildLog:
    """Where builds record what they did. Tables and folders are created on first use."""

    versions: str
    quality_results: str
    lineage_edges: str
    audit_path: str
    approvals_path: str


@dataclass(frozen=True)
class BuildResult:
    """``version`` is None while the staged table waits for approval."""

    physical: str
    rows: int
    warnings: list[str]
    version: int | None = None
    approval_id: str | None = None


def run_build(spark: SparkSession, spec: Spec, run_id: str, ts: datetime.datetime, log: BuildLog,
              actor: str = "build", require_approval: bool = False) -> BuildResult:
    """Build the target table of a spec.

    The result is computed once, into a table of this run that nobody sees yet. Aggregate-shaped
    checks are measured while it is written; the others read the written table. If the gate closes,
    the staged table is dropped and the target keeps its previous version. With
    ``require_approval`` the staged table waits for ``release``; other builds of the target may be
    staged and shown meanwhile. A run that is tried again replaces its own records.
    """
    require_tables(spark, spec.source_tables)
    inputs = load_tables(spark, spec.source_tables)
    result = apply_steps(inputs, spec.transformations)
    target = VersionedTable(spark, spec.target_table, log.versions)

    physical, rows, results = stage_checked(target, result, spec, run_id, ts, inputs)
    _record(report(results, run_id, spec.target_table, ts), log.quality_results, run_id)
    verdict = roll_up(results).first()
    log_actions(spark, log.audit_path, f"{run_id}-checked", ts, actor, [
        ("stage", {"pipeline_id": run_id, "stage": "planning", "sources": spec.source_tables}),
        ("stage", {"pipeline_id": run_id, "stage": "quality_checks"}),
        ("quality_validation", {"table": spec.target_table, "checks": verdict["checks"],
                                "failed": verdict["failed"], "passed": verdict["passed"]})])
    try:
        warnings = gate(results)
    except QualityGateError:
        target.discard(physical)
        raise
    _record(column_edges(inputs, spec.transformations, spec.target_table, run_id, ts),
            log.lineage_edges, run_id)
    if require_approval:
        approval = ApprovalLog(spark, log.approvals_path).request(
            run_id, "approval", f"show {physical} as {spec.target_table}", ts, actor,
            {"staged": physical, "target": spec.target_table, "rows": rows,
             "attempt": target.attempt(physical)})
        log_actions(spark, log.audit_path, f"{run_id}-staged", ts, actor, [
            ("stage", {"pipeline_id": run_id, "stage": "approval", "approval_id": approval})])
        return BuildResult(physical, rows, warnings, approval_id=approval)
    return _show(target, BuildResult(physical, rows, warnings), run_id, ts, log, actor)


def release(spark: SparkSession, spec: Spec, staged: BuildResult, run_id: str,
            ts: datetime.datetime, log: BuildLog, actor: str = "build") -> BuildResult:
    """Show a staged table if its approval was given; drop it if it was rejected.

    The approval must name this table, this target and the try that staged the rows: if the run was
    tried again since, what was approved is gone and the new rows need their own approval. A second release is refused, and a table
    that was shown is never dropped.
    """
    approvals = ApprovalLog(spark, log.approvals_path)
    target = VersionedTable(spark, spec.target_table, log.versions)
    named = approvals.artifacts(staged.approval_id)
    if (named.get("staged"), named.get("target")) != (staged.physical, spec.target_table):
        raise PermissionError(f"{staged.approval_id} is not about {staged.physical}")
    if named.get("attempt") != target.attempt(staged.physical):
        raise PermissionError(f"{staged.approval_id} is not about what {staged.physical} holds now")
    state = approvals.status(staged.approval_id)
    if state == REJECTED:
        target.discard(staged.physical)
    if state != APPROVED:
        raise PermissionError(f"{staged.approval_id} is {state}")
    return _show(target, staged, run_id, ts, log, actor)


def _show(target: VersionedTable, staged: BuildResult, run_id: str, ts: datetime.datetime,
          log: BuildLog, actor: str) -> BuildResult:
    version = target.show(staged.physical, ts)
    log_actions(target.spark, log.audit_path, f"{run_id}-shown", ts, actor, [
        ("published", {"table": target.name, "version": version, "rows": staged.rows}),
        ("stage", {"pipeline_id": run_id, "stage": "completed"})])
    return replace(staged, version=version)


def _record(rows: DataFrame, table: str, run_id: str) -> None:
    """Append what a run found, in a partition of its own that a second try replaces."""
    spark = rows.sparkSession
    rows = rows.select(*[c for c in rows.columns if c != "run_id"],
                       F.lit(run_id).alias("run_id")).coalesce(1)
    if spark.catalog.tableExists(table):
        overwrite_partitions(rows.select(*spark.table(table).columns), table, "run_id")
    else:
        rows.write.format("parquet").partitionBy("run_id").saveAsTable(table)


# What the engine raises when a check cannot be evaluated on the rows, as against a failed write.
_EVALUATION_ERRORS = (AnalysisException, ArithmeticException, NumberFormatException,
                      SparkRuntimeException, DateTimeException, IllegalArgumentException)


def stage_checked(target: VersionedTable, result: DataFrame, spec: Spec, run_id: str,
                  ts: datetime.datetime, parents: dict[str, DataFrame]
                  ) -> tuple[str, int, DataFrame]:
    """(staged table, rows, check results). The results are held as rows on the driver."""
    spark = result.sparkSession
    checks = [*STANDARD_CHECKS, *spec.quality_checks]
    suite = Suite(result, checks, ts, parents)
    try:
        physical, seen = target.stage(result, run_id, ts, *suite.measures)
    except _EVALUATION_ERRORS:
        # A check may be what stopped the write: write without checks, then check one by one.
        physical, seen = target.stage(result, run_id, ts)
        return physical, seen["rows"], run_suite(spark.table(physical), checks, ts, parents)
    types = result.agg(*suite.measures).schema
    measured = spark.createDataFrame([tuple(seen[name] for name in types.names)], types)
    results = suite.verdicts(measured, shaped=False)
    shaped = [c for c in checks if c.type in SHAPED]
    if shaped:
        results = results.unionByName(run_suite(spark.table(physical), shaped, ts, parents))
    rows = results.collect()  # one row per check
    return physical, seen["rows"], spark.createDataFrame(rows, results.schema)


def default_log(database: str, folder: str) -> BuildLog:
    """Logs in ``database`` and below ``folder``, which must outlive the session: a pending approval
    is found again by the same two names."""
    return BuildLog(f"{database}.table_versions", f"{database}.quality_results",
                    f"{database}.lineage_edges", f"{folder.rstrip('/')}/audit",
                    f"{folder.rstrip('/')}/approvals")
