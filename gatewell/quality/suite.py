"""Running many checks over one frame in as few passes as possible, and the gate built on it."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gatewell.functions import literal
from gatewell.plans.spec import Check
from gatewell.quality.checks import (
    ERROR, FUSED, RESULT, SHAPED, Context, Verdict, severity_of,
)


class QualityGateError(ValueError):
    """Raised instead of writing when a check of severity ``error`` failed."""


def _row(check: Check, severity: str, verdict: Verdict | None, error: str | None) -> Column:
    if verdict is None:
        passed, observed = F.lit(False), F.lit(None).cast("double")
        threshold, details = F.lit(None).cast("double"), F.lit(None)
    else:
        passed, observed, threshold = verdict.passed, verdict.observed, verdict.threshold
        pairs = [p for k, v in verdict.details.items() for p in (F.lit(k), v.cast("string"))]
        details = F.create_map(*pairs)
    return F.struct(
        F.lit(check.name).alias("name"), F.lit(check.type).alias("type"),
        F.lit(severity).alias("severity"), passed.alias("passed"),
        observed.cast("double").alias("observed"), threshold.cast("double").alias("threshold"),
        details.cast("map<string,string>").alias("details"),
        F.lit(error).cast("string").alias("error"))


def _reason(problem: Exception) -> str:
    return (str(problem).splitlines() or [type(problem).__name__])[0]


class Suite:
    """Checks prepared for one frame.

    ``measures`` are the aggregates of all fused checks; they can run in an ``agg`` or ride along
    with a write. ``verdicts`` turns the one row they give into check rows. A check that cannot be
    prepared becomes a failed row with the reason and does not disturb the others.
    """

    def __init__(self, df: DataFrame, checks: Sequence[Check | Mapping[str, Any]],
                 as_of: datetime.datetime | None = None,
                 parents: Mapping[str, DataFrame] | None = None):
        self.df = df
        self.context = Context(as_of, parents)
        self._measures: list[Column] = [F.count(F.lit(1)).alias("_rows")]
        self._rows: list[tuple[int, Column]] = []
        self._shaped: list[tuple[int, DataFrame]] = []
        for number, entry in enumerate(checks):
            try:
                check = Check.of(entry)
            except ValueError as problem:
                check = Check(name=entry.get("name", Check.name), type=entry.get("type", ""))
                self._rows.append((number, _row(check, ERROR, None, _reason(problem))))
            else:
                self._prepare(number, check)

    def _prepare(self, number: int, check: Check) -> None:
        severity = ERROR
        try:
            severity = severity_of(check)
            if check.type in FUSED:
                measured = FUSED[check.type](check, self.df, self.context)
                measures = [column.alias(f"m{number}_{name}")
                            for name, column in measured.measures.items()]
                self.df.agg(*measures).schema  # resolves names and types, runs nothing
                verdict = measured.verdict(lambda name: F.col(f"m{number}_{name}"))
                self._rows.append((number, _row(check, severity, verdict, None)))
                self._measures += measures
            elif check.type in SHAPED:
                plan, verdict = SHAPED[check.type](check, self.df, self.context)
                self._shaped.append((number, self._numbered(
                    plan, [(number, _row(check, severity, verdict, None))])))
            else:
                raise ValueError(f"unknown check type: {check.type}")
        except (AnalysisException, ValueError) as problem:
            self._rows.append((number, _row(check, severity, None, _reason(problem))))

    @staticmethod
    def _numbered(one_row: DataFrame, rows: Sequence[tuple[int, Column]]) -> DataFrame:
        entries = [F.struct(F.lit(number).alias("no"), row.alias("r")) for number, row in rows]
        return one_row.select(F.inline(F.array(*entries))).select("no", "r.*")

    @property
    def measures(self) -> list[Column]:
        return list(self._measures)

    def verdicts(self, measured: DataFrame, shaped: bool = True) -> DataFrame:
        """Check rows from the one row that holds the measures."""
        parts = [self._numbered(measured, self._rows)] if self._rows else []
        if shaped:
            parts += [plan for _, plan in self._shaped]
        if not parts:
            return self.df.sparkSession.createDataFrame([], RESULT)
        return reduce(DataFrame.unionByName, parts).drop("no")

    def results(self) -> DataFrame:
        """All check rows, evaluated lazily: one pass for the fused checks, one plan per other."""
        return self.verdicts(self.df.agg(*self._measures))


def suite_results(df: DataFrame, checks: Sequence[Check | Mapping[str, Any]],
                  as_of: datetime.datetime | None = None,
                  parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    return Suite(df, checks, as_of, parents).results()


def run_suite(df: DataFrame, checks: Sequence[Check | Mapping[str, Any]],
              as_of: datetime.datetime | None = None,
              parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Evaluate now. If the shared pass stops on an error, each check runs alone, so that the one
    at fault is failed with its error text and the others still give their verdict."""
    spark = df.sparkSession
    try:
        rows = suite_results(df, checks, as_of, parents).collect()  # one row per check
    except Exception:
        rows = []
        for check in checks:
            try:
                rows += suite_results(df, [check], as_of, parents).collect()
            except Exception as problem:
                check = Check.of(check)
                rows.append((check.name, check.type, severity_of(check), False, None, None,
                             None, _reason(problem)))
    return spark.createDataFrame(rows, RESULT)


def roll_up(results: DataFrame) -> DataFrame:
    """One row: how many checks ran and failed, whether all passed, whether the gate opens."""
    blocking = F.col("severity") == ERROR
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & blocking).alias("blocking"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"),
        F.coalesce(F.bool_and(F.col("passed") | ~blocking), F.lit(True)).alias("passed"))


def gate(results: DataFrame) -> list[str]:
    """Raise when a blocking check failed; return the names of failed warnings otherwise."""
    failed = results.where(~F.col("passed")).select("name", "severity", "error").collect()
    blocking = [f"{r['name']}: {r['error']}" if r["error"] else r["name"]
                for r in failed if r["severity"] == ERROR]
    if blocking:
        raise QualityGateError(f"the quality gate is closed: {blocking}")
    return [r["name"] for r in failed]


def validate_output(spark: SparkSession, table: str,
                    checks: Sequence[Check | Mapping[str, Any]],
                    as_of: datetime.datetime | None = None,
                    parents: Mapping[str, DataFrame] | None = None) -> tuple[bool, DataFrame]:
    """(all checks passed, check rows) for a table by name."""
    results = run_suite(spark.table(table), checks, as_of, parents)
    return roll_up(results).first()["all_passed"], results


def report(results: DataFrame, run_id: str, table: str, ts: datetime.datetime) -> DataFrame:
    """Check rows in the shape of the ``quality_results`` table."""
    return results.select(
        F.lit(run_id).alias("run_id"), F.lit(table).alias("table_name"),
        F.col("name").alias("check_name"), "type", "severity", "passed", "observed", "threshold",
        "details", "error", literal(ts).alias("ts"))
