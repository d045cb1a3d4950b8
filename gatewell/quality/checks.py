"""What each check type measures.

A check is turned into aggregates over the checked frame and a verdict over their results. Types
that are plain aggregates (``FUSED``) share one pass over the data with all others of their kind.
Types that need a grouping or a join (``SHAPED``) bring their own one-row plan.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gatewell.functions import hours_between, literal, quoted, share
from gatewell.operators.joins import orphan_keys
from gatewell.plans.spec import Check

ERROR, WARN = "error", "warn"
# Severity when a check names none: nulls and duplicate rows are reported, the rest must hold.
DEFAULT_SEVERITY = {"null_counts": WARN, "duplicate_rows": WARN}

RESULT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("passed", T.BooleanType()),
    T.StructField("observed", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])


@dataclass(frozen=True)
class Context:
    as_of: datetime.datetime | None = None
    parents: Mapping[str, DataFrame] | None = None


@dataclass(frozen=True)
class Verdict:
    passed: Column
    observed: Column
    threshold: Column
    details: Mapping[str, Column]


@dataclass(frozen=True)
class Measured:
    """Aggregates by name, and the verdict given a function from those names to columns."""

    measures: Mapping[str, Column]
    verdict: Callable[[Callable[[str], Column]], Verdict]


def _rows() -> Column:
    return F.count(F.lit(1))


def severity_of(check: Check) -> str:
    severity = check.severity or DEFAULT_SEVERITY.get(check.type, ERROR)
    if severity not in (ERROR, WARN):
        raise ValueError(f"unknown severity: {severity}")
    return severity


def _number(value: float | int | None) -> Column:
    return F.lit(None if value is None else float(value)).cast("double")


def _needs(check: Check, *fields: str) -> None:
    for field in fields:
        if not getattr(check, field):
            raise ValueError(f"{check.type} needs {field}")


def row_count(check: Check, df: DataFrame, ctx: Context) -> Measured:
    def verdict(m):
        passed = m("rows") >= check.min_rows
        if check.max_rows is not None:
            passed = passed & (m("rows") <= check.max_rows)
        details = {"row_count": m("rows"), "min_rows": F.lit(check.min_rows)}
        if check.max_rows is not None:
            details["max_rows"] = F.lit(check.max_rows)
        return Verdict(passed, m("rows"), _number(check.min_rows), details)
    return Measured({"rows": _rows()}, verdict)


def not_empty(check: Check, df: DataFrame, ctx: Context) -> Measured:
    return Measured({"rows": _rows()}, lambda m: Verdict(
        m("rows") > 0, m("rows"), _number(1), {"row_count": m("rows")}))


def null_check(check: Check, df: DataFrame, ctx: Context) -> Measured:
    """Percentage of nulls per column; fails above the threshold, passes when exactly on it."""
    _needs(check, "columns")
    measures = {"rows": _rows()}
    for n, name in enumerate(check.columns):
        measures[f"nulls{n}"] = F.count_if(F.col(quoted(name)).isNull())

    def verdict(m):
        percent = [share(m(f"nulls{n}"), m("rows")) * 100 for n in range(len(check.columns))]
        worst = F.greatest(*percent) if len(percent) > 1 else percent[0]
        return Verdict(worst <= check.threshold, worst, _number(check.threshold),
                       dict(zip(check.columns, percent)))
    return Measured(measures, verdict)


def null_counts(check: Check, df: DataFrame, ctx: Context) -> Measured:
    """Null count of every column; any null is an issue."""
    names = check.columns or tuple(df.columns)
    measures = {f"nulls{n}": F.count_if(F.col(quoted(name)).isNull())
                for n, name in enumerate(names)}

    def verdict(m):
        counts = [m(f"nulls{n}") for n in range(len(names))]
        total = F.aggregate(F.array(*counts), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return Verdict(total == 0, total, _number(0), dict(zip(names, counts)))
    return Measured(measures, verdict)


def freshness(check: Check, df: DataFrame, ctx: Context) -> Measured:
    """Age of the newest row at ``as_of``; no newest row means not fresh."""
    _needs(check, "timestamp_column")
    if ctx.as_of is None:
        raise ValueError("freshness needs as_of")

    def verdict(m):
        age = hours_between(m("latest"), literal(ctx.as_of))
        return Verdict(F.coalesce(age <= check.max_age_hours, F.lit(False)), age,
                       _number(check.max_age_hours), {"latest": m("latest")})
    return Measured({"latest": F.max(quoted(check.timestamp_column))}, verdict)


def expectation(check: Check, df: DataFrame, ctx: Context) -> Measured:
    """A SQL predicate every row must meet; null counts as not met."""
    _needs(check, "predicate")
    unmet = ~F.coalesce(F.expr(check.predicate), F.lit(False))

    def verdict(m):
        percent = share(m("unmet"), m("rows")) * 100
        return Verdict(percent <= check.threshold, m("unmet"), _number(check.threshold),
                       {"failing_rows": m("unmet"), "failing_percentage": percent})
    return Measured({"rows": _rows(), "unmet": F.count_if(unmet)}, verdict)


def accepted_values(check: Check, df: DataFrame, ctx: Context) -> Measured:
    """Rows with a value outside the allowed set in any of the columns; null is left to the null
    checks."""
    _needs(check, "columns", "values")
    wrong = F.lit(False)
    for name in check.columns:
        value = F.col(quoted(name))
        wrong = wrong | (value.isNotNull() & ~value.isin(*check.values))
    return Measured({"outside": F.count_if(wrong)}, lambda m: Verdict(
        m("outside") == 0, m("outside"), _number(0), {"rows_outside": m("outside")}))


FUSED = {
    "row_count": row_count, "not_empty": not_empty, "null_check": null_check,
    "null_counts": null_counts, "freshness": freshness, "expectation": expectation,
    "accepted_values": accepted_values,
}


def repeated_keys(df: DataFrame, columns) -> DataFrame:
    """Key values that occur more than once, with how often."""
    return (df.groupBy(*[F.col(quoted(c)) for c in columns])
            .agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1))


# JSON text that keeps apart what differs: nulls are written, times keep their microseconds.
EXACT_JSON = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def comparable(df: DataFrame) -> DataFrame:
    """Maps and variants cannot be grouped; they take part as canonical JSON text."""
    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, (T.MapType, T.VariantType)):
            return True
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind)

    def plain(value: Column, kind: T.DataType) -> Column:
        """Maps, at any depth, as sorted lists of entries: their order carries no meaning."""
        if not has_map(kind):
            return value
        if isinstance(kind, T.MapType):
            entries = F.transform(F.map_entries(value), lambda e: F.to_json(F.struct(
                plain(e["key"], kind.keyType).alias("k"),
                plain(e["value"], kind.valueType).alias("v")), EXACT_JSON))
            return F.when(value.isNotNull(), F.array_sort(entries))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: plain(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[
                plain(value[f.name], f.dataType).alias(f.name) for f in kind]))
        return F.to_json(value, EXACT_JSON)  # a variant

    def as_key(field: T.StructField) -> Column:
        value = F.col(quoted(field.name))
        if not has_map(field.dataType):
            return value
        return F.when(value.isNotNull(), F.to_json(F.struct(
            plain(value, field.dataType).alias("v")), EXACT_JSON))

    return df.select(*[as_key(f).alias(f.name) for f in df.schema.fields])


def duplicate_count(df: DataFrame, wide: bool = False) -> DataFrame:
    """One row: total rows, distinct rows and the difference.

    ``wide`` shuffles a 256-bit digest in place of rows with long text.
    """
    rows = comparable(df)
    if wide:
        # Adding zero makes -0.0 equal to 0.0, as it is in a grouping.
        cells = [(F.col(quoted(f.name)) + 0.0 if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                  else F.col(quoted(f.name))).alias(f.name) for f in rows.schema]
        whole = F.to_json(F.struct(*cells), EXACT_JSON)
        rows = rows.select(F.unhex(F.sha2(whole, 256)).alias("digest"))
    grouped = (rows.groupBy(*[F.col(quoted(c)) for c in rows.columns])
               .agg(F.count(F.lit(1)).alias("_copies")))
    return grouped.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
                       F.count(F.lit(1)).alias("distinct_rows")).withColumn(
        "duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def duplicate_rows(check: Check, df: DataFrame, ctx: Context) -> tuple[DataFrame, Verdict]:
    if check.columns:
        df = df.select(*[F.col(quoted(c)) for c in check.columns])
    extra = F.col("duplicate_rows")
    return duplicate_count(df, wide=True), Verdict(extra == 0, extra, _number(0), {
        "total_rows": F.col("total_rows"), "duplicate_rows": extra})


def unique(check: Check, df: DataFrame, ctx: Context) -> tuple[DataFrame, Verdict]:
    _needs(check, "columns")
    found = repeated_keys(df, check.columns).agg(
        F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("rows"))
    return found, Verdict(F.col("keys") == 0, F.col("keys"), _number(0), {
        "repeated_keys": F.col("keys"), "rows_involved": F.col("rows")})


def relationship(check: Check, df: DataFrame, ctx: Context) -> tuple[DataFrame, Verdict]:
    _needs(check, "columns", "parent", "parent_column")
    parent = (ctx.parents or {}).get(check.parent)
    if parent is None:
        raise ValueError(f"relationship parent not given: {check.parent}")
    # Each column refers to the parent's column by itself.
    orphans = reduce(DataFrame.unionAll, [
        orphan_keys(df, parent, c, check.parent_column).select("rows") for c in check.columns])
    found = orphans.agg(F.count(F.lit(1)).alias("keys"),
                        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return found, Verdict(F.col("rows") == 0, F.col("rows"), _number(0), {
        "orphan_keys": F.col("keys"), "orphan_rows": F.col("rows")})


SHAPED = {"duplicate_rows": duplicate_rows, "unique": unique, "relationship": relationship}
