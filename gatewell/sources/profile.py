"""Column profiles: nulls, distinct values, range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gatewell.functions import elapsed_micros, quoted

# Fields of a profile row. Numbers and text keep separate columns, so no number becomes text.
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def _as_number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, NUMERIC):
        return value.cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(kind, T.DateType):  # seconds since 1970, as for times
        return F.unix_date(value).cast("double") * F.lit(86_400.0)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double") / F.lit(1_000_000.0)
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return elapsed_micros(epoch, value).cast("double") / F.lit(1_000_000.0)
    return F.lit(None).cast("double")


def _as_text(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def _fields(name: str, kind: T.DataType, rows: Column, nulls: Column, distinct: Column,
            low: Column, high: Column) -> list[Column]:
    return [F.lit(name).alias("column_name"), F.lit(kind.simpleString()).alias("data_type"),
            (rows - nulls).alias("non_null"), nulls.alias("nulls"),
            distinct.alias("distinct_values"),
            _as_number(low, kind).alias("min_number"), _as_number(high, kind).alias("max_number"),
            _as_text(low, kind).alias("min_text"), _as_text(high, kind).alias("max_text")]


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column.

    By default one pass with a distinct-count sketch. ``exact`` counts values per column: each
    column is read alone and reduced to its values on the map side, which avoids the row blow-up
    of several exact distinct counts in one aggregate.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if exact:
        return reduce(DataFrame.unionByName, [_exact(df, n, k) for n, k in kinds.items()])
    measures, rows = [F.count(F.lit(1)).alias("rows")], []
    for number, (name, kind) in enumerate(kinds.items()):
        value = F.col(quoted(name))
        measures += [F.count_if(value.isNull()).alias(f"nulls{number}"),
                     F.approx_count_distinct(value).alias(f"distinct{number}"),
                     F.min(value).alias(f"min{number}"), F.max(value).alias(f"max{number}")]
        rows.append(F.struct(*_fields(
            name, kind, F.col("rows"), F.col(f"nulls{number}"), F.col(f"distinct{number}"),
            F.col(f"min{number}"), F.col(f"max{number}"))))
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def _exact(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    values = df.groupBy(F.col(quoted(name)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    summary = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
    return summary.select(*_fields(name, kind, F.col("rows"), F.col("nulls"), F.col("distinct"),
                                   F.col("low"), F.col("high")))
