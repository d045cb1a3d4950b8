"""Does a frame hold what was declared for it: columns, types, nullability, castable values?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gatewell.functions import quoted, text_number

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def as_declared(df: DataFrame, field: T.StructField) -> Column:
    """The column in its declared type, null where the value does not fit."""
    value = F.col(quoted(field.name))
    actual = df.schema[field.name].dataType
    if actual == field.dataType:
        return value
    to = field.dataType.simpleString()
    if isinstance(actual, T.StringType) and isinstance(field.dataType, NUMBERS):
        return text_number(value, to)
    return value.try_cast(to)


def contract_check(df: DataFrame, declared: T.StructType) -> DataFrame:
    """One row per declared or extra column.

    ``status`` is ok, missing, extra or type_differs; ``uncastable`` counts values that do not fit
    the declared type and ``null_violations`` nulls where none are allowed. All columns are
    measured in one aggregate.
    """
    actual = {f.name: f for f in df.schema}
    measures: list[Column] = [F.count(F.lit(1)).alias("total")]
    rows: list[Column] = []

    def row(name: str, want: str, have: str, status: str, bad: Column, nulls: Column) -> Column:
        return F.struct(F.lit(name).alias("column_name"), F.lit(want).alias("declared_type"),
                        F.lit(have).alias("actual_type"), F.lit(status).alias("status"),
                        bad.alias("uncastable"), nulls.alias("null_violations"))

    zero = F.lit(0).cast("bigint")
    for number, field in enumerate(declared.fields):
        want = field.dataType.simpleString()
        if field.name not in actual:
            rows.append(row(field.name, want, "", "missing", zero, zero))
            continue
        value = F.col(quoted(field.name))
        fitted = as_declared(df, field)
        measures.append(F.count_if(value.isNotNull() & fitted.isNull()).alias(f"bad{number}"))
        measures.append((F.count_if(value.isNull()) if not field.nullable else zero)
                        .alias(f"null{number}"))
        have = actual[field.name].dataType.simpleString()
        rows.append(row(field.name, want, have, "ok" if have == want else "type_differs",
                        F.col(f"bad{number}"), F.col(f"null{number}")))
    for name in actual:
        if name not in declared.names:
            rows.append(row(name, "", actual[name].dataType.simpleString(), "extra", zero, zero))
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def split_by_contract(df: DataFrame, declared: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows in the declared shape, offending rows with the reasons). Map-only."""
    reasons = []
    for field in declared.fields:
        value, fitted = F.col(quoted(field.name)), as_declared(df, field)
        reasons.append(F.when(value.isNotNull() & fitted.isNull(),
                              F.lit(f"{field.name}: not {field.dataType.simpleString()}")))
        if not field.nullable:
            reasons.append(F.when(value.isNull(), F.lit(f"{field.name}: null")))
    tagged = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    fitted = [as_declared(df, f).alias(f.name) for f in declared.fields]
    return (tagged.where(F.size("reasons") == 0).select(*fitted),
            tagged.where(F.size("reasons") > 0))
