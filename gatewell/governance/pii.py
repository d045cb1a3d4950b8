"""Tagging columns that hold personal data, and views that hide it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gatewell.functions import quoted
from gatewell.functions.detectors import DETECTORS, found, masked_sql


def match_rates(df: DataFrame, table: str, cut_off: float = 0.01) -> DataFrame:
    """Per text column and detector: rows that match, their rate, and whether to tag the column.

    One aggregate over the whole table, all columns and detectors at once.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    measures = [F.count(F.lit(1)).alias("total")]
    rows = []
    for i, name in enumerate(columns):
        for detector in DETECTORS:
            alias = f"m{i}_{detector}"
            measures.append(F.count_if(found(F.col(quoted(name)), detector)).alias(alias))
            rows.append(F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("column_name"),
                                 F.lit(detector).alias("detector"),
                                 F.col(alias).alias("match_rows"),
                                 F.col("total").alias("total_rows")))
    rate = F.when(F.col("total_rows") > 0, F.col("match_rows").cast("double")
                  / F.col("total_rows").cast("double")).otherwise(F.lit(0.0))
    return (df.agg(*measures).select(F.inline(F.array(*rows)))
            .withColumn("match_rate", rate)
            .withColumn("tagged", F.col("match_rate") >= F.lit(cut_off)))


def tag_tables(frames: Mapping[str, DataFrame], cut_off: float = 0.01) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [match_rates(df, name, cut_off) for name, df in frames.items()])


def _mask_sql(name: str, rule: str) -> str:
    column = quoted(name)
    if rule == "redact":
        return masked_sql(column)
    if rule == "hash":
        return f"sha2(CAST({column} AS STRING), 256)"
    if rule == "shape":
        return f"mask({column})"
    raise ValueError(f"unknown masking rule: {rule}")


def mask_columns(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Mask columns: ``redact`` replaces matches in text, ``hash`` hides a key but keeps joins
    possible, ``shape`` keeps only the shape of a short string."""
    return df.withColumns({name: F.expr(_mask_sql(name, rule)) for name, rule in rules.items()})


def create_masked_view(spark: SparkSession, view: str, table: str,
                       rules: Mapping[str, str]) -> None:
    """A catalog view of a table with the columns masked; readers need no access to the table."""
    columns = ", ".join(
        f"{_mask_sql(c, rules[c])} AS {quoted(c)}" if c in rules else quoted(c)
        for c in spark.table(table).columns)
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(view)} AS SELECT {columns} FROM {_quoted(table)}")


def comment_tags(spark: SparkSession, tags: DataFrame, table: str) -> None:
    """Record the detectors that tagged a column in the comments of the table's columns."""
    rows = (tags.where(F.col("tagged") & (F.col("table_name") == table))
            .select("column_name", "detector").collect())  # one row per column and detector
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row["column_name"], []).append(row["detector"])
    for column, detectors in found.items():
        spark.sql(f"ALTER TABLE {_quoted(table)} ALTER COLUMN {quoted(column)} "
                  f"COMMENT 'pii: {', '.join(sorted(detectors))}'")


def _quoted(name: str) -> str:
    return ".".join(quoted(p) for p in name.split("."))


def rules_from_tags(tags: DataFrame, table: str) -> dict[str, str]:
    """Redact every tagged column of a table. Tags are one row per column and detector."""
    rows = (tags.where(F.col("tagged") & (F.col("table_name") == table))
            .select("column_name").distinct().collect())
    return {row["column_name"]: "redact" for row in rows}
