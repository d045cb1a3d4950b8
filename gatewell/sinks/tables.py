"""Writing tables: full refresh, declared tables, append under contract, views, backfill."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from gatewell.functions import quoted
from gatewell.session import scratch_path
from gatewell.sources.contract import split_by_contract


# How a partition of rows without a value is called (a fixed value of the table format).
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def full_refresh(df: DataFrame, table: str, fmt: str = "parquet") -> int:
    """Replace a table and its schema; returns the rows written, counted during the write."""
    counted = Observation()
    (df.observe(counted, F.count(F.lit(1)).alias("rows"))
     .write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table))
    return counted.get["rows"]


def declared_schema(columns: Sequence[Mapping[str, Any]]) -> T.StructType:
    """A schema from ``{name, data_type, nullable=True, comment=None}`` entries."""
    fields = []
    for column in columns:
        kind = T.StructType.fromDDL(f"c {column['data_type']}")[0].dataType
        note = {"comment": column["comment"]} if column.get("comment") else None
        fields.append(T.StructField(column["name"], kind, column.get("nullable", True), note))
    return T.StructType(fields)


def create_table(spark: SparkSession, table: str, columns: Sequence[Mapping[str, Any]],
                 properties: Mapping[str, str] | None = None, fmt: str = "parquet") -> T.StructType:
    """Create a table from declared columns. Raises when it cannot be created."""
    schema = declared_schema(columns)
    spark.catalog.createTable(table, source=fmt, schema=schema)
    if properties:
        name = ".".join(quoted(p) for p in table.split("."))
        pairs = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")
    return schema


def _text(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def append_under_contract(df: DataFrame, table: str, quarantine: str,
                          declared: T.StructType) -> None:
    """Append rows that fit the declared schema; the others go to the quarantine table as text.

    Session catalogs forget NOT NULL, so nullability is checked here, before the write.
    """
    good, bad = split_by_contract(df, declared)
    good.write.mode("append").insertInto(table)
    reasons = F.concat_ws("; ", "reasons").alias("reasons")
    as_text = [F.col(quoted(c)).cast("string").alias(c) for c in df.columns]
    bad.select(*as_text, reasons).write.mode("append").format("parquet").saveAsTable(quarantine)


def materialize_model(spark: SparkSession, name: str, text: str, kind: str = "view",
                      **frames: DataFrame) -> None:
    """A SQL model as a temporary ``view``, or computed once into a ``table``."""
    model = spark.sql(text, **frames)
    if kind == "view":
        model.createOrReplaceTempView(name)
    elif kind == "table":
        model.write.mode("overwrite").format("parquet").saveAsTable(name)
    else:
        raise ValueError(f"unknown materialization: {kind}")


def create_partitioned(df: DataFrame, table: str, partition_by: str) -> None:
    """First load of a partitioned table.

    The rebalance hint groups the rows of a partition value into few files, and lets a value that
    holds much of the data be written by several tasks.
    """
    (df.hint("rebalance", partition_by).write.mode("overwrite").format("parquet")
     .partitionBy(partition_by).saveAsTable(table))


def overwrite_partitions(df: DataFrame, table: str, partition_by: str) -> None:
    """Replace the partitions that occur in the frame and leave all others.

    ``insertInto`` takes the mode from the session only, so the statement runs in a session of its
    own, which shares catalog and data but not settings: other threads see no change.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "partitions")
    df.hint("rebalance", partition_by).write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (own.read.schema(df.schema).parquet(path).hint("rebalance", partition_by)
     .write.mode("overwrite").insertInto(table))
    spark.catalog.refreshTable(table)


def backfill(df: DataFrame, table: str, day_column: str, start: datetime.date,
             end: datetime.date) -> None:
    """Rebuild the day partitions from ``start`` to ``end`` (inclusive); others stay as they are.

    Partitions in the range that have no rows any more are dropped; the table must be a managed one
    for their files to go too. Running it twice leaves the same table.
    """
    spark = df.sparkSession
    in_range = (F.col(day_column) >= F.lit(start)) & (F.col(day_column) <= F.lit(end))
    name = ".".join(quoted(p) for p in table.split("."))
    # One value per day partition; the partition of rows without a day is never in the range.
    before = {_day(row[0]) for row in spark.sql(f"SHOW PARTITIONS {name}").collect()} - {None}
    columns = spark.table(table).columns
    seen = Observation()
    days = F.collect_set(F.col(day_column))  # at most one value per day of the range
    rebuilt = df.where(in_range).select(*columns).observe(seen, days.alias("days"))
    overwrite_partitions(rebuilt, table, day_column)
    written = set(seen.get["days"])
    for day in sorted(before - written):
        if start <= day <= end:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION "
                      f"({quoted(day_column)} = DATE '{day.isoformat()}')")


def _day(partition: str) -> datetime.date | None:
    value = partition.split("=", 1)[1]
    return None if value == NULL_PARTITION else datetime.date.fromisoformat(value)
