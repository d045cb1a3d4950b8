"""Named tables: do they exist, what do they look like, load them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.functions import quoted


def validate_tables(spark: SparkSession, names: Sequence[str]) -> dict[str, dict[str, Any]]:
    """Existence and column names per ``catalog.schema.table``; problems never raise."""
    found: dict[str, dict[str, Any]] = {}
    for name in names:
        if len(name.split(".")) != 3:
            found[name] = {"exists": False, "error": "Invalid table name format"}
            continue
        try:
            exists = spark.catalog.tableExists(name)
            found[name] = ({"exists": True, "columns": spark.table(name).columns} if exists
                           else {"exists": False, "error": f"Table {name} does not exist"})
        except AnalysisException as problem:  # an unknown catalog
            found[name] = {"exists": False, "error": str(problem).splitlines()[0]}
    return found


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    for name, info in validate_tables(spark, names).items():
        if not info["exists"]:
            raise ValueError(f"Table {name} not found: {info['error']}")


def describe_table(spark: SparkSession, name: str) -> dict[str, Any]:
    """Columns with type, nullability and comment, partition columns and properties."""
    table = ".".join(quoted(part) for part in name.split("."))
    raw = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])
    columns = [{"name": field.name, "data_type": field.dataType.simpleString(),
                "nullable": field.nullable, "comment": field.metadata.get("comment")}
               for field in spark.table(name).schema]
    return {"columns": columns, "partitions": raw.get("partition_columns", []),
            "properties": raw.get("table_properties", {})}


def load_tables(spark: SparkSession, names: Sequence[str]) -> dict[str, DataFrame]:
    """One frame per source, keyed by the full name: leaf names may repeat across schemas."""
    return {name: spark.table(name) for name in names}


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of every source in one job; Parquet answers from its footers."""
    counted = None
    for name, frame in frames.items():
        row = frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        counted = row if counted is None else counted.unionByName(row)
    return counted


def catalog_search(spark: SparkSession, term: str, schema: str | None = None) -> DataFrame:
    """Tables whose name or column names contain the term (catalog metadata only)."""
    hits = []
    for table in spark.catalog.listTables(schema):
        parts = [p for p in ([table.catalog] + (table.namespace or []) + [table.name]) if p]
        full = ".".join(parts)
        for column in spark.table(".".join(quoted(p) for p in parts)).columns:
            if term.lower() in column.lower():
                hits.append((full, column))
        if term.lower() in table.name.lower():
            hits.append((full, None))
    return spark.createDataFrame(hits, "table_name string, column_name string")
