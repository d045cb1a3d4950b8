"""Reading files and databases, and inferring the shape of JSON text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gatewell.functions import quoted

FORMATS = ("parquet", "csv", "json", "orc", "text")


def read_files(spark: SparkSession, fmt: str, path: str | list[str],
               schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files of one format. Give CSV and JSON a schema: inferring one costs a pass of its own."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv" and "inferSchema" not in options:
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def read_database(spark: SparkSession, url: str, table: str, partition_column: str,
                  lower: str, upper: str, partitions: int, fetch_size: int = 10_000,
                  **options: str) -> DataFrame:
    """A database table read in parallel slices of ``partition_column``."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower,
                     upperBound=upper, numPartitions=str(partitions), fetchsize=str(fetch_size),
                     **options).load())


def infer_json_type(df: DataFrame, column: str) -> str:
    """The type of the JSON documents in a text column, as DDL. One aggregate over all rows."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(quoted(column)))).alias("t"))
    ddl = found.first()["t"]
    # Variant schemas name structs OBJECT and unknown (always null) values VOID.
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", ddl))


def parse_json(df: DataFrame, column: str, out: str = "parsed", ddl: str | None = None) -> DataFrame:
    ddl = ddl or infer_json_type(df, column)
    return df.withColumn(out, F.from_json(F.col(quoted(column)), ddl))
