"""Queries over sources and schemas."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.plans.fixtures import (
    ORDERS_WITH_NULLS, RAW_EVENTS, orders_with_nulls, raw_events,
)
from gatewell.plans.registry import query
from gatewell.session import TABLES, load, scratch_path
from gatewell.sinks.tables import declared_schema
from gatewell.sources.catalog import load_tables, row_counts
from gatewell.sources.contract import contract_check
from gatewell.sources.files import parse_json, read_files
from gatewell.sources.incremental import new_rows
from gatewell.sources.profile import profile
from gatewell.streaming.load import file_stream, load_available


@query("scan_projection", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def scan_projection(spark: SparkSession, folder: str) -> DataFrame:
    (orders,) = _named_sources(spark, folder, ["orders"])
    return orders.select("o_orderkey", "o_custkey", "o_totalprice")


def _named_sources(spark: SparkSession, folder: str, tables: list[str]) -> list[DataFrame]:
    """Views over the folder's tables, all loaded by name in one call. A folder has its own names."""
    place = f"{zlib.crc32(folder.encode()):08x}"
    names = [f"gatewell_{table}_{place}" for table in tables]
    for table, name in zip(tables, names):
        load(spark, folder, table).createOrReplaceTempView(name)
    frames = load_tables(spark, names)
    return [frames[name] for name in names]


@query("scan_named_sources", """
    SELECT 'orders' AS source, o_orderkey AS id, o_custkey AS custkey, o_totalprice AS amount
    FROM orders
    UNION ALL SELECT 'customer', c_custkey, c_custkey, c_acctbal FROM customer""")
def scan_named_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources of the mart, of each the columns that are needed."""
    orders, customer = _named_sources(spark, folder, ["orders", "customer"])
    return orders.select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount")).unionAll(
        customer.select(F.lit("customer"), "c_custkey", "c_custkey", "c_acctbal"))


@query("source_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def source_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts({t: load(spark, folder, t) for t in TABLES})


ORDERS_CONTRACT = (
    {"name": "o_orderkey", "data_type": "bigint", "nullable": False},
    {"name": "o_custkey", "data_type": "bigint", "nullable": False},
    {"name": "o_orderstatus", "data_type": "string"},
    {"name": "o_totalprice", "data_type": "double"},
    {"name": "o_orderpriority", "data_type": "string", "nullable": False},
    {"name": "o_clerk", "data_type": "string"},
)
EVENTS_CONTRACT = (
    {"name": "event_id", "data_type": "bigint", "nullable": False},
    {"name": "value_text", "data_type": "double"},
)


@query("contract_check", f"""
    WITH o AS ({ORDERS_WITH_NULLS}), e AS ({RAW_EVENTS}),
    oc AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS k, count(*) FILTER (o_custkey IS NULL) AS c,
                  count(*) FILTER (o_orderpriority IS NULL) AS p FROM o),
    ec AS (SELECT count(*) FILTER (NOT regexp_matches(value_text, '^[+-]?[0-9]+(\\.[0-9]+)?$')) AS bad
           FROM e)
    SELECT 'orders' AS table_name, v.*, CAST(0 AS BIGINT) AS uncastable,
           CASE v.column_name WHEN 'o_custkey' THEN oc.c WHEN 'o_orderkey' THEN oc.k
                WHEN 'o_orderpriority' THEN oc.p ELSE 0 END AS null_violations
    FROM oc, (VALUES ('o_orderkey', 'bigint', 'bigint', 'ok'),
                     ('o_custkey', 'bigint', 'bigint', 'ok'),
                     ('o_orderstatus', 'string', 'string', 'ok'),
                     ('o_totalprice', 'double', 'double', 'ok'),
                     ('o_orderpriority', 'string', 'string', 'ok'),
                     ('o_clerk', 'string', '', 'missing'),
                     ('o_orderdate', '', 'timestamp_ntz', 'extra'))
             AS v(column_name, declared_type, actual_type, status)
    UNION ALL
    SELECT 'events', v.*, CASE v.column_name WHEN 'value_text' THEN ec.bad ELSE 0 END,
           CAST(0 AS BIGINT)
    FROM ec, (VALUES ('event_id', 'bigint', 'bigint', 'ok'),
                     ('value_text', 'double', 'string', 'type_differs'),
                     ('ts', '', 'timestamp_ntz', 'extra'),
                     ('user_id', '', 'bigint', 'extra'),
                     ('event_type', '', 'string', 'extra'))
             AS v(column_name, declared_type, actual_type, status)""")
def contracts(spark: SparkSession, folder: str) -> DataFrame:
    orders = contract_check(orders_with_nulls(spark, folder), declared_schema(ORDERS_CONTRACT))
    events = contract_check(raw_events(spark, folder), declared_schema(EVENTS_CONTRACT))
    return (orders.withColumn("table_name", F.lit("orders"))
            .unionByName(events.withColumn("table_name", F.lit("events"))))


def _profile_sql(column: str, kind: str) -> str:
    low, high = f"min({column})", f"max({column})"
    number = {"string": "CAST(NULL AS DOUBLE)", "timestamp_ntz": "epoch_us({}) / 1000000.0"}
    as_number = number.get(kind, "CAST({} AS DOUBLE)")
    as_text = "{}" if kind == "string" else "CAST(NULL AS VARCHAR)"
    return f"""
        SELECT '{column}' AS column_name, '{kind}' AS data_type, count({column}) AS non_null,
               count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS distinct_values,
               CAST({as_number.format(low)} AS DOUBLE) AS min_number,
               CAST({as_number.format(high)} AS DOUBLE) AS max_number,
               {as_text.format(low)} AS min_text, {as_text.format(high)} AS max_text FROM o"""


@query("column_profile", f"WITH o AS ({ORDERS_WITH_NULLS})" + " UNION ALL ".join(
    _profile_sql(c, k) for c, k in (
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"))))
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile(orders_with_nulls(spark, folder), exact=True)


@query("json_schema_infer", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_schema_infer(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    return parse_json(events, "props").select("event_id", "parsed.k")


BORDER = "2024-01-20 12:00:00"


@query("incremental_load", f"""
    SELECT event_id, ts, user_id, event_type, value FROM events
    WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '{BORDER}')""")
def incremental_load(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select("event_id", "ts", "user_id", "event_type",
                                                  "value")
    loaded = events.where(F.col("ts") <= F.lit(BORDER).cast("timestamp_ntz"))
    return new_rows(events, loaded, "ts", "event_id")


@query("incremental_stream", """
    SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS distinct_ids
    FROM events GROUP BY event_type""")
def incremental_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The stream form, run twice: the second run finds nothing new."""
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    schema = load(spark, folder, "events").schema
    for _ in range(2):
        load_available(file_stream(spark, folder, schema, "events.parquet"), target, checkpoint)
    return (spark.read.schema(schema).parquet(target).groupBy("event_type", "event_id")
            .agg(F.count(F.lit(1)).alias("n")).groupBy("event_type")
            .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_ids")))


ROUND_TRIP = ("parquet", "csv", "json", "orc")


@query("file_sources", " UNION ALL ".join(f"""
    SELECT '{fmt}' AS format, o_orderstatus, count(*) AS rows, min(o_orderkey) AS min_key,
           max(o_orderdate) AS last_order,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY o_orderstatus""" for fmt in ROUND_TRIP))
def file_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written in each file format and read back with a declared schema."""
    orders = load(spark, folder, "orders")
    parts = None
    for fmt in ROUND_TRIP:
        path = scratch_path(spark, f"orders-{fmt}")
        orders.write.format(fmt).save(path)
        part = (read_files(spark, fmt, path, orders.schema).groupBy("o_orderstatus")
                .agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("min_key"),
                     F.max("o_orderdate").alias("last_order"),
                     F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                     .alias("total"))
                .withColumn("format", F.lit(fmt)))
        parts = part if parts is None else parts.unionByName(part)
    return parts
