"""Frames derived from the given tables that show what checks can find.

The given tables hold no nulls, orphans or whole-row duplicates, so those are derived from them by
rules over whole tables, stated once for Spark and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.session import fresh_table, load

# Orders with nulls: no priority where none was specified, no customer on urgent open orders.
ORDERS_WITH_NULLS = """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
                ELSE o_custkey END AS o_custkey,
           o_orderstatus, o_totalprice, o_orderdate,
           NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority
    FROM orders"""


def orders_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    urgent = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return load(spark, folder, "orders").withColumns({
        "o_custkey": F.when(~urgent, F.col("o_custkey")),
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))})


# A later state of orders: partly filled ones cost one more, finished urgent ones are gone, and
# every open low-priority one was reordered under a new key.
NEW_KEYS = 100_000_000_000
CHANGED_ORDERS = f"""
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
    UNION ALL
    SELECT o_orderkey + {NEW_KEYS} AS o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"""


def changed_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kept = orders.where(~((status == "F") & (priority == "1-URGENT"))).withColumn(
        "o_totalprice",
        F.when(status == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = orders.where((status == "O") & (priority == "5-LOW")).withColumn(
        "o_orderkey", F.col("o_orderkey") + F.lit(NEW_KEYS))
    return kept.unionByName(added)


# Customers of one market segment under new keys, which leaves their orders without a parent.
RENUMBERED_CUSTOMERS = """
    SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END AS c_custkey,
           c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"""


def renumbered_customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, folder, "customer").withColumn(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", -key).otherwise(key))


# Events as raw text rows: the value of an error is not a number, types come untidy.
RAW_EVENTS = """
    SELECT event_id, ts, user_id, '  ' || upper(event_type) || ' ' AS event_type,
           CASE WHEN event_type = 'error' THEN 'n/a'
                ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value_text
    FROM events"""


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id", "ts", "user_id",
        F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")).alias("event_type"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("value_text"))


# Events as an approval log and as a stage log. Which event stands for what.
APPROVAL_ACTIONS = {"signup": "requested", "purchase": "approved", "error": "rejected"}
STAGE_OF_EVENT = {"signup": "planning", "view": "querying", "click": "quality_checks",
                  "error": "approval", "purchase": "completed"}


def _mapped(column: str, values: dict[str, str]):
    result = F.lit(None).cast("string")
    for key, value in values.items():
        result = F.when(F.col(column) == key, value).otherwise(result)
    return result


def _mapped_sql(column: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in values.items())
    return f"CASE {column} {cases} END"


APPROVAL_LOG = f"""
    SELECT event_id, ts, user_id AS approval_id,
           {_mapped_sql("event_type", APPROVAL_ACTIONS)} AS action
    FROM events WHERE event_type IN ('signup', 'purchase', 'error')"""

STAGE_LOG = f"""
    SELECT event_id, ts, user_id AS pipeline_id, {_mapped_sql("event_type", STAGE_OF_EVENT)} AS stage
    FROM events"""


def approval_log(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").where(F.col("event_type").isin(*APPROVAL_ACTIONS))
    return events.select("event_id", "ts", F.col("user_id").alias("approval_id"),
                         _mapped("event_type", APPROVAL_ACTIONS).alias("action"))


def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id", "ts", F.col("user_id").alias("pipeline_id"),
        _mapped("event_type", STAGE_OF_EVENT).alias("stage"))


def source_table(spark: SparkSession, folder: str, name: str) -> str:
    """The catalog name of a fixture table; its files stay where they are."""
    table = fresh_table(spark, name)
    spark.catalog.createTable(table, path=f"{folder}/{name}.parquet", source="parquet")
    return f"spark_catalog.{table}"
