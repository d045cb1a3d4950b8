"""Queries over sinks: what a table holds after it was written."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.operators.marts import customer_revenue
from gatewell.plans.fixtures import (
    CHANGED_ORDERS, RAW_EVENTS, changed_orders, raw_events,
)
from gatewell.plans.registry import query
from gatewell.session import fresh_table, load
from gatewell.sinks.changes import row_diff, table_diff, upsert, upsert_partitions
from gatewell.sinks.tables import (
    append_under_contract, backfill, create_partitioned, create_table, full_refresh,
    materialize_model,
)
from gatewell.sinks.versions import VersionedTable

CUSTOMER_REVENUE = """
    SELECT c_custkey, c_name, c_mktsegment, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order_value,
           max(o_orderdate) AS last_order
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment"""


@query("full_refresh", CUSTOMER_REVENUE)
def refreshed_mart(spark: SparkSession, folder: str) -> DataFrame:
    """The mart replaces an older table of another shape."""
    table = fresh_table(spark, "revenue")
    full_refresh(load(spark, folder, "nation"), table)
    mart = customer_revenue(load(spark, folder, "customer"), load(spark, folder, "orders"))
    full_refresh(mart, table)
    return spark.table(table)


EVENT_COLUMNS = (
    {"name": "event_id", "data_type": "bigint", "nullable": False},
    {"name": "ts", "data_type": "timestamp_ntz", "nullable": False},
    {"name": "event_type", "data_type": "string"},
    {"name": "value_text", "data_type": "decimal(18,2)", "comment": "amount of the event"},
)


@query("schema_enforced_append", f"""
    WITH e AS ({RAW_EVENTS})
    SELECT 'accepted' AS outcome, event_id, CAST(CAST(value_text AS DECIMAL(18,2)) AS DOUBLE) AS amount,
           '' AS reasons
    FROM e WHERE value_text <> 'n/a'
    UNION ALL
    SELECT 'quarantined', event_id, 0.0, 'value_text: not decimal(18,2)' FROM e
    WHERE value_text = 'n/a'""")
def schema_enforced_append(spark: SparkSession, folder: str) -> DataFrame:
    table, aside = fresh_table(spark, "typed_events"), fresh_table(spark, "typed_events_bad")
    declared = create_table(spark, table, EVENT_COLUMNS, {"team": "events"})
    rows = raw_events(spark, folder).select("event_id", "ts", "event_type", "value_text")
    append_under_contract(rows, table, aside, declared)
    accepted = spark.table(table).select(
        F.lit("accepted").alias("outcome"), "event_id",
        F.col("value_text").cast("double").alias("amount"), F.lit("").alias("reasons"))
    return accepted.unionByName(spark.table(aside).select(
        F.lit("quarantined").alias("outcome"), F.col("event_id").cast("bigint").alias("event_id"),
        F.lit(0.0).alias("amount"), "reasons"))


@query("upsert_merge", f"""
    WITH s AS ({CHANGED_ORDERS})
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM s""")
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The merged state is written as the next version of the table."""
    name, log = fresh_table(spark, "orders_merged"), fresh_table(spark, "versions")
    orders = VersionedTable(spark, name, log)
    orders.write(load(spark, folder, "orders"), datetime.datetime(2024, 1, 1))
    merged = upsert(spark.table(name), changed_orders(spark, folder), ["o_orderkey"])
    orders.write(merged, datetime.datetime(2024, 1, 2))
    return spark.table(name)


STATUS_MODEL = """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM {} GROUP BY o_orderstatus, o_orderpriority"""


@query("materialize_view", STATUS_MODEL.format("orders"))
def materialize_view(spark: SparkSession, folder: str) -> DataFrame:
    """One model as a view; a table computed from that view is read back."""
    view = f"order_status_{uuid.uuid4().hex[:12]}"
    materialize_model(spark, view, STATUS_MODEL.format("{orders}"), "view",
                      orders=load(spark, folder, "orders"))
    table = fresh_table(spark, "order_status")
    materialize_model(spark, table, f"SELECT * FROM {view}", "table")
    return spark.table(table)


# Signups have no day.
EVENTS_BY_DAY = """
    SELECT event_id, user_id, event_type, value,
           CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS day FROM events"""


def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("event_type") != "signup", F.to_date("ts")).alias("day"))


@query("upsert_partitions", f"""
    SELECT event_id, user_id, event_type,
           CASE WHEN event_type = 'signup' AND value > 50 THEN 0
                WHEN day = DATE '2024-01-12' THEN value + 1 ELSE value END AS value, day
    FROM ({EVENTS_BY_DAY}) e
    UNION ALL SELECT -event_id, user_id, event_type, value, day FROM ({EVENTS_BY_DAY}) e
    WHERE day = DATE '2024-01-12'""")
def upserted_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Changed rows of one day and of no day, and new rows; all other partitions stay."""
    table = fresh_table(spark, "events_by_day")
    events = events_by_day(spark, folder)
    create_partitioned(events, table, "day")
    one_day = events.where("day = DATE '2024-01-12'")
    changes = (one_day.withColumn("value", F.col("value") + 1)
               .unionByName(one_day.withColumn("event_id", -F.col("event_id")))
               .unionByName(events.where("event_type = 'signup' AND value > 50")
                            .withColumn("value", F.lit(0.0))))
    upsert_partitions(changes, table, ["event_id"], "day")
    return spark.table(table)


FIRST_DAY, LAST_DAY = datetime.date(2024, 1, 10), datetime.date(2024, 1, 14)


@query("backfill_range", f"""
    SELECT event_id, user_id, event_type,
           CASE WHEN day BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'
                THEN value + 1 ELSE value END AS value, day
    FROM ({EVENTS_BY_DAY}) e
    WHERE NOT coalesce(day BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'
                       AND event_type = 'error', FALSE)""")
def backfill_range(spark: SparkSession, folder: str) -> DataFrame:
    """Five days are rebuilt from corrected events, twice; the others, and rows without a day, stay."""
    table = fresh_table(spark, "events_by_day")
    events = events_by_day(spark, folder)
    create_partitioned(events, table, "day")
    corrected = (events.where(F.col("event_type") != "error")
                 .withColumn("value", F.col("value") + 1))
    for _ in range(2):
        backfill(corrected, table, "day", FIRST_DAY, LAST_DAY)
    return spark.table(table)


@query("table_diff", f"""
    WITH a AS ({CHANGED_ORDERS})
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed'
                ELSE 'changed' END AS change_type,
           b.o_totalprice AS before_o_totalprice, a.o_totalprice AS after_o_totalprice,
           b.o_orderstatus AS before_o_orderstatus, a.o_orderstatus AS after_o_orderstatus
    FROM orders b FULL JOIN a ON b.o_orderkey = a.o_orderkey
    WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL
       OR b.o_totalprice IS DISTINCT FROM a.o_totalprice
       OR b.o_orderstatus IS DISTINCT FROM a.o_orderstatus""")
def changed_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table_diff(load(spark, folder, "orders"), changed_orders(spark, folder),
                      ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("table_diff_rows", f"""
    WITH a AS ({CHANGED_ORDERS}),
    x AS (SELECT o_custkey, o_orderstatus, o_orderpriority, -1 AS n FROM orders UNION ALL
          SELECT o_custkey, o_orderstatus, o_orderpriority, 1 AS n FROM a)
    SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(sum(n) AS BIGINT) AS copies_delta
    FROM x GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING sum(n) <> 0""")
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The form without a key: rows that have more or fewer copies than before."""
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return row_diff(load(spark, folder, "orders").select(*columns),
                    changed_orders(spark, folder).select(*columns))


@query("rollback_last_change", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders""")
def rolled_back(spark: SparkSession, folder: str) -> DataFrame:
    """The second version is undone: the name shows the first one again."""
    name, log = fresh_table(spark, "orders_versions"), fresh_table(spark, "versions")
    orders = VersionedTable(spark, name, log)
    orders.write(load(spark, folder, "orders"), datetime.datetime(2024, 1, 1))
    orders.write(changed_orders(spark, folder), datetime.datetime(2024, 1, 2))
    orders.rollback_last_change(datetime.datetime(2024, 1, 3))
    return spark.table(name)
