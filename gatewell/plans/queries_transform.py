"""Queries over transformations, joins and marts."""

from __future__ import annotations

import contextlib
import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.governance.approvals import ApprovalLog
from gatewell.operators.cleaning import staging_clean, tag_violations
from gatewell.operators.joins import customer_orders, lookup, orphan_keys
from gatewell.operators.marts import (
    customer_dim, customer_revenue, daily_sales, segment_customers,
)
from gatewell.operators.steps import apply_steps, handle_nulls, step_metrics
from gatewell.functions import money, text_number
from gatewell.plans.fixtures import (
    ORDERS_WITH_NULLS, RAW_EVENTS, RENUMBERED_CUSTOMERS, orders_with_nulls, raw_events,
    renumbered_customers, source_table,
)
from gatewell.plans.build import BuildResult, default_log, release, run_build
from gatewell.plans.queries_sinks import CUSTOMER_REVENUE
from gatewell.plans.registry import query
from gatewell.plans.spec import Spec
from gatewell.session import fresh_table, load, scratch_path, workspace

CHAIN = (
    {"op": "select", "columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                 "o_orderpriority"]},
    {"op": "filter", "predicate": "o_orderstatus <> 'P'"},
    {"op": "fill_null", "values": {"o_orderpriority": "none"}},
    {"op": "drop_null", "columns": ["o_custkey"]},
    {"op": "cast", "columns": {"o_totalprice": "decimal(18,2)"}},
    {"op": "join", "table": "customer", "left_key": "o_custkey", "right_key": "c_custkey"},
    {"op": "derive", "columns": {"is_large": "o_totalprice > 250000"}},
    {"op": "rename", "columns": {"c_mktsegment": "market"}},
    {"op": "aggregate", "keys": ["market", "o_orderpriority"], "measures": {
        "n_orders": "count(*)", "n_large": "count_if(is_large)",
        "revenue": "cast(sum(o_totalprice) as double)"}},
    {"op": "sql", "text": "SELECT *, revenue / n_orders AS mean FROM {current} "
                          "WHERE n_orders >= :least", "args": {"least": 1}},
    {"op": "rank_segment", "order_by": ["-revenue", "market", "o_orderpriority"],
     "segments": {"top": 0.2, "middle": 0.6, "rest": 1.0}},
)


@query("transform_chain", f"""
    WITH o AS ({ORDERS_WITH_NULLS}), g AS (
      SELECT c_mktsegment AS market, coalesce(o_orderpriority, 'none') AS o_orderpriority,
             count(*) AS n_orders, count(*) FILTER (o_totalprice > 250000) AS n_large,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
      FROM o JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
      GROUP BY ALL),
    r AS (SELECT *, revenue / n_orders AS mean, count(*) OVER () AS total,
                 row_number() OVER (ORDER BY revenue DESC, market, o_orderpriority) AS place FROM g)
    SELECT market, o_orderpriority, n_orders, n_large, revenue, mean,
           CASE WHEN place <= ceil(0.2 * total) THEN 'top' WHEN place <= ceil(0.6 * total)
                THEN 'middle' ELSE 'rest' END AS segment FROM r""")
def transform_chain(spark: SparkSession, folder: str) -> DataFrame:
    inputs = {"orders": orders_with_nulls(spark, folder), "customer": load(spark, folder, "customer")}
    return apply_steps(inputs, CHAIN, start="orders")


@query("null_handling", f"""
    WITH o AS ({ORDERS_WITH_NULLS})
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           coalesce(o_orderpriority, 'unknown') AS o_orderpriority
    FROM o WHERE o_custkey IS NOT NULL""")
def null_handling(spark: SparkSession, folder: str) -> DataFrame:
    return handle_nulls(orders_with_nulls(spark, folder),
                        {"fill": {"o_orderpriority": "unknown"}, "drop": ["o_custkey"]})


EVENT_RULES = {
    "value_is_number": "value_text RLIKE '^[+-]?[0-9]+([.][0-9]+)?$'",
    "not_a_signup": "lower(trim(event_type)) <> 'signup'",
}


@query("quarantine_split", f"""
    WITH e AS ({RAW_EVENTS})
    SELECT event_id, event_type, value_text,
           CASE WHEN value_text = 'n/a' THEN 'value_is_number'
                WHEN lower(trim(event_type)) = 'signup' THEN 'not_a_signup' ELSE '' END AS violations,
           value_text = 'n/a' OR lower(trim(event_type)) = 'signup' AS quarantined
    FROM e""")
def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    rules = {name: F.expr(text) for name, text in EVENT_RULES.items()}
    tagged = tag_violations(raw_events(spark, folder), rules)
    return tagged.select("event_id", "event_type", "value_text",
                         F.concat_ws(",", "violations").alias("violations"),
                         (F.size("violations") > 0).alias("quarantined"))


@query("quarantine_documents", """
    SELECT CASE WHEN n_chars < 200 THEN 'too_short' ELSE '' END
           || CASE WHEN n_chars < 200 AND lang <> 'en' THEN ',' ELSE '' END
           || CASE WHEN lang <> 'en' THEN 'other_language' ELSE '' END AS violations,
           count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars
    FROM documents GROUP BY ALL""")
def quarantine_documents(spark: SparkSession, folder: str) -> DataFrame:
    tagged = tag_violations(load(spark, folder, "documents").select("lang", "n_chars"), {
        "too_short": F.col("n_chars") >= 200, "other_language": F.col("lang") == "en"})
    return tagged.groupBy(F.concat_ws(",", "violations").alias("violations")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query("staging_clean", f"""
    WITH e AS ({RAW_EVENTS}),
    c AS (SELECT event_id, ts, user_id, lower(trim(event_type)) AS event_type,
                 CASE WHEN value_text <> 'n/a' THEN CAST(value_text AS DECIMAL(18,2)) END AS v FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                       ORDER BY ts DESC, event_id DESC) AS n FROM c)
    SELECT user_id, event_type, event_id, ts, coalesce(CAST(v AS DOUBLE), -1.0) AS amount
    FROM r WHERE n = 1""")
def cleaned_events(spark: SparkSession, folder: str) -> DataFrame:
    """The raw rows arrive twice; the latest event per user and kind stays."""
    raw = raw_events(spark, folder)
    clean = staging_clean(
        raw.unionByName(raw), ["user_id", "event_type"],
        [F.col("ts").desc(), F.col("event_id").desc()], trim=["event_type"], lower=["event_type"],
        casts={"amount": text_number(F.col("value_text"), "decimal(18,2)").cast("double")})
    return clean.select("user_id", "event_type", "event_id", "ts",
                        F.coalesce("amount", F.lit(-1.0)).alias("amount"))


@query("sql_step", """
    SELECT o_orderpriority, count(*) AS n_orders, max(o_orderdate) AS last_order
    FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority""")
def sql_step(spark: SparkSession, folder: str) -> DataFrame:
    return apply_steps({"orders": load(spark, folder, "orders")}, [
        {"op": "sql", "args": {"least": 100000.0},
         "text": "SELECT o_orderpriority, count(*) AS n_orders, max(o_orderdate) AS last_order "
                 "FROM {current} WHERE o_totalprice > :least GROUP BY o_orderpriority"}])


@query("step_metrics", f"""
    WITH o AS ({ORDERS_WITH_NULLS}),
    f AS (SELECT * FROM o WHERE o_orderstatus <> 'F'),
    d AS (SELECT * FROM f WHERE o_custkey IS NOT NULL),
    a AS (SELECT o_orderpriority FROM d GROUP BY o_orderpriority),
    n AS (SELECT (SELECT count(*) FROM o) AS c0, (SELECT count(*) FROM f) AS c1,
                 (SELECT count(*) FROM d) AS c2, (SELECT count(*) FROM a) AS c3,
                 (SELECT count(*) FILTER (o_custkey IS NULL)
                         + count(*) FILTER (o_orderpriority IS NULL) FROM o) AS n0,
                 (SELECT count(*) FILTER (o_custkey IS NULL)
                         + count(*) FILTER (o_orderpriority IS NULL) FROM f) AS n1,
                 (SELECT count(*) FILTER (o_orderpriority IS NULL) FROM d) AS n2,
                 (SELECT count(*) FILTER (o_orderpriority IS NULL) FROM a) AS n3)
    SELECT CAST(0 AS BIGINT) AS step_no, 'source' AS step, c0 AS rows_in, c0 AS rows_out,
           n0 AS null_cells FROM n
    UNION ALL SELECT 1, 'filter', c0, c1, n1 FROM n
    UNION ALL SELECT 2, 'drop_null', c1, c2, n2 FROM n
    UNION ALL SELECT 3, 'aggregate', c2, c3, n3 FROM n""")
def counted_steps(spark: SparkSession, folder: str) -> DataFrame:
    return step_metrics({"orders": orders_with_nulls(spark, folder)}, [
        {"op": "filter", "predicate": "o_orderstatus <> 'F'"},
        {"op": "drop_null", "columns": ["o_custkey"]},
        {"op": "aggregate", "keys": ["o_orderpriority"], "measures": {"n": "count(*)"}}])


@query("customer_orders_join", """
    SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_orderdate, o_totalprice
    FROM customer JOIN orders ON c_custkey = o_custkey""")
def customer_orders_join(spark: SparkSession, folder: str) -> DataFrame:
    return customer_orders(
        load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                             "o_totalprice")).drop("o_custkey")


@query("relationship_check", f"""
    SELECT o_custkey AS key, count(*) AS rows FROM ({ORDERS_WITH_NULLS}) o
    WHERE o_custkey IS NOT NULL
      AND o_custkey NOT IN (SELECT c_custkey FROM ({RENUMBERED_CUSTOMERS}) c)
    GROUP BY o_custkey""")
def relationship_check(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_keys(orders_with_nulls(spark, folder), renumbered_customers(spark, folder),
                       "o_custkey", "c_custkey")


CUSTOMER_SK = ("sha256('8:customer|' || length(CAST(c_custkey AS VARCHAR)) || ':' "
               "|| CAST(c_custkey AS VARCHAR))")
CUSTOMER_DIM = f"""
    SELECT {CUSTOMER_SK} AS customer_sk, c_custkey, c_name, c_mktsegment,
           coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region
    FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey)
      ON c_nationkey = n_nationkey"""


@query("dim_build", CUSTOMER_DIM)
def dim_build(spark: SparkSession, folder: str) -> DataFrame:
    return customer_dim(*[load(spark, folder, t) for t in ("customer", "nation", "region")])


@query("star_fact_lookup", f"""
    WITH c AS ({RENUMBERED_CUSTOMERS}), o AS ({ORDERS_WITH_NULLS})
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o.o_orderkey, -1) AS order_key,
           coalesce(c.c_custkey, -1) AS customer_key, coalesce(n_nationkey, -1) AS nation_key,
           coalesce(n_regionkey, -1) AS region_key,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
    FROM lineitem LEFT JOIN o ON l_orderkey = o.o_orderkey
    LEFT JOIN c ON o.o_custkey = c.c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def star_fact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their dimension members, -1 where a key is null or not found.

    The dimensions are resolved per order first; the lines then need one join.
    """
    customers = renumbered_customers(spark, folder).join(
        load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "c_custkey", F.struct("c_custkey", F.coalesce("n_nationkey", F.lit(-1)).alias("nation"),
                              F.coalesce("n_regionkey", F.lit(-1)).alias("region")).alias("member"))
    unknown = F.struct(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit(-1).alias("nation"),
                       F.lit(-1).alias("region"))
    orders = lookup(orders_with_nulls(spark, folder).select("o_orderkey", "o_custkey"),
                    customers, "o_custkey", "c_custkey", "member", "member", unknown)
    orders = orders.select("o_orderkey", F.struct(F.col("o_orderkey").alias("o"), "member")
                           .alias("order_member"))
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", money("l_extendedprice").cast("double")
        .alias("amount"))
    no_order = F.struct(F.lit(-1).cast("bigint").alias("o"), unknown.alias("member"))
    found = lookup(lines, orders, "l_orderkey", "o_orderkey", "order_member", "order_member",
                   no_order)
    return found.select("l_orderkey", "l_linenumber", "l_partkey",
                        F.col("order_member.o").alias("order_key"),
                        F.col("order_member.member.c_custkey").alias("customer_key"),
                        F.col("order_member.member.nation").alias("nation_key"),
                        F.col("order_member.member.region").alias("region_key"), "amount")


@query("customer_revenue", CUSTOMER_REVENUE)
def revenue_mart(spark: SparkSession, folder: str) -> DataFrame:
    return customer_revenue(load(spark, folder, "customer"), load(spark, folder, "orders"))


CUSTOMER_SEGMENTS = f"""
    WITH m AS ({CUSTOMER_REVENUE}),
    r AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, c_custkey) AS revenue_rank,
                 ntile(10) OVER (ORDER BY revenue DESC, c_custkey) AS decile,
                 percent_rank() OVER (ORDER BY revenue DESC, c_custkey) AS pct_rank,
                 count(*) OVER () AS total FROM m)
    SELECT *, CASE WHEN revenue_rank <= ceil(0.1 * total) THEN 'high'
                   WHEN revenue_rank <= ceil(0.5 * total) THEN 'mid' ELSE 'low' END AS segment
    FROM r"""


@query("customer_segments", f"""
    SELECT c_custkey, revenue, revenue_rank, decile, pct_rank, segment
    FROM ({CUSTOMER_SEGMENTS}) s""")
def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    mart = customer_revenue(load(spark, folder, "customer"), load(spark, folder, "orders"))
    return segment_customers(mart.select("c_custkey", "revenue"))


@query("daily_sales", """
    SELECT CAST(l_shipdate AS DATE) AS sale_date, count(*) AS n_lines,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross_revenue,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))
                    * (CAST(1 AS DECIMAL(5,4)) - CAST(l_discount AS DECIMAL(5,4)))) AS DOUBLE)
             AS net_revenue
    FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""")
def daily_sales_mart(spark: SparkSession, folder: str) -> DataFrame:
    return daily_sales(load(spark, folder, "lineitem"))


BUILD_TIME = datetime.datetime(2024, 1, 31)
MART_CHECKS = (
    {"name": "has_rows", "type": "row_count", "min_rows": 1},
    {"name": "keys_present", "type": "null_check", "columns": ["c_custkey", "revenue"]},
    {"name": "revenue_positive", "type": "expectation", "predicate": "revenue > 0"},
    {"name": "one_row_per_customer", "type": "unique", "columns": ["c_custkey"]},
    {"name": "known_segments", "type": "accepted_values", "columns": ["segment"],
     "values": ["high", "mid", "low"]},
)


@query("flagship_mart", f"""
    SELECT c_custkey, c_name, c_mktsegment, n_orders, revenue, avg_order_value, last_order,
           revenue_rank, decile, segment FROM ({CUSTOMER_SEGMENTS}) s""")
def flagship_mart(spark: SparkSession, folder: str) -> DataFrame:
    """A declared build: customers and orders to revenue and segments, checked, shown, read back."""
    orders, customer = (source_table(spark, folder, t) for t in ("orders", "customer"))
    target = fresh_table(spark, "customer_value")
    spec = Spec.of({
        "name": "customer_value", "source_tables": [orders, customer], "target_table": target,
        "transformations": [
            {"op": "aggregate", "keys": ["o_custkey"], "measures": {
                "n_orders": "count(*)", "total": "sum(cast(o_totalprice as decimal(18,2)))",
                "last_order": "max(o_orderdate)"}},
            {"op": "join", "table": customer, "left_key": "o_custkey", "right_key": "c_custkey"},
            {"op": "derive", "columns": {
                "revenue": "cast(total as double)",
                "avg_order_value": "cast(total as double) / n_orders"}},
            {"op": "rank_segment", "order_by": ["-revenue", "c_custkey"], "rank_as": "revenue_rank",
             "tiles": {"decile": 10}, "segments": {"high": 0.1, "mid": 0.5, "low": 1.0}},
            {"op": "select", "columns": [
                "c_custkey", "c_name", "c_mktsegment", "n_orders", "revenue", "avg_order_value",
                "last_order", "revenue_rank", "decile", "segment"]}],
        "quality_checks": MART_CHECKS})
    log = default_log(workspace(spark), scratch_path(spark, "build-log"))
    run_build(spark, spec, f"run-{target}", BUILD_TIME, log)
    return spark.table(target)


@query("approved_build", """
    SELECT o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""")
def approved_build(spark: SparkSession, folder: str) -> DataFrame:
    """Two builds of one target wait at the same time; the first is approved, the other rejected."""
    orders, target = source_table(spark, folder, "orders"), fresh_table(spark, "by_priority")
    log = default_log(workspace(spark), scratch_path(spark, "build-log"))
    approvals = ApprovalLog(spark, log.approvals_path)

    def staged(status: str) -> tuple[Spec, BuildResult]:
        spec = Spec.of({
            "name": "by_priority", "source_tables": [orders], "target_table": target,
            "transformations": [
                {"op": "filter", "predicate": f"o_orderstatus = '{status}'"},
                {"op": "aggregate", "keys": ["o_orderpriority"], "measures": {
                    "n_orders": "count(*)",
                    "total": "cast(sum(cast(o_totalprice as decimal(18,2))) as double)"}}]})
        return spec, run_build(spark, spec, f"{target}-{status}", BUILD_TIME, log,
                               require_approval=True)

    finished, open_orders = staged("F"), staged("O")
    approvals.approve(finished[1].approval_id, "owner", BUILD_TIME)
    approvals.reject(open_orders[1].approval_id, "owner", BUILD_TIME, "not yet")
    with contextlib.suppress(PermissionError):
        release(spark, *open_orders, f"{target}-O", BUILD_TIME, log)
    release(spark, *finished, f"{target}-F", BUILD_TIME, log)
    return spark.table(target)
