"""Queries over data quality."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.plans.fixtures import (
    RENUMBERED_CUSTOMERS, ORDERS_WITH_NULLS, renumbered_customers, orders_with_nulls,
)
from gatewell.plans.registry import query
from gatewell.quality.checks import duplicate_count, repeated_keys
from gatewell.quality.rows import (
    failing_rows, null_counts, null_percentages, outside_values, row_count_anomalies,
)
from gatewell.quality.suite import report, roll_up, suite_results
from gatewell.session import fresh_table, load

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_orderpriority")
FRESH_AT = datetime.datetime(2024, 1, 31)
STALE_AT = datetime.datetime(2024, 2, 1)
# The columns of a check row that are plain values.
RESULT = ("name", "type", "severity", "passed", "observed", "threshold")


@query("null_counts_all", f"WITH o AS ({ORDERS_WITH_NULLS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, "
    f"count(*) FILTER ({c} IS NULL) > 0 AS is_issue FROM o" for c in ORDER_COLUMNS))
def null_counts_all(spark: SparkSession, folder: str) -> DataFrame:
    return null_counts(orders_with_nulls(spark, folder))


def _duplicates_sql(name: str, source: str) -> str:
    return (f"SELECT '{name}' AS table_name, (SELECT count(*) FROM ({source}) a) AS total_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({source}) b) c) AS distinct_rows, "
            f"(SELECT count(*) FROM ({source}) a) "
            f"- (SELECT count(*) FROM (SELECT DISTINCT * FROM ({source}) b) c) AS duplicate_rows")


@query("duplicate_rows", " UNION ALL ".join((
    _duplicates_sql("lineitem", "SELECT * FROM lineitem"),
    _duplicates_sql("lineitem_keys", "SELECT l_orderkey, l_linenumber FROM lineitem"),
    _duplicates_sql("document_texts", "SELECT text FROM documents"))))
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem")
    parts = [("lineitem", duplicate_count(lines)),
             ("lineitem_keys", duplicate_count(lines.select("l_orderkey", "l_linenumber"))),
             ("document_texts", duplicate_count(load(spark, folder, "documents").select("text"),
                                                wide=True))]
    named = [df.withColumn("table_name", F.lit(name)) for name, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _verdicts(df: DataFrame, checks, as_of=None, parents=None) -> DataFrame:
    return suite_results(df, checks, as_of, parents).select(*RESULT)


@query("empty_result", """
    SELECT 'all_orders' AS name, 'not_empty' AS type, 'error' AS severity, count(*) > 0 AS passed,
           CAST(count(*) AS DOUBLE) AS observed, 1.0::DOUBLE AS threshold FROM orders
    UNION ALL
    SELECT 'no_orders', 'not_empty', 'error', count(*) > 0, CAST(count(*) AS DOUBLE), 1.0
    FROM orders WHERE o_totalprice < 0""")
def empty_result(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return _verdicts(orders, [{"name": "all_orders", "type": "not_empty"}]).unionByName(
        _verdicts(orders.where("o_totalprice < 0"), [{"name": "no_orders", "type": "not_empty"}]))


GATE_CHECKS = (
    {"name": "nulls", "type": "null_counts"},
    {"name": "copies", "type": "duplicate_rows"},
    {"name": "not_empty", "type": "not_empty"},
    {"name": "priced", "type": "expectation", "predicate": "o_totalprice > 0"},
    {"name": "customers_known", "type": "null_check", "columns": ["o_custkey"], "threshold": 1.0},
)


@query("quality_gate", f"""
    WITH o AS ({ORDERS_WITH_NULLS}), m AS (
      SELECT count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS c,
             count(*) FILTER (o_orderpriority IS NULL) AS p,
             count(*) FILTER (NOT coalesce(o_totalprice > 0, FALSE)) AS u,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM o) x) AS d FROM o),
    v AS (SELECT c + p = 0 AS passed, FALSE AS blocking FROM m
          UNION ALL SELECT n = d, FALSE FROM m
          UNION ALL SELECT n > 0, TRUE FROM m
          UNION ALL SELECT u = 0, TRUE FROM m
          UNION ALL SELECT 100.0 * c / n <= 1.0, TRUE FROM m)
    SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed,
           count(*) FILTER (NOT passed AND blocking) AS blocking,
           bool_and(passed) AS all_passed, bool_and(passed OR NOT blocking) AS passed FROM v""")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict the gate acts on: nulls and copies only warn, missing customers block."""
    return roll_up(suite_results(orders_with_nulls(spark, folder), GATE_CHECKS))


@query("custom_expectation", """
    SELECT 'discount_below_tax' AS name, 'expectation' AS type, 'error' AS severity,
           count(*) FILTER (l_discount > l_tax) = 0 AS passed,
           CAST(count(*) FILTER (l_discount > l_tax) AS DOUBLE) AS observed,
           0.0::DOUBLE AS threshold FROM lineitem
    UNION ALL
    SELECT 'quantity_in_range', 'expectation', 'warn',
           count(*) FILTER (l_quantity NOT BETWEEN 1 AND 40) * 100.0 / count(*) <= 50,
           CAST(count(*) FILTER (l_quantity NOT BETWEEN 1 AND 40) AS DOUBLE), 50.0 FROM lineitem
    UNION ALL
    SELECT 'known_flag', 'expectation', 'error', count(*) FILTER (l_returnflag = 'R') = 0,
           CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE), 0.0 FROM lineitem""")
def custom_expectation(spark: SparkSession, folder: str) -> DataFrame:
    """A predicate that is null for a row (the last one, for flag R) counts as not met."""
    return _verdicts(load(spark, folder, "lineitem"), [
        {"name": "discount_below_tax", "type": "expectation", "predicate": "l_discount <= l_tax"},
        {"name": "quantity_in_range", "type": "expectation", "severity": "warn", "threshold": 50,
         "predicate": "l_quantity BETWEEN 1 AND 40"},
        {"name": "known_flag", "type": "expectation",
         "predicate": "nullif(l_returnflag, 'R') IN ('A', 'N')"}])


@query("row_count_check", """
    SELECT v.name, 'row_count' AS type, 'error' AS severity,
           c.n >= v.low AND (v.high IS NULL OR c.n <= v.high) AS passed,
           CAST(c.n AS DOUBLE) AS observed, CAST(v.low AS DOUBLE) AS threshold
    FROM (SELECT count(*) AS n FROM orders) c,
         (VALUES ('any', 0, NULL), ('some', 1, 1000000000000), ('too_many', 0, 10),
                 ('too_few', 1000000000000, NULL)) AS v(name, low, high)""")
def row_count_check(spark: SparkSession, folder: str) -> DataFrame:
    kind = {"type": "row_count"}
    return _verdicts(load(spark, folder, "orders"), [
        {**kind, "name": "any"},
        {**kind, "name": "some", "min_rows": 1, "max_rows": 1_000_000_000_000},
        {**kind, "name": "too_many", "max_rows": 10},
        {**kind, "name": "too_few", "min_rows": 1_000_000_000_000}])


@query("null_check", f"WITH o AS ({ORDERS_WITH_NULLS}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS total_rows,
               count(*) FILTER ({c} IS NULL) AS null_rows,
               CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE)
                    / count(*) * 100 ELSE 0.0 END AS null_percentage,
               5.0::DOUBLE AS threshold,
               CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE)
                    / count(*) * 100 ELSE 0.0 END <= 5.0 AS passed FROM o"""
    for c in ("o_custkey", "o_orderpriority", "o_totalprice")))
def null_check(spark: SparkSession, folder: str) -> DataFrame:
    return null_percentages(orders_with_nulls(spark, folder),
                            ["o_custkey", "o_orderpriority", "o_totalprice"], 5.0)


@query("freshness_check", """
    SELECT v.name, 'freshness' AS type, 'error' AS severity,
           CAST(epoch_us(v.as_of) - epoch_us(m.latest) AS DOUBLE) / 3600000000.0 <= 24 AS passed,
           CAST(epoch_us(v.as_of) - epoch_us(m.latest) AS DOUBLE) / 3600000000.0 AS observed,
           24.0::DOUBLE AS threshold
    FROM (SELECT max(ts) AS latest FROM events) m,
         (VALUES ('at_month_end', TIMESTAMP '2024-01-31'), ('a_day_later', TIMESTAMP '2024-02-01'))
           AS v(name, as_of)""")
def freshness_check(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    check = {"type": "freshness", "timestamp_column": "ts"}
    return _verdicts(events, [{**check, "name": "at_month_end"}], FRESH_AT).unionByName(
        _verdicts(events, [{**check, "name": "a_day_later"}], STALE_AT))


SUITE = (
    {"name": "rows", "type": "row_count", "min_rows": 1},
    {"name": "keys", "type": "null_check", "columns": ["o_custkey", "o_orderkey"], "threshold": 50},
    {"name": "priority", "type": "null_check", "columns": ["o_orderpriority"]},
    {"name": "recent", "type": "freshness", "timestamp_column": "o_orderdate",
     "max_age_hours": 1_000_000},
    {"name": "status", "type": "accepted_values", "columns": ["o_orderstatus"],
     "values": ["F", "O"]},
    {"name": "one_row_per_order", "type": "unique", "columns": ["o_orderkey"]},
    {"name": "customers", "type": "relationship", "columns": ["o_custkey"],
     "parent": "customer", "parent_column": "c_custkey"},
    {"name": "no_columns", "type": "null_check"},
    {"name": "no_such_column", "type": "null_check", "columns": ["o_clerk"]},
    {"name": "no_such_type", "type": "volume"},
)

# Values of every check of the suite, in SQL. A check that cannot run has no observed value.
SUITE_SQL = f"""
    WITH o AS ({ORDERS_WITH_NULLS}), c AS ({RENUMBERED_CUSTOMERS}), m AS (
      SELECT count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS nc,
             count(*) FILTER (o_orderpriority IS NULL) AS np,
             CAST(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(o_orderdate)) AS DOUBLE)
               / 3600000000.0 AS age,
             count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other,
             count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM c)) AS orphans,
             (SELECT count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1) r) AS rep
      FROM o)
    SELECT 'rows' AS name, 'row_count' AS type, 'error' AS severity, n >= 1 AS passed,
           CAST(n AS DOUBLE) AS observed, 1.0::DOUBLE AS threshold, '' AS error FROM m
    UNION ALL SELECT 'keys', 'null_check', 'error', CAST(nc AS DOUBLE) / n * 100 <= 50,
           CAST(nc AS DOUBLE) / n * 100, 50.0, '' FROM m
    UNION ALL SELECT 'priority', 'null_check', 'error', np = 0, CAST(np AS DOUBLE) / n * 100, 0.0, ''
           FROM m
    UNION ALL SELECT 'recent', 'freshness', 'error', age <= 1000000, age, 1000000.0, '' FROM m
    UNION ALL SELECT 'status', 'accepted_values', 'error', other = 0, CAST(other AS DOUBLE), 0.0, ''
           FROM m
    UNION ALL SELECT 'one_row_per_order', 'unique', 'error', rep = 0, CAST(rep AS DOUBLE), 0.0, ''
           FROM m
    UNION ALL SELECT 'customers', 'relationship', 'error', orphans = 0, CAST(orphans AS DOUBLE), 0.0,
           '' FROM m
    UNION ALL SELECT 'no_columns', 'null_check', 'error', FALSE, -1.0, -1.0, 'cannot run'
    UNION ALL SELECT 'no_such_column', 'null_check', 'error', FALSE, -1.0, -1.0, 'cannot run'
    UNION ALL SELECT 'no_such_type', 'volume', 'error', FALSE, -1.0, -1.0, 'cannot run'"""


def _suite(spark: SparkSession, folder: str) -> DataFrame:
    return suite_results(orders_with_nulls(spark, folder), SUITE, FRESH_AT,
                         {"customer": renumbered_customers(spark, folder)})


@query("suite_results", SUITE_SQL)
def suite_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every check of a suite; the wording of an error is the engine's, so only its presence is
    compared."""
    rows = _suite(spark, folder)
    return rows.select(
        "name", "type", "severity", "passed", F.coalesce("observed", F.lit(-1.0)).alias("observed"),
        F.coalesce("threshold", F.lit(-1.0)).alias("threshold"),
        F.when(F.col("error").isNotNull(), "cannot run").otherwise("").alias("error"))


@query("suite_rollup", f"""
    SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed,
           count(*) FILTER (NOT passed AND severity = 'error') AS blocking,
           bool_and(passed) AS all_passed,
           bool_and(passed OR severity <> 'error') AS passed FROM ({SUITE_SQL}) s""")
def suite_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return roll_up(_suite(spark, folder))


@query("quality_report", f"""
    SELECT 'run-1' AS run_id, 'orders' AS table_name, name AS check_name, type, severity, passed,
           CASE WHEN passed THEN 'Passed' ELSE 'Failed' END AS status,
           bool_and(passed) OVER () AS overall, TIMESTAMP '2024-01-31' AS ts
    FROM ({SUITE_SQL}) s""")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Results appended to a table of past runs and read back for one run."""
    table = fresh_table(spark, "quality_results")
    report(_suite(spark, folder), "run-1", "orders", FRESH_AT).write.mode("append").format(
        "parquet").saveAsTable(table)
    run = spark.table(table).where("run_id = 'run-1'")
    overall = run.groupBy("run_id").agg(F.bool_and("passed").alias("overall"))
    return run.join(overall, "run_id").select(
        "run_id", "table_name", "check_name", "type", "severity", "passed",
        F.when(F.col("passed"), "Passed").otherwise("Failed").alias("status"), "overall", "ts")


@query("unique_check", """
    SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def unique_check(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# The events of this day are booked on the next one: a day without rows, then one with twice as many.
QUIET_DAY = "2024-01-20"


@query("row_count_anomaly", f"""
    WITH c AS (SELECT CAST(CASE WHEN CAST(ts AS DATE) = DATE '{QUIET_DAY}'
                                THEN ts + INTERVAL 1 DAY ELSE ts END AS DATE) AS day,
                      count(*) AS n FROM events GROUP BY 1),
    d AS (SELECT s.day, coalesce(c.n, 0) AS n
          FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
                FROM c) s LEFT JOIN c ON c.day = s.day),
    w AS (SELECT day, n, count(n) OVER x AS h, sum(n) OVER x AS s, sum(n * n) OVER x AS ss FROM d
          WINDOW x AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT day, n, CASE WHEN h > 0 THEN CAST(s AS DOUBLE) / CAST(h AS DOUBLE) END AS mean,
                 CASE WHEN h > 1 THEN sqrt(CAST(h * ss - s * s AS DOUBLE)
                      / (CAST(h AS DOUBLE) * (CAST(h AS DOUBLE) - 1))) END AS sd FROM w)
    SELECT day, n AS row_count, mean AS mean_before, sd AS sd_before,
           coalesce(abs(n - mean) > 3.0 * sd, FALSE) AS is_anomaly FROM m""")
def row_count_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    quiet = F.to_date("ts") == F.lit(QUIET_DAY).cast("date")
    late = F.when(quiet, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return row_count_anomalies(events.withColumn("ts", late), "ts")


@query("accepted_values", """
    SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS rows FROM orders
    WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus
    UNION ALL
    SELECT 'event_type', event_type, count(*) FROM events
    WHERE event_type NOT IN ('signup', 'view', 'purchase') GROUP BY event_type""")
def accepted(spark: SparkSession, folder: str) -> DataFrame:
    orders = outside_values(load(spark, folder, "orders"), "o_orderstatus", ["F", "O"])
    events = outside_values(load(spark, folder, "events"), "event_type",
                            ["signup", "view", "purchase"])
    return (orders.withColumn("column_name", F.lit("o_orderstatus"))
            .unionByName(events.withColumn("column_name", F.lit("event_type"))))


@query("failing_rows", """
    WITH t AS (
      SELECT 'discount_below_tax' AS check_name, * FROM lineitem WHERE l_discount > l_tax
      UNION ALL SELECT 'small_quantity', * FROM lineitem WHERE l_quantity > 40
      UNION ALL SELECT 'not_returned', * FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY l_orderkey, l_linenumber,
                 l_partkey, l_suppkey, l_extendedprice) AS sample_no FROM t)
    SELECT check_name, l_orderkey, l_linenumber, l_partkey, l_quantity, sample_no
    FROM r WHERE sample_no <= 20""")
def failing(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"discount_below_tax": F.col("l_discount") <= F.col("l_tax"),
             "small_quantity": F.col("l_quantity") <= 40,
             "not_returned": F.col("l_returnflag") != "R"}
    rows = failing_rows(load(spark, folder, "lineitem"), rules,
                        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_extendedprice"], 20)
    return rows.select("check_name", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                       "sample_no")
