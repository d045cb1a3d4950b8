"""Queries over personal data, lineage, audit, approvals and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewell.functions.detectors import DETECTORS, REPLACEMENTS
from gatewell.governance.approvals import current_state, episodes
from gatewell.governance.audit import append_audit, read_audit
from gatewell.governance.column_log import column_summary, logged_column_edges
from gatewell.governance.lineage import edge_summary, run_edges, upstream
from gatewell.governance.pii import (
    create_masked_view, mask_columns, rules_from_tags, tag_tables,
)
from gatewell.governance.stages import STAGES, latest_stage, stage_reach, time_in_stage
from gatewell.plans.fixtures import (
    APPROVAL_LOG, STAGE_LOG, approval_log, source_table, stage_log,
)
from gatewell.plans.registry import query
from gatewell.session import fresh_table, load, scratch_path

# Every text column of every table.
TEXT_COLUMNS = {
    "region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"),
    "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"), "lineitem": ("l_returnflag", "l_linestatus"),
    "events": ("event_type", "props"), "documents": ("text", "lang", "source"),
    "pages": ("url", "html"), "benchmark": ("text",), "conversations": ("role", "text")}


def _rate_sql(table: str, column: str, detector: str) -> str:
    matches = f"count(*) FILTER (regexp_matches({column}, '{DETECTORS[detector]}'))"
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
            f"'{detector}' AS detector, {matches} AS match_rows, count(*) AS total_rows, "
            f"CAST({matches} AS DOUBLE) / count(*) AS match_rate, "
            f"CAST({matches} AS DOUBLE) / count(*) >= 0.01 AS tagged FROM {table}")


@query("pii_tagging", " UNION ALL ".join(
    _rate_sql(t, c, d) for t, columns in TEXT_COLUMNS.items() for c in columns for d in DETECTORS))
def pii_tagging(spark: SparkSession, folder: str) -> DataFrame:
    return tag_tables({t: load(spark, folder, t).select(*c) for t, c in TEXT_COLUMNS.items()})


def _masked_sql(column: str) -> str:
    for detector, pattern in DETECTORS.items():
        column = f"regexp_replace({column}, '{pattern}', '{REPLACEMENTS[detector]}', 'g')"
    return column


@query("masked_view", f"""
    SELECT sha256(CAST(doc_id AS VARCHAR)) AS doc_id, {_masked_sql("text")} AS text, lang
    FROM documents""")
def masked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Columns are tagged, the tags become rules, the rules a view, and readers use the view."""
    table = source_table(spark, folder, "documents")
    tags = tag_tables({table: spark.table(table).select("text", "lang")})
    rules = {"doc_id": "hash", **rules_from_tags(tags, table)}
    view = fresh_table(spark, "masked_documents")
    create_masked_view(spark, view, table, rules)
    return spark.table(view).select("doc_id", "text", "lang")


# Every event is read as a run with a log of steps that depends on k: columns are read from the raw
# data of its user and a reference set, overwritten, renamed, dropped, and folded k % 7 times.
@query("column_lineage", """
    WITH e AS (
      SELECT 'raw.user_' || user_id AS u, 'mart.' || event_type AS dst, ts,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    c AS (
      SELECT u AS src, 'value' AS src_col, dst, 'amount' AS dst_col, ts FROM e
      UNION ALL SELECT 'ref.set_' || k, 'factor', dst, 'amount', ts FROM e WHERE k % 2 = 1
      UNION ALL SELECT u, 'props', dst, 'band', ts FROM e WHERE k % 3 <> 0
      UNION ALL SELECT u, 'value', dst, 'score', ts FROM e
      UNION ALL SELECT 'ref.set_' || k, 'factor', dst, 'score', ts FROM e
                WHERE k % 2 = 1 OR k % 7 >= 5)
    SELECT src, src_col, dst, dst_col, count(*) AS runs, min(ts) AS first_seen,
           max(ts) AS last_seen
    FROM c GROUP BY src, src_col, dst, dst_col""")
def column_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Which source columns each result column of the logged runs came from."""
    events = load(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("run_id"), "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    raw = F.concat(F.lit("raw.user_"), F.col("user_id").cast("string"))
    reference = F.concat(F.lit("ref.set_"), F.col("k").cast("string"))

    def column(name, src=F.lit(None)):
        return F.struct(src.cast("string").alias("src"), F.lit(name).alias("col"))

    def step(number, out, *inputs, when=F.lit(True), dropped=False):
        listed = F.lit(None) if dropped else F.array_compact(F.array(*inputs))
        return F.when(when, F.struct(
            F.lit(number).cast("bigint").alias("step"), F.lit(out).alias("out_col"),
            listed.cast("array<struct<src: string, col: string>>").alias("in_cols")))

    k = F.col("k")
    folds = [step(4 + n, "score", column("score"), *([column("factor")] if n == 5 else []),
                  when=k % 7 >= n) for n in range(1, 7)]
    steps = events.select("run_id", F.inline(F.array_compact(F.array(
        step(1, "amount", column("value", raw)), step(1, "bucket", column("props", raw)),
        step(1, "factor", column("factor", reference)),
        step(2, "amount", column("amount"), F.when(k % 2 == 1, column("factor"))),
        step(3, "band", column("bucket"), when=k % 3 != 0), step(3, "bucket", dropped=True),
        step(4, "score", column("amount")), *folds, step(12, "factor", dropped=True)))))
    runs = events.select("run_id", F.concat(F.lit("mart."), "event_type").alias("target"), "ts")
    return column_summary(logged_column_edges(steps, runs))


@query("masked_view_customer", """
    SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey,
           regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'),
                          '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS c_name, c_mktsegment
    FROM customer""")
def masked_customers(spark: SparkSession, folder: str) -> DataFrame:
    customers = load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return mask_columns(customers, {"c_custkey": "hash", "c_name": "shape"})


# Every event is read as a run: it reads the raw data of its user and a reference set chosen by the
# run, and writes the table of its kind.
@query("lineage_edges", """
    WITH e AS (
      SELECT unnest(['raw.user_' || user_id,
                     'ref.set_' || CAST(json_extract_string(props, '$.k') AS BIGINT)]) AS src,
             'mart.' || event_type AS dst, ts FROM events)
    SELECT src, dst, count(*) AS runs, min(ts) AS first_seen, max(ts) AS last_seen
    FROM e GROUP BY src, dst""")
def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    runs = load(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("run_id"), "ts",
        F.array(F.concat(F.lit("raw.user_"), F.col("user_id").cast("string")),
                F.concat(F.lit("ref.set_"),
                         F.get_json_object("props", "$.k").cast("bigint").cast("string")))
        .alias("sources"),
        F.concat(F.lit("mart."), F.col("event_type")).alias("target"))
    return edge_summary(run_edges(runs))


# Rows as nodes: every row descends from the rows its foreign keys name.
DESCENT = """
    SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders"""


@query("lineage_upstream", f"""
    WITH RECURSIVE edges AS ({DESCENT}),
    up(node, ancestor, distance) AS (
      SELECT dst, src, CAST(1 AS BIGINT) FROM edges WHERE dst LIKE 'supplier:%'
         OR dst IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
      UNION ALL
      SELECT up.node, edges.src, up.distance + 1 FROM up JOIN edges ON up.ancestor = edges.dst
      WHERE up.distance < 20)
    SELECT node, ancestor, min(distance) AS distance FROM up GROUP BY node, ancestor""")
def lineage_upstream(spark: SparkSession, folder: str) -> DataFrame:
    def edges(table: str, parent: str, parent_key: str, child: str, child_key: str) -> DataFrame:
        return load(spark, folder, table).select(
            F.concat(F.lit(f"{parent}:"), F.col(parent_key).cast("string")).alias("src"),
            F.concat(F.lit(f"{child}:"), F.col(child_key).cast("string")).alias("dst"))

    descent = (edges("nation", "region", "n_regionkey", "nation", "n_nationkey")
               .unionByName(edges("customer", "nation", "c_nationkey", "customer", "c_custkey"))
               .unionByName(edges("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"))
               .unionByName(edges("orders", "customer", "o_custkey", "order", "o_orderkey")))
    # Asked for: where suppliers and urgent orders come from.
    starts = (load(spark, folder, "supplier")
              .select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
              .unionByName(load(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(
                  F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))))
    return upstream(descent, starts)


@query("audit_append", """
    SELECT event_id, ts, 'user_' || user_id AS actor, event_type AS action, props AS details,
           CASE WHEN event_type = 'error' THEN 'second' ELSE 'first' END AS batch_id,
           CAST(ts AS DATE) AS day FROM events""")
def audit_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches are appended; the second one is written again as after a failure."""
    path = scratch_path(spark, "audit")
    rows = load(spark, folder, "events").select(
        "event_id", "ts", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"), F.col("props").alias("details"))
    failed = F.col("action") == "error"
    append_audit(rows.where(~failed), path, "first")
    for _ in range(2):
        append_audit(rows.where(failed), path, "second")
    return read_audit(spark, path)


EPISODES = f"""
    WITH l AS ({APPROVAL_LOG}),
    n AS (SELECT *, sum(CASE WHEN action = 'requested' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY approval_id ORDER BY ts, event_id
                          ROWS UNBOUNDED PRECEDING) AS episode FROM l),
    d AS (SELECT *, row_number() OVER (PARTITION BY approval_id, episode ORDER BY ts, event_id) AS k
          FROM n WHERE action <> 'requested'),
    e AS (SELECT r.approval_id, CAST(r.episode AS BIGINT) AS episode, r.ts AS requested_at,
                 coalesce(d.action, 'pending') AS state, d.ts AS decided_at
          FROM n r LEFT JOIN d ON d.approval_id = r.approval_id AND d.episode = r.episode AND d.k = 1
          WHERE r.action = 'requested')"""


@query("approval_episodes", f"{EPISODES} SELECT * FROM e")
def approval_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(approval_log(spark, folder))


@query("approval_state", f"""{EPISODES},
    m AS (SELECT approval_id, max(episode) AS episodes FROM e GROUP BY approval_id)
    SELECT e.approval_id, m.episodes, e.state, e.requested_at, e.decided_at
    FROM e JOIN m ON e.approval_id = m.approval_id AND e.episode = m.episodes""")
def approval_state(spark: SparkSession, folder: str) -> DataFrame:
    return current_state(approval_log(spark, folder))


@query("stage_progress", f"""
    WITH l AS ({STAGE_LOG}),
    n AS (SELECT *, lead(ts) OVER (PARTITION BY pipeline_id ORDER BY ts, event_id) AS next FROM l)
    SELECT pipeline_id, stage, count(*) AS visits,
           CAST(sum(coalesce(epoch_us(next) - epoch_us(ts), 0)) AS BIGINT) AS micros_in_stage
    FROM n GROUP BY pipeline_id, stage""")
def stage_progress(spark: SparkSession, folder: str) -> DataFrame:
    return time_in_stage(stage_log(spark, folder))


@query("stage_latest", f"""
    WITH l AS ({STAGE_LOG}),
    n AS (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY ts DESC, event_id DESC) AS k
          FROM l)
    SELECT pipeline_id, stage, ts AS since FROM n WHERE k = 1""")
def stage_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_stage(stage_log(spark, folder))


@query("stage_reach", f"WITH l AS ({STAGE_LOG}) " + " UNION ALL ".join(
    f"""SELECT CAST({n + 1} AS BIGINT) AS stage_no, '{stage}' AS stage,
               count(DISTINCT pipeline_id) FILTER (stage = '{stage}') AS builds,
               CAST(count(DISTINCT pipeline_id) FILTER (stage = '{stage}') AS DOUBLE)
               / count(DISTINCT pipeline_id) AS share FROM l""" for n, stage in enumerate(STAGES)))
def reached_stages(spark: SparkSession, folder: str) -> DataFrame:
    return stage_reach(stage_log(spark, folder))
