"""Sinks, versions, contracts, sources and the build runner."""

import datetime
import json
import os

import pytest
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import functions as F, types as T

from gatewell.governance.approvals import ApprovalLog
from gatewell.plans.build import default_log, release, run_build
from gatewell.plans.spec import Spec
from gatewell.quality.suite import QualityGateError, validate_output
from gatewell.session import fresh_table, load, scratch_path, workspace
from gatewell.sinks.changes import (
    merge_into, row_diff, table_diff, upsert, upsert_partitions,
)
from gatewell.sinks.tables import (
    append_under_contract, backfill, create_partitioned, create_table, full_refresh,
)
from gatewell.sinks.versions import VersionedTable
from gatewell.sources.catalog import (
    catalog_search, describe_table, load_tables, require_tables, validate_tables,
)
from gatewell.sources.contract import contract_check
from gatewell.sources.files import infer_json_type, read_files
from gatewell.sources.incremental import new_rows
from gatewell.sources.profile import profile
from gatewell.observe.layout import file_size_advice

T0 = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_validate_tables(spark):
    table = fresh_table(spark, "known")
    spark.range(1).write.saveAsTable(table)
    full = f"spark_catalog.{table}"
    found = validate_tables(spark, [full, table, "spark_catalog.default.nope", "nope.a.b"])
    assert found[full] == {"exists": True, "columns": ["id"]}
    assert found[table]["error"] == "Invalid table name format"
    assert not found["spark_catalog.default.nope"]["exists"]
    assert not found["nope.a.b"]["exists"] and found["nope.a.b"]["error"]
    with pytest.raises(ValueError, match="not found"):
        require_tables(spark, ["nope.a.b"])


def test_equal_leaf_names_stay_apart(spark):
    a, b = fresh_table(spark, "x"), fresh_table(spark, "y")
    spark.range(1).write.saveAsTable(a)
    spark.range(2).write.saveAsTable(b)
    assert {n: f.count() for n, f in load_tables(spark, [a, b]).items()} == {a: 1, b: 2}


def test_create_and_describe(spark):
    table = fresh_table(spark, "declared")
    create_table(spark, table, [
        {"name": "id", "data_type": "bigint", "nullable": False, "comment": "the key"},
        {"name": "v", "data_type": "decimal(18,2)"}], {"team": "it's ours"})
    found = describe_table(spark, table)
    assert [(c["name"], c["data_type"], c["comment"]) for c in found["columns"]] == [
        ("id", "bigint", "the key"), ("v", "decimal(18,2)", None)]
    assert found["properties"]["team"] == "it's ours"
    with pytest.raises(Exception):
        create_table(spark, table, [{"name": "id", "data_type": "bigint"}])


def test_append_under_contract(spark):
    table, bad = fresh_table(spark, "good"), fresh_table(spark, "bad")
    declared = create_table(spark, table, [
        {"name": "id", "data_type": "int", "nullable": False},
        {"name": "v", "data_type": "double"}])
    df = spark.createDataFrame([("1", "1.5"), (None, "2"), ("x", "n/a"), ("4", None), ("5", "1e3")],
                               "id string, v string")
    append_under_contract(df, table, bad, declared)
    assert rows(spark.table(table).fillna(-1.0)) == [(1, 1.5), (4, -1.0)]
    reasons = sorted(r["reasons"] for r in spark.table(bad).collect())
    assert reasons == ["id: not int; v: not double", "id: null", "v: not double"]


def test_contract_check_reports_missing_and_extra(spark):
    df = spark.createDataFrame([("1", None), ("x", "b")], "a string, b string")
    declared = T.StructType.fromDDL("a int, b string NOT NULL, c long")
    got = {r["column_name"]: (r["status"], r["uncastable"], r["null_violations"])
           for r in contract_check(df.withColumn("d", F.lit(1)), declared).collect()}
    assert got == {"a": ("type_differs", 1, 0), "b": ("ok", 0, 1), "c": ("missing", 0, 0),
                   "d": ("extra", 0, 0)}


def test_full_refresh_replaces_schema(spark):
    table = fresh_table(spark, "refreshed")
    assert full_refresh(spark.range(5), table) == 5
    assert full_refresh(spark.range(3).select(F.col("id").cast("string").alias("name")), table) == 3
    assert spark.table(table).columns == ["name"]


def test_backfill_twice_and_empty_day(spark):
    table = fresh_table(spark, "days")
    days = [datetime.date(2024, 1, d) for d in (1, 2, 3, 4)]
    first = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, day date")
    create_partitioned(first, table, "day")
    again = spark.createDataFrame([(10, days[1]), (11, days[1]), (99, days[3])],
                                  "id long, day date")
    for _ in range(2):
        backfill(again, table, "day", days[1], days[2])
    assert rows(spark.table(table)) == [(0, days[0]), (3, days[3]), (10, days[1]), (11, days[1])]


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "B2", 2), (4, "d", 1)],
                                "k long, v string, at long")
    merged = upsert(old, new.where("at = 1").drop("at"), ["k"])
    assert rows(merged.fillna("")) == [(1, "a"), (2, "B"), (3, ""), (4, "d")]
    latest = upsert(old.withColumn("at", F.lit(0).cast("long")), new, ["k"], [F.col("at").desc()])
    assert ("B2" in {r["v"] for r in latest.collect()}) and latest.count() == 4
    diff = {r["k"]: r["change_type"] for r in table_diff(old, merged, ["k"], ["v"]).collect()}
    assert diff == {2: "changed", 4: "added"}
    doubled = table_diff(old.unionByName(old), merged, ["k"], ["v"])
    assert {r["change_type"] for r in doubled.where("k = 1").collect()} == {"ambiguous"}
    assert rows(row_diff(old.select("v").na.drop(), merged.select("v").na.drop())) == [
        ("B", 1), ("b", -1), ("d", 1)]


def test_upsert_rewrites_only_touched_partitions(spark):
    table = fresh_table(spark, "parted")
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k long, v string, p int")
    create_partitioned(df, table, "p")
    untouched = {f for f in spark.table(table).where("p = 2").inputFiles()}
    change = spark.createDataFrame([(2, "B", 1), (4, "d", 1), (5, "e", 3)],
                                   "k long, v string, p int")
    upsert_partitions(change, table, ["k"], "p")
    assert rows(spark.table(table)) == [(1, "a", 1), (2, "B", 1), (3, "c", 2), (4, "d", 1),
                                        (5, "e", 3)]
    assert {f for f in spark.table(table).where("p = 2").inputFiles()} == untouched


def test_merge_needs_a_row_level_catalog(spark):
    table = fresh_table(spark, "plain")
    spark.range(1).write.saveAsTable(table)
    with pytest.raises(UnsupportedOperationException):
        merge_into(spark.range(2), table, ["id"])


def test_versions_roll_back_further(spark):
    name = fresh_table(spark, "versioned")
    table = VersionedTable(spark, name, fresh_table(spark, "log"))
    for n in (1, 2, 3):
        table.write(spark.range(n), T0)
    assert spark.table(name).count() == 3
    table.rollback_last_change(T0)
    assert spark.table(name).count() == 2
    table.rollback_last_change(T0)
    assert spark.table(name).count() == 1
    with pytest.raises(ValueError):
        table.rollback_last_change(T0)
    table.write(spark.range(7), T0)
    assert spark.table(name).count() == 7
    table.rollback_last_change(T0)
    assert spark.table(name).count() == 1


def test_new_rows_at_the_border(spark):
    def at(*pairs):
        return spark.createDataFrame([(i, T0 + datetime.timedelta(hours=h)) for i, h in pairs],
                                     "id long, ts timestamp_ntz")
    target, source = at((1, 0), (2, 1)), at((1, 0), (2, 1), (3, 1), (4, 2))
    fresh = new_rows(source, target, "ts", "id")
    assert sorted(r["id"] for r in fresh.collect()) == [3, 4]
    assert new_rows(source, target.unionByName(fresh), "ts", "id").count() == 0
    assert new_rows(source, target.limit(0), "ts", "id").count() == 4


def test_high_water_reaches_the_scan(spark, folder):
    events = load(spark, folder, "events")
    plan = new_rows(events, events.where("event_id < 10"), "ts", "event_id")
    text = plan._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "GreaterThan(ts" in text


def test_read_files(spark):
    path = scratch_path(spark, "csv")
    spark.range(3).write.option("header", "true").csv(path)
    assert read_files(spark, "csv", path, header="true").dtypes == [("id", "int")]
    with pytest.raises(ValueError):
        read_files(spark, "excel", path)


def test_json_inference_merges_rows(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"b": {"c": ["x"]}, "n": null}',), ("broken",)],
                               "j string")
    kind = T.StructType.fromDDL(f"x {infer_json_type(df, 'j')}")[0].dataType
    assert {f.name: f.dataType.simpleString() for f in kind.fields} == {
        "a": "bigint", "b": "struct<c:array<string>>", "n": "string"}


def test_profiles_agree(spark, folder):
    orders = load(spark, folder, "orders")
    near = {r["column_name"]: r.asDict() for r in profile(orders).collect()}
    exact = {r["column_name"]: r.asDict() for r in profile(orders, exact=True).collect()}
    for name, row in exact.items():
        assert near[name].pop("distinct_values") == pytest.approx(row.pop("distinct_values"), rel=.1)
        assert near[name] == row


def test_catalog_search(spark):
    table = fresh_table(spark, "needle")
    spark.range(1).withColumnRenamed("id", "hay_id").write.saveAsTable(table)
    by_name = catalog_search(spark, "NEEDLE", workspace(spark)).collect()
    by_column = catalog_search(spark, "hay_", workspace(spark)).collect()
    assert any(table.split(".")[1] in r["table_name"] for r in by_name)
    assert any(r["column_name"] == "hay_id" for r in by_column)


def test_file_sizes_match_the_file_system(spark, folder):
    path = scratch_path(spark, "many")
    load(spark, folder, "lineitem").repartition(6).write.parquet(path)
    row = file_size_advice({"t": spark.read.parquet(path)}).first()
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet")]
    assert (row["files"], row["bytes"], row["rows"]) == (6, sum(sizes), 6000)
    assert row["advice"] == "compact"


def _spec(source, other, target, checks=()):
    return Spec.of({
        "name": "revenue", "source_tables": [source, other], "target_table": target,
        "transformations": [
            {"op": "join", "table": other, "left_key": "o_custkey", "right_key": "c_custkey"},
            {"op": "aggregate", "keys": ["c_mktsegment"],
             "measures": {"n": "count(*)", "total": "sum(cast(o_totalprice as decimal(18,2)))"}},
            {"op": "rank_segment", "order_by": ["-total", "c_mktsegment"],
             "segments": {"top": 0.2, "rest": 1.0}}],
        "quality_checks": list(checks)})


@pytest.fixture(scope="module")
def sources(spark, folder):
    names = []
    for name in ("orders", "customer"):
        table = fresh_table(spark, name)
        load(spark, folder, name).write.saveAsTable(table)
        names.append(f"spark_catalog.{table}")
    return names


def test_build_publishes_and_records(spark, sources):
    target, log = fresh_table(spark, "mart"), default_log(workspace(spark), scratch_path(spark, "log"))
    spec = _spec(*sources, target, [
        {"name": "five", "type": "row_count", "min_rows": 5, "max_rows": 5},
        {"name": "key", "type": "unique", "columns": ["c_mktsegment"]}])
    done = run_build(spark, spec, f"run-{target}", T0, log)
    assert (done.version, done.rows, done.warnings) == (1, 5, [])
    assert spark.table(target).where("segment = 'top'").count() == 1
    results = spark.table(log.quality_results).where(F.col("table_name") == target)
    assert results.count() == 5 and results.where("not passed").count() == 0
    edges = spark.table(log.lineage_edges).where(F.col("dst") == target)
    got = {(r["src"].split(".")[-1].split("_")[0], r["src_col"], r["dst_col"])
           for r in edges.collect()}
    assert got == {("customer", "c_mktsegment", "c_mktsegment"),
                   ("orders", "o_totalprice", "total"), ("orders", "o_totalprice", "segment"),
                   ("customer", "c_mktsegment", "segment")}
    audit = spark.read.parquet(log.audit_path).collect()
    assert {r["action"] for r in audit} == {"quality_validation", "published", "stage"}
    assert json.loads(next(r["details"] for r in audit if r["action"] == "published")) == {
        "table": target, "version": 1, "rows": 5}


def test_build_waits_for_approval(spark, sources):
    target, log = fresh_table(spark, "mart"), default_log(workspace(spark), scratch_path(spark, "log"))
    spec, approvals = _spec(*sources, target), ApprovalLog(spark, log.approvals_path)
    staged = run_build(spark, spec, "run-1", T0, log, require_approval=True)
    assert staged.version is None and not spark.catalog.tableExists(target)
    with pytest.raises(PermissionError, match="pending"):
        release(spark, spec, staged, "run-1", T0, log)
    assert approvals.approve(staged.approval_id, "someone", T0, "fine")
    assert not approvals.reject(staged.approval_id, "someone", T0)
    assert release(spark, spec, staged, "run-1", T0, log).version == 1
    assert spark.table(target).count() == 5
    again = run_build(spark, spec, "run-2", T0, log, require_approval=True)
    assert approvals.reject(again.approval_id, "someone", T0, "no")
    with pytest.raises(PermissionError, match="rejected"):
        release(spark, spec, again, "run-2", T0, log)
    assert not spark.catalog.tableExists(again.physical) and spark.table(target).count() == 5
    assert approvals.status("unknown") is None and not approvals.approve("unknown", "x", T0)


def test_validate_output_by_name(spark, sources):
    passed, found = validate_output(spark, sources[0], [{"name": "n", "type": "not_empty"}])
    assert passed and found.count() == 1


def test_failed_build_leaves_target_alone(spark, sources):
    target, log = fresh_table(spark, "mart"), default_log(workspace(spark), scratch_path(spark, "log"))
    run_build(spark, _spec(*sources, target), "run-a", T0, log)
    before = rows(spark.table(target))
    bad = _spec(*sources, target, [{"name": "many", "type": "row_count", "min_rows": 1000}])
    with pytest.raises(QualityGateError, match="many"):
        run_build(spark, bad, "run-b", T0, log)
    assert rows(spark.table(target)) == before
    throws = _spec(*sources, target, [
        {"name": "boom", "type": "expectation", "predicate": "assert_true(n < 0) is null"}])
    with pytest.raises(QualityGateError, match="boom"):
        run_build(spark, throws, "run-c", T0, log)
    assert rows(spark.table(target)) == before
