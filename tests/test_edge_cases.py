"""Inputs beyond the fixtures: nulls, ties, clashing names, several parts, builds that overlap."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gatewell.functions.detectors import masked_sql
from gatewell.governance.approvals import ApprovalLog
from gatewell.governance.lineage import column_edges
from gatewell.observe.layout import file_size_advice
from gatewell.observe.runtime import runtime_alerts, runtime_stats
from gatewell.operators.marts import surrogate_key
from gatewell.operators.ranking import group_quantiles, top_per_group
from gatewell.operators.running import running_sum
from gatewell.operators.skew import skew_join
from gatewell.operators.steps import apply_steps
from gatewell.plans.build import default_log, release, run_build
from gatewell.plans.spec import Check, Spec
from gatewell.quality.checks import duplicate_count
from gatewell.quality.rows import row_count_anomalies
from gatewell.quality.suite import run_suite
from gatewell.retrieval.index import TermIndex
from gatewell.retrieval.vectors import vector_topk
from gatewell.session import fresh_table, scratch_path, workspace
from gatewell.sinks.changes import upsert, upsert_partitions
from gatewell.sinks.tables import backfill, create_partitioned
from gatewell.sinks.versions import VersionedTable
from gatewell.sources.incremental import new_rows
from gatewell.sources.profile import profile

T0 = datetime.datetime(2024, 1, 31)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- staged builds -----------------------------------------------------------------------------

def numbers(source, target, n):
    return Spec.of({"name": "n", "source_tables": [source], "target_table": target,
                    "transformations": [{"op": "filter", "predicate": f"id < {n}"}]})


@pytest.fixture
def build(spark):
    source, target = fresh_table(spark, "ids"), fresh_table(spark, "shown")
    spark.range(20).write.saveAsTable(source)
    log = default_log(workspace(spark), scratch_path(spark, "log"))
    return f"spark_catalog.{source}", target, log, ApprovalLog(spark, log.approvals_path)


def test_an_approval_shows_what_was_approved(spark, build):
    source, target, log, approvals = build
    a = run_build(spark, numbers(source, target, 5), "a", T0, log, require_approval=True)
    b = run_build(spark, numbers(source, target, 7), "b", T0, log, require_approval=True)
    assert a.physical != b.physical
    approvals.approve(a.approval_id, "x", T0)
    assert release(spark, numbers(source, target, 5), a, "a", T0, log).version == 1
    assert spark.table(target).count() == 5
    with pytest.raises(ValueError, match="already shown"):
        release(spark, numbers(source, target, 5), a, "a", T0, log)
    assert approvals.artifacts(b.approval_id)["staged"] == b.physical


def test_an_approval_does_not_hold_for_a_second_try(spark, build):
    source, target, log, approvals = build
    a = run_build(spark, numbers(source, target, 5), "a", T0, log, require_approval=True)
    approvals.approve(a.approval_id, "x", T0)
    later = T0 + datetime.timedelta(hours=1)
    again = run_build(spark, numbers(source, target, 7), "a", later, log, require_approval=True)
    assert again.physical == a.physical and again.approval_id != a.approval_id
    with pytest.raises(PermissionError, match="holds now"):
        release(spark, numbers(source, target, 5), a, "a", later, log)
    approvals.approve(again.approval_id, "x", later)
    assert release(spark, numbers(source, target, 7), again, "a", later, log).version == 1
    assert spark.table(target).count() == 7


def test_a_rejection_drops_nothing_visible(spark, build):
    source, target, log, approvals = build
    a = run_build(spark, numbers(source, target, 5), "a", T0, log, require_approval=True)
    run_build(spark, numbers(source, target, 9), "b", T0, log)
    approvals.reject(a.approval_id, "x", T0)
    with pytest.raises(PermissionError, match="rejected"):
        release(spark, numbers(source, target, 5), a, "a", T0, log)
    assert spark.table(target).count() == 9 and not spark.catalog.tableExists(a.physical)


def test_an_approval_of_another_table_is_refused(spark, build):
    source, target, log, approvals = build
    a = run_build(spark, numbers(source, target, 5), "a", T0, log, require_approval=True)
    b = run_build(spark, numbers(source, target, 7), "b", T0, log, require_approval=True)
    approvals.approve(a.approval_id, "x", T0)
    mixed = type(b)(b.physical, b.rows, b.warnings, approval_id=a.approval_id)
    with pytest.raises(PermissionError, match="not about"):
        release(spark, numbers(source, target, 7), mixed, "b", T0, log)


def test_a_pending_approval_is_found_by_its_folder(spark, build):
    source, target, log, _ = build
    a = run_build(spark, numbers(source, target, 5), "a", T0, log, require_approval=True)
    again = default_log(workspace(spark), log.approvals_path.rsplit("/", 1)[0])
    assert again == log and ApprovalLog(spark, again.approvals_path).status(a.approval_id) == "pending"


def test_a_run_tried_again_replaces_its_records(spark, build):
    source, target, log, _ = build
    for _ in range(2):
        run_build(spark, numbers(source, target, 5), "same", T0, log, require_approval=True)
    other = fresh_table(spark, "shown")
    run_build(spark, numbers(source, other, 5), "other", T0, log)
    for table, per_run in ((log.quality_results, 3), (log.lineage_edges, 1)):
        counts = {r["run_id"]: r["count"] for r in spark.table(table).groupBy("run_id").count().collect()}
        assert counts["same"] == counts["other"] == per_run
    table = VersionedTable(spark, other, log.versions)
    with pytest.raises(ValueError, match="already shown"):
        table.stage(spark.range(1), "other", T0)
    assert not table.discard(table.current()[1])


# ---- one behaviour on every route --------------------------------------------------------------

def test_running_sum_with_nulls_on_both_routes(spark, many_parts):
    draw = random.Random(1)
    rows = [(k % 3 if k % 7 else None, k, draw.choice([None, 1, 2, -3]) if k % 90 > 45 else None)
            for k in range(400)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v bigint").repartition(8)
    near, far = (sorted(running_sum(df, ["k"], "t", "t", F.col("v"), "s", limit).collect(), key=str)
                 for limit in (10_000, 0))
    assert near == far and any(r["s"] is None for r in near)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [0.05, 0.9])
def test_shared_names_on_both_routes(spark, how, share):
    big = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(60)], "id bigint, v bigint")
    small = spark.createDataFrame([(k, -k) for k in range(5)], "id bigint, v bigint")
    got = skew_join(big, small, "id", "id", how, share)
    assert got.columns == ["id", "v", "right_id", "right_v"]
    want = big.join(small.toDF("a", "b"), F.col("id") == F.col("a"), how)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_steps_join_tables_that_share_a_name(spark):
    a = spark.createDataFrame([(1, 2)], "id bigint, n bigint")
    b = spark.createDataFrame([(1, 5)], "id bigint, n bigint")
    step = {"op": "join", "table": "b", "left_key": "id", "right_key": "id"}
    for more in ({}, {"skew_safe": False}):
        got = apply_steps({"a": a, "b": b}, [{**step, **more}]).first().asDict()
        assert got == {"id": 1, "n": 2, "right_id": 1, "right_n": 5}
    edges = column_edges({"a": a, "b": b}, [step], "t", "r", T0).collect()
    assert {(e["src"], e["src_col"], e["dst_col"]) for e in edges} == {
        ("a", "id", "id"), ("a", "n", "n"), ("b", "id", "right_id"), ("b", "n", "right_n")}


def test_checks_look_at_every_column(spark):
    df = spark.createDataFrame([(1, 1), (2, 9)], "x bigint, y bigint")
    parent = spark.createDataFrame([(1,), (2,)], "p bigint")
    results = {r[0]: r for r in run_suite(df, [
        Check(name="values", type="accepted_values", columns=("x", "y"), values=(1, 2)),
        Check(name="parents", type="relationship", columns=("x", "y"), parent="p", parent_column="p"),
    ], None, {"p": parent}).collect()}
    assert not results["values"]["passed"] and not results["parents"]["passed"]


def test_long_addresses_are_masked_whole(spark):
    text = "secret.person." + "a" * 70 + "@example.com"
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(masked_sql("t"))).first()[0] == "<email>"


def test_top_per_group_with_a_lower_limit(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        df = spark.range(300).select(F.lit(1).alias("k"), "id")
        top = top_per_group(df, ["k"], ["id"], 20)
        assert [r["id"] for r in top.orderBy("rank").collect()] == list(range(20))
        assert "_part_rank" in top._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


# ---- partitions --------------------------------------------------------------------------------

def test_upsert_keeps_the_partition_of_nulls(spark):
    table = fresh_table(spark, "parts")
    create_partitioned(spark.createDataFrame(
        [(1, "x", "a"), (2, "y", None), (3, "z", None), (4, "w", "b")], "k bigint, v string, p string"),
        table, "p")
    upsert_partitions(spark.createDataFrame([(3, "Z", None), (9, "n", None)],
                                            "k bigint, v string, p string"), table, ["k"], "p")
    assert sorted((r["k"], r["v"], r["p"]) for r in spark.table(table).collect()) == [
        (1, "x", "a"), (2, "y", None), (3, "Z", None), (4, "w", "b"), (9, "n", None)]
    with pytest.raises(ValueError, match="another partition"):
        upsert_partitions(spark.createDataFrame([(1, "x", "b")], "k bigint, v string, p string"),
                          table, ["k"], "p")


def test_upsert_of_a_null_key(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k bigint, v string")
    new = spark.createDataFrame([(None, "c")], "k bigint, v string")
    assert sorted(r["v"] for r in upsert(old, new, ["k"]).collect()) == ["b", "c"]


def test_backfill_beside_rows_without_a_day(spark):
    table, d = fresh_table(spark, "days"), datetime.date
    create_partitioned(spark.createDataFrame([(1, None), (2, d(2024, 1, 1))], "v bigint, day date"),
                       table, "day")
    backfill(spark.createDataFrame([(5, d(2024, 1, 1))], "v bigint, day date"), table, "day",
             d(2024, 1, 1), d(2024, 1, 2))
    assert sorted(r["v"] for r in spark.table(table).collect()) == [1, 5]


# ---- statistics --------------------------------------------------------------------------------

def test_quantiles_with_one_value_in_most_rows(spark, many_parts):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.when(
        F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"))
    got = {r["k"]: (r["a"], r["b"]) for r in group_quantiles(
        df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in df.groupBy("k").agg(
        F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_runtime_keeps_jobs_without_costs_or_name(spark):
    runs = spark.createDataFrame([("a", T0, 1.0, False), ("b", T0, None, True), (None, T0, 3.0, False)],
                                 "job string, ts timestamp_ntz, cost double, failed boolean")
    both = [sorted(((r["job"], r["p50"]) for r in runtime_stats(runs, exact).collect()), key=str)
            for exact in (True, False)]
    assert both[0] == both[1] == sorted([("a", 1.0), ("b", None), (None, 3.0)], key=str)


def test_alerts_look_back_over_days_not_rows(spark):
    days = [0, 1, 20]
    runs = spark.createDataFrame([("a", T0 + datetime.timedelta(days=n), 10.0, False) for n in days],
                                 "job string, ts timestamp_ntz, cost double, failed boolean")
    got = [r["mean_before"] for r in runtime_alerts(runs, 1000).orderBy("day").collect()]
    assert got == [None, 10.0, None]


def test_a_day_without_rows_is_unusual(spark):
    rows = [(T0 + datetime.timedelta(days=d, minutes=m),) for d in range(12) if d != 9
            for m in range(50 + d % 3)]
    found = row_count_anomalies(spark.createDataFrame([*rows, (None,)], "ts timestamp_ntz"), "ts")
    by_day = {r["day"]: r for r in found.collect()}
    quiet = (T0 + datetime.timedelta(days=9)).date()
    assert len(by_day) == 12 and by_day[quiet]["row_count"] == 0 and by_day[quiet]["is_anomaly"]


def test_late_rows_and_rows_without_a_time(spark):
    def at(*pairs):
        return spark.createDataFrame(
            [(i, None if h is None else T0 + datetime.timedelta(hours=h)) for i, h in pairs],
            "id long, ts timestamp_ntz")
    target, source = at((1, 0), (2, 10), (3, None)), at((1, 0), (2, 10), (3, None), (4, None), (5, 7), (6, 11))
    assert sorted(r["id"] for r in new_rows(source, target, "ts", "id").collect()) == [4, 6]
    late = new_rows(source, target, "ts", "id", datetime.timedelta(hours=5))
    assert sorted(r["id"] for r in late.collect()) == [4, 5, 6]
    assert new_rows(source, target.unionByName(late), "ts", "id", datetime.timedelta(hours=5)).count() == 0


def test_surrogate_keys_do_not_collide(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("null", None), (None, "null")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(surrogate_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == len(rows)


def test_equal_maps_inside_structs_are_duplicates(spark):
    df = spark.sql("""SELECT named_struct('m', map('a', 1, 'b', 2), 'l', array(map(1, 2, 3, 4))) AS s
        UNION ALL SELECT named_struct('m', map('b', 2, 'a', 1), 'l', array(map(3, 4, 1, 2)))
        UNION ALL SELECT named_struct('m', map('b', 2, 'a', 9), 'l', array(map(3, 4, 1, 2)))""")
    for wide in (False, True):
        assert duplicate_count(df, wide).first()["duplicate_rows"] == 1


def test_profiles_of_dates_and_booleans(spark):
    df = spark.sql("SELECT DATE '1970-01-02' AS d, true AS b UNION ALL SELECT DATE '1970-01-05', false")
    for exact in (True, False):
        found = {r["column_name"]: (r["min_number"], r["max_number"]) for r in profile(df, exact).collect()}
        assert found == {"d": (86_400.0, 4 * 86_400.0), "b": (0.0, 1.0)}


def test_files_without_rows_are_seen(spark):
    path = scratch_path(spark, "files")
    spark.range(3).coalesce(1).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    row = file_size_advice({"t": spark.read.parquet(path)}).first()
    assert (row["files"], row["rows"]) == (2, 3)


# ---- vectors -----------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "v bigint, e array<float>")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query array<double>")


def test_vectors_that_are_not_finite_have_no_score(spark):
    rows = [(k, [1.0, float(k)]) for k in range(8)] + [(8, [float("inf"), 1.0]), (9, [float("nan"), 1.0])]
    got = vector_topk(vectors(spark, rows).coalesce(1), "v", "e", asked(spark, [1.0, 0.0]), 3)
    assert [r["v"] for r in got.orderBy("rank").collect()] == [0, 1, 2]


def test_vectors_of_another_length_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 5.0]), (3, [0.5]), (4, None), (5, [None, 1.0])]
    got = vector_topk(vectors(spark, rows), "v", "e", asked(spark, [1.0, 0.0]), 5).collect()
    assert [(r["v"], r["similarity"]) for r in got] == [(1, 1.0)]
    with pytest.raises(ValueError, match="queries"):
        vector_topk(vectors(spark, rows), "v", "e", asked(spark, [1.0, 0.0], [1.0]), 5)


def test_a_task_passes_on_k_candidates_per_query(spark):
    draw = random.Random(4)
    rows = [(k, [draw.random(), draw.random()]) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        queries = asked(spark, [1.0, 0.0], [0.3, 0.7], [0.0, 1.0])
        got = vector_topk(vectors(spark, rows).coalesce(1), "v", "e", queries, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for number, query in enumerate([[1.0, 0.0], [0.3, 0.7], [0.0, 1.0]]):
        def near(row):
            (a, b), (x, y) = row[1], query
            return round((a * x + b * y) / (a * a + b * b) ** .5 / (x * x + y * y) ** .5, 6)
        want = [k for k, _ in sorted(rows, key=lambda r: (-near(r), r[0]))[:4]]
        mine = sorted((r for r in got if r["query_id"] == number), key=lambda r: r["rank"])
        assert [near(rows[r["v"]]) for r in mine] == pytest.approx([near(rows[k]) for k in want], abs=2e-6)


# ---- the stored index --------------------------------------------------------------------------

def test_index_is_extended_and_read_by_bucket(spark):
    index = TermIndex(fresh_table(spark, "postings"), fresh_table(spark, "indexed"), 8)
    first = spark.createDataFrame([(1, "red red blue"), (2, None), (None, "red")], "d bigint, t string")
    index.add(first, "d", "t")
    index.add(first.unionByName(spark.createDataFrame([(3, "Red, green!")], "d bigint, t string")), "d", "t")
    assert {r["term"]: r["df"] for r in index.frequencies(spark).collect()} == {
        "red": 2, "blue": 1, "green": 1}
    best = index.search(spark, "d", ["red", "green blue"]).collect()
    assert {(r["query"], r["d"], r["hits"]) for r in best} == {
        ("red", 1, 2), ("red", 3, 1), ("green blue", 1, 1), ("green blue", 3, 1)}
    plan = index.of(spark, ["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket").replace(
        "[[bucket", "[bucket") or "PartitionFilters: [isnotnull(bucket" in plan


def test_index_postings_are_counted_in_their_one_shuffle(spark, monkeypatch):
    import gatewell.retrieval.index as index_module
    staged = []
    real = index_module.materialize
    monkeypatch.setattr(index_module, "materialize",
                        lambda df, label: staged.append(label) or real(df, label))
    index = TermIndex(fresh_table(spark, "postings"), fresh_table(spark, "indexed"), 4)
    rows = spark.createDataFrame([(1, "a a"), (1, "A b"), (2, "b")], "d bigint, t string")
    index.add(rows, "d", "t")
    assert "postings" not in staged  # they are not written twice
    assert {(r["term"], r["document"], r["tf"]) for r in spark.table(index.postings).collect()} == {
        ("a", 1, 3), ("b", 1, 1), ("b", 2, 1)}


def test_new_rows_without_times_come_once(spark):
    kind = "id int, ts timestamp_ntz"
    target = spark.createDataFrame([(1, None), (None, None)], kind)
    source = spark.createDataFrame([(1, None), (None, None), (2, None), (3, T0)], kind)
    assert sorted(r["id"] for r in new_rows(source, target, "ts", "id").collect()) == [2, 3]
    both = target.unionByName(new_rows(source, target, "ts", "id"))
    assert new_rows(source, both, "ts", "id").count() == 0
    assert new_rows(source, target.limit(0), "ts", "id").count() == 4


def test_upsert_refuses_repeated_source_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    for key in (1, None):
        new = spark.createDataFrame([(key, "b"), (key, "c")], "k int, v string")
        with pytest.raises(ValueError, match="order_by"):
            upsert(old, new, ["k"])
        assert upsert(old, new, ["k"], [F.col("v").desc()]).where("v = 'c'").count() == 1
