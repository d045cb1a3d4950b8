"""Checks on edge tables, and the properties the suite promises."""

import datetime

import pytest
from pyspark.sql import functions as F

from gatewell.quality.checks import duplicate_count, repeated_keys
from gatewell.quality.rows import failing_rows, null_counts, row_count_anomalies
from gatewell.quality.suite import (
    QualityGateError, gate, report, roll_up, run_suite, suite_results,
)

AS_OF = datetime.datetime(2024, 1, 2)


def results(df, *checks, **kw):
    return {r["name"]: r for r in suite_results(df, checks, **kw).collect()}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", 1.0, AS_OF), (2, None, float("nan"), AS_OF), (3, "b", None, None),
            (3, "b", None, None)]
    return spark.createDataFrame(rows, "id long, `a.b` string, x double, ts timestamp_ntz")


def test_row_count_bounds_are_inclusive(people):
    got = results(people, {"name": "exact", "type": "row_count", "min_rows": 4, "max_rows": 4},
                  {"name": "below", "type": "row_count", "min_rows": 5},
                  {"name": "above", "type": "row_count", "max_rows": 3},
                  {"name": "open", "type": "row_count"})
    assert [got[n]["passed"] for n in ("exact", "below", "above", "open")] == [
        True, False, False, True]


def test_null_check_is_strict_and_reports_every_column(people):
    got = results(people,
                  {"name": "on", "type": "null_check", "columns": ["a.b"], "threshold": 25},
                  {"name": "over", "type": "null_check", "columns": ["a.b", "x"], "threshold": 24})
    assert got["on"]["passed"] and not got["over"]["passed"]
    assert got["over"]["details"] == {"a.b": "25.0", "x": "50.0"}
    assert got["over"]["observed"] == 50.0


def test_nan_is_not_null(people):
    counts = {r["column_name"]: r["null_count"] for r in null_counts(people).collect()}
    assert counts == {"id": 0, "a.b": 1, "x": 2, "ts": 2}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp_ntz")
    got = results(empty, {"name": "nulls", "type": "null_check", "columns": ["id"]},
                  {"name": "filled", "type": "not_empty"},
                  {"name": "fresh", "type": "freshness", "timestamp_column": "ts"},
                  {"name": "copies", "type": "duplicate_rows"},
                  {"name": "keys", "type": "unique", "columns": ["id"]}, as_of=AS_OF)
    assert {n: r["passed"] for n, r in got.items()} == {
        "nulls": True, "filled": False, "fresh": False, "copies": True, "keys": True}


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v string")
    got = results(df, {"name": "n", "type": "null_check", "columns": ["v"]},
                  {"name": "a", "type": "accepted_values", "columns": ["v"], "values": ["x"]},
                  {"name": "e", "type": "expectation", "predicate": "v = 'x'"})
    assert (got["n"]["observed"], got["n"]["passed"]) == (100.0, False)
    assert got["a"]["passed"] and not got["e"]["passed"]


def test_freshness_compares_with_as_of(people):
    check = {"name": "f", "type": "freshness", "timestamp_column": "ts", "max_age_hours": 24}
    day = datetime.timedelta(hours=24)
    assert results(people, check, as_of=AS_OF + day)["f"]["passed"]
    late = results(people, check, as_of=AS_OF + day + datetime.timedelta(microseconds=1))["f"]
    assert not late["passed"] and late["observed"] > 24
    assert "as_of" in results(people, check)["f"]["error"]


def test_bad_checks_fail_alone(people):
    got = results(people, {"name": "ok", "type": "not_empty"}, {"name": "type", "type": "volume"},
                  {"name": "cols", "type": "null_check"},
                  {"name": "missing", "type": "null_check", "columns": ["nope"]},
                  {"name": "setting", "type": "row_count", "code": "1/0"},
                  {"name": "severity", "type": "not_empty", "severity": "fatal"},
                  {"name": "parent", "type": "relationship", "columns": ["id"], "parent": "p",
                   "parent_column": "id"}, {})
    assert got["ok"]["passed"]
    for name in ("type", "cols", "missing", "setting", "severity", "parent", "unnamed_check"):
        assert not got[name]["passed"] and got[name]["error"], name


def test_check_that_throws_while_running(people):
    checks = [{"name": "boom", "type": "expectation", "predicate": "assert_true(id < 3) is null"},
              {"name": "ok", "type": "row_count", "min_rows": 1},
              {"name": "keys", "type": "unique", "columns": ["id"]}]
    got = {r["name"]: r for r in run_suite(people, checks).collect()}
    assert not got["boom"]["passed"] and got["boom"]["error"]
    assert got["ok"]["passed"] and not got["keys"]["passed"]


def test_fused_equals_one_by_one_and_ignores_layout(people):
    checks = [{"name": "r", "type": "row_count"}, {"name": "n", "type": "null_counts"},
              {"name": "u", "type": "unique", "columns": ["id"]},
              {"name": "d", "type": "duplicate_rows"},
              {"name": "e", "type": "expectation", "predicate": "id < 3", "threshold": 50}]
    together = results(people, *checks)
    shuffled = results(people.orderBy(F.desc("id")).repartition(3), *checks)
    alone = {c["name"]: results(people, c)[c["name"]] for c in checks}
    assert together == alone == shuffled


def test_fused_checks_take_one_pass(people):
    plan = suite_results(people, [{"name": "r", "type": "row_count"},
                                  {"name": "n", "type": "null_counts"},
                                  {"name": "e", "type": "expectation", "predicate": "id < 3"}])
    text = plan._jdf.queryExecution().toString()
    assert text.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_severity_decides_the_gate(people):
    warns = suite_results(people, [{"name": "n", "type": "null_counts"},
                                   {"name": "d", "type": "duplicate_rows"}])
    assert sorted(gate(warns)) == ["d", "n"]
    row = roll_up(warns).first()
    assert (row["checks"], row["failed"], row["blocking"]) == (2, 2, 0)
    assert row["passed"] and not row["all_passed"]
    with pytest.raises(QualityGateError, match="few"):
        gate(suite_results(people, [{"name": "few", "type": "row_count", "min_rows": 9}]))


def test_no_checks_pass(people):
    row = roll_up(suite_results(people, [])).first()
    assert row["passed"] and row["all_passed"] and row["checks"] == 0


def test_report_shape(people):
    frame = report(suite_results(people, [{"name": "r", "type": "row_count"}]), "run", "t", AS_OF)
    assert frame.columns == ["run_id", "table_name", "check_name", "type", "severity", "passed",
                             "observed", "threshold", "details", "error", "ts"]


def test_duplicates_with_maps_and_variants(spark):
    df = spark.sql("""SELECT * FROM VALUES (map('a', 1, 'b', 2), parse_json('{"x": 1}')),
                      (map('b', 2, 'a', 1), parse_json('{"x": 1}')),
                      (map('a', 1), parse_json('{"x": 2}')), (NULL, NULL), (NULL, NULL) AS t(m, v)""")
    for wide in (False, True):
        row = duplicate_count(df, wide).first()
        assert (row["total_rows"], row["duplicate_rows"]) == (5, 2)


def test_wide_digest_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("x", None), ("x", None)],
                               "a string, b string")
    assert duplicate_count(df, wide=True).first()["duplicate_rows"] == 1


def test_repeated_keys_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k long")
    assert [tuple(r) for r in repeated_keys(df, ["k"]).collect()] == [(None, 2)]


def test_failing_rows_limits_per_rule(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    got = failing_rows(df, {"small": F.col("v") < 5, "even": F.col("v") % 2 == 0}, ["id"], 3)
    rows = sorted((r["check_name"], r["sample_no"], r["id"]) for r in got.collect())
    assert rows == [("even", 1, 1), ("even", 2, 3), ("even", 3, 5),
                    ("small", 1, 5), ("small", 2, 6), ("small", 3, 7)]


def test_anomaly_needs_history(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=d),) for d in range(9)
            for _ in range([10, 11, 9, 10, 11, 9, 10, 30, 10][d])]
    got = row_count_anomalies(spark.createDataFrame(rows, "ts timestamp_ntz"), "ts")
    flagged = [r["day"].day for r in got.collect() if r["is_anomaly"]]
    assert flagged == [8]


@pytest.mark.parametrize("wide", [False, True])
def test_duplicates_compare_exact_values(spark, wide):
    near = AS_OF + datetime.timedelta(microseconds=1)
    df = spark.createDataFrame([(AS_OF, 0.0), (near, 0.0), (AS_OF, -0.0), (AS_OF, float("nan")),
                                (AS_OF, float("nan"))], "t timestamp_ntz, x double")
    assert duplicate_count(df, wide).first()["duplicate_rows"] == 2
    nested = df.select(F.struct("t").alias("s"), F.create_map(F.lit("k"), F.col("t")).alias("m"))
    assert duplicate_count(nested, wide).first()["duplicate_rows"] == 3
