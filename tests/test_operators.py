"""Ranking, running values, skewed joins and steps against brute force on small skewed tables."""

import random

import pytest
from pyspark.sql import functions as F

from gatewell.operators.cleaning import quarantine_split
from gatewell.operators.joins import lookup, orphan_keys
from gatewell.operators import skew
from gatewell.operators.ranking import (
    global_rank, group_quantiles, ntile_of, percent_rank_of, top_per_group,
)
from gatewell.operators.running import next_time, running_sum
from gatewell.operators.skew import hot_keys, skew_join
from gatewell.operators.steps import (
    apply_steps, handle_nulls, observe_steps, referenced_columns, step_metrics,
)


def skewed_rows(n=600, seed=1):
    """A third of the rows has key 0, and many share one time."""
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.choice([5, 5, rng.randrange(50)]), i,
             rng.randrange(10)) for i in range(n)]


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), "k long, t long, id long, v long").repartition(5)


def test_global_rank_with_heavy_ties(skewed):
    got = global_rank(skewed, [F.col("v").desc(), "id"], "r", total="n").collect()
    want = sorted(skewed_rows(), key=lambda r: (-r[3], r[2]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["r"])] == [w[2] for w in want]
    assert {r["n"] for r in got} == {600}


@pytest.mark.parametrize("rows", [0, 1, 3, 10, 23])
def test_tiles_and_percent_rank(spark, rows):
    df = global_rank(spark.range(rows), ["id"], "r", total="n").select(
        "id", ntile_of(F.col("r"), F.col("n"), 10).alias("tile"),
        percent_rank_of(F.col("r"), F.col("n")).alias("p"))
    spark.range(rows).createOrReplaceTempView("small")
    want = spark.sql("""SELECT id, CAST(ntile(10) OVER (ORDER BY id) AS BIGINT),
                        percent_rank() OVER (ORDER BY id) FROM small""")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_group_quantiles(skewed):
    got = {r["k"]: (r["p50"], r["p95"]) for r in
           group_quantiles(skewed, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in skewed.groupBy("k").agg(
        F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_group(skewed, n):
    got = sorted((r["k"], r["rank"], r["id"]) for r in
                 top_per_group(skewed, ["k"], ["t", "id"], n).collect())
    want = []
    for k in {r[0] for r in skewed_rows()}:
        rows = sorted((r for r in skewed_rows() if r[0] == k), key=lambda r: (r[1], r[2]))[:n]
        want += [(k, i + 1, r[2]) for i, r in enumerate(rows)]
    assert got == sorted(want)


def test_top_per_group_cuts_before_the_shuffle(skewed):
    plan = top_per_group(skewed, ["k"], ["id"], 5)._jdf.queryExecution().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("max_group", [10_000, 0])
def test_running_values(skewed, max_group):
    summed = {r["id"]: r["s"] for r in
              running_sum(skewed, ["k"], "t", "id", F.col("v"), "s", max_group).collect()}
    following = {r["id"]: r["n"] for r in
                 next_time(skewed, ["k"], "t", "id", "n", max_group).collect()}
    for k in {r[0] for r in skewed_rows()}:
        total, rows = 0, sorted((r for r in skewed_rows() if r[0] == k), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(rows):
            total += row[3]
            assert summed[row[2]] == total
            assert following[row[2]] == (rows[i + 1][1] if i + 1 < len(rows) else None)


@pytest.mark.parametrize("max_group", [10_000, 0])
def test_running_values_of_a_single_key(spark, max_group):
    df = spark.range(100).select(F.lit("x").alias("k"), F.col("id").alias("t"), "id")
    got = running_sum(df, ["k"], "t", "id", F.lit(1), "s", max_group).collect()
    assert sorted((r["id"], r["s"]) for r in got) == [(i, i + 1) for i in range(100)]


def test_hot_keys(skewed):
    assert hot_keys(skewed, "k", 0.2) == [0]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_skew_join(spark, monkeypatch, how, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    left = [(None if i % 10 == 0 else 0 if i % 3 == 0 else i % 17, i) for i in range(300)]
    big = spark.createDataFrame(left, "k long, id long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(0, 12)] + [(5, "again"), (None, "x")],
                                  "key long, name string")
    got = sorted(map(str, skew_join(big, small, "k", "key", how, 0.05).collect()))
    want = sorted(map(str, big.join(small, big["k"] == small["key"], how).collect()))
    assert got == want


def test_orphans_and_lookup(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k long")
    parent = spark.createDataFrame([(1, 100), (5, 500)], "p long, sk long")
    assert sorted(map(tuple, orphan_keys(child, parent, "k", "p").collect())) == [(2, 2), (9, 1)]
    got = lookup(child, parent, "k", "p", "sk", "member")
    assert sorted(map(str, (r["member"] for r in got.collect()))) == ["-1", "-1", "-1", "-1", "100"]


def test_quarantine_split_loses_nothing(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "x"), (-3, "y"), (None, "2")], "k long, v string")
    good, bad = quarantine_split(df, {"positive": F.col("k") > 0,
                                      "number": F.col("v").try_cast("double").isNotNull()})
    assert [r["k"] for r in good.collect()] == [1] and good.columns == ["k", "v"]
    assert sorted((str(r["k"]), r["violations"]) for r in bad.collect()) == [
        ("-3", ["positive", "number"]), ("2", ["number"]), ("None", ["positive"])]


def test_steps_reject_unknown_op(spark):
    with pytest.raises(ValueError, match="pivot"):
        apply_steps({"t": spark.range(1)}, [{"op": "pivot"}])


def test_every_step(spark):
    t = spark.createDataFrame([(1, "7", 1), (1, "8", 2), (2, "x", 3), (3, None, 4)],
                              "k long, v string, at long")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    got = apply_steps({"a.b.t": t, "a.c.t": names}, [
        {"op": "dedupe_latest", "keys": ["k"], "order_by": ["-at"]},
        {"op": "cast", "columns": {"v": "int"}},
        {"op": "join", "table": "a.c.t", "left_key": "k", "right_key": "id", "how": "left"},
        {"op": "drop_null", "columns": ["name"]},
        {"op": "fill_null", "values": {"v": 0}},
        {"op": "rename", "columns": {"v": "value"}},
        {"op": "derive", "columns": {"double": "value * 2"}},
        {"op": "filter", "predicate": "double >= 0"},
        {"op": "select", "columns": ["name", "double"]},
    ])
    assert sorted(map(tuple, got.collect())) == [("one", 16), ("two", 0)]


def test_null_policy_leaves_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, None)], "x double, y long")
    got = handle_nulls(df, {"drop": ["x"], "fill": {"y": 5}}).collect()
    assert len(got) == 1 and got[0]["y"] == 1


def test_observed_counts_equal_counted(spark):
    inputs = {"t": spark.range(20)}
    steps = [{"op": "filter", "predicate": "id > 4"}, {"op": "derive", "columns": {"x": "id + 1"}}]
    df, hooks = observe_steps(inputs, steps)
    df.write.format("noop").mode("overwrite").save()
    counted = [r["rows_out"] for r in step_metrics(inputs, steps).orderBy("step_no").collect()]
    assert [h.get["rows_out"] for _, h in hooks] == counted[1:] == [15, 15]


def test_referenced_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert referenced_columns(df, "a + coalesce(c, 1)") == ["a", "c"]


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "k long, t long, id long, v long")
    dim = spark.createDataFrame([], "key long, name string")
    assert hot_keys(empty, "k") == []
    for how in ("inner", "left"):
        assert skew_join(empty, dim, "k", "key", how).count() == 0
    for max_group in (10, -1):
        assert next_time(empty, ["k"], "t", "id", "n", max_group).count() == 0
        assert running_sum(empty, ["k"], "t", "id", F.col("v"), "s", max_group).count() == 0
    assert group_quantiles(empty, ["k"], "v", {"p": 0.5}).count() == 0


@pytest.mark.parametrize("max_group", [10_000, -1])
def test_running_values_with_null_keys_and_two_keys(spark, max_group):
    data = [(None if i % 4 == 0 else i % 3, "a" if i % 5 else None, i, i % 7) for i in range(120)]
    df = spark.createDataFrame(data, "k long, g string, t long, v long").repartition(3)
    summed = {r["t"]: r["s"] for r in
              running_sum(df, ["k", "g"], "t", "t", F.col("v"), "s", max_group).collect()}
    following = {r["t"]: r["n"] for r in
                 next_time(df, ["k", "g"], "t", "t", "n", max_group).collect()}
    for row in data:
        group = [r for r in data if r[:2] == row[:2]]
        assert summed[row[2]] == sum(r[3] for r in group if r[2] <= row[2])
        assert following[row[2]] == min((r[2] for r in group if r[2] > row[2]), default=None)


def test_join_step_without_skew_search(spark):
    inputs = {"a": spark.createDataFrame([(1,), (2,)], "k long"),
              "b": spark.createDataFrame([(1, "x")], "id long, v string")}
    step = {"op": "join", "table": "b", "left_key": "k", "right_key": "id", "how": "left"}
    plain = apply_steps(inputs, [{**step, "skew_safe": False}])
    assert sorted(map(str, plain.collect())) == sorted(map(str, apply_steps(inputs, [step]).collect()))
