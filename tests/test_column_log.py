"""Column lineage from a step log, against a walk over the steps in order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gatewell.governance import column_log
from gatewell.governance.column_log import STEP_SCHEMA, column_summary, logged_column_edges
from gatewell.governance.lineage import column_edges
from gatewell.session import load

T0 = datetime.datetime(2024, 1, 31)
RUNS = "run_id string, target string, ts timestamp_ntz"


def edges(spark, rows, **options):
    runs = sorted({r[0] for r in rows if r[0] is not None})
    found = logged_column_edges(spark.createDataFrame(rows, STEP_SCHEMA),
                                spark.createDataFrame([(r, "t", T0) for r in runs], RUNS), **options)
    return sorted((r["run_id"], r["dst_col"], r["src"], r["src_col"]) for r in found.collect())


def walked(rows):
    found = set()
    for run in {r[0] for r in rows}:
        state = {}
        for number in sorted({r[1] for r in rows if r[0] == run}):
            before, made, gone = dict(state), {}, set()
            for _, _, out, inputs in [r for r in rows if r[:2] == (run, number)]:
                if inputs is None:
                    gone.add(out)
                    continue
                for src, col in inputs:
                    known = {(src, col)} if src is not None else before.get(col, {(None, col)})
                    made.setdefault(out, set()).update(known)
                made.setdefault(out, set())
            state = {c: o for c, o in state.items() if c not in gone} | made
        found |= {(run, c, *o) for c, origins in state.items() for o in origins}
    return sorted(found, key=repr)


@pytest.mark.parametrize("max_group", [5_000_000, 3])
def test_log_against_a_walk(spark, max_group):
    draw = random.Random(11)
    rows = []
    for run in "abc":
        for number in range(1, 30):
            out = draw.choice("pqrst")
            if draw.random() < 0.1:
                rows.append((run, number, out, None))
                continue
            inputs = [draw.choice([("raw", "x"), ("raw", "y"), ("ref", "x"),
                                   *[(None, c) for c in "pqrst"] * 2])
                      for _ in range(draw.randrange(3))]
            rows.append((run, number, out, inputs))
    rows += rows[::7]  # repeated rows change nothing
    rows.append(("a", 30, "two", [("raw", "x")]))
    rows.append(("a", 30, "two", [("raw", "y")]))  # rows of one column and step add up
    got = edges_with_nulls(spark, rows, max_group)
    assert got == walked(rows)


def edges_with_nulls(spark, rows, max_group):
    found = logged_column_edges(
        spark.createDataFrame(rows, STEP_SCHEMA),
        spark.createDataFrame([(r, "t", T0) for r in sorted({r[0] for r in rows})], RUNS), max_group)
    return sorted({(r["run_id"], r["dst_col"], r["src"], r["src_col"]) for r in found.collect()}, key=repr)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    from gatewell.governance import column_log
    written = []
    plain = column_log.materialize
    monkeypatch.setattr(column_log, "materialize", lambda df, label: (
        written.append(label), plain(df, label))[1])
    chain = [("r", 1, "c", [("raw", "x")])] + [("r", n, "c", [(None, "c")]) for n in range(2, 301)]
    assert edges(spark, chain) == [("r", "c", "raw", "x")]
    assert written.count("column-inputs") <= 11


def busy_rows(draw, run, steps):
    """Several rows a step, names that look like codes, and columns read and written in one step."""
    rows = []
    for number in range(1, steps):
        for _ in range(draw.randrange(1, 4)):
            out = draw.choice(["p", "q", ":p", "1:p"])
            inputs = [draw.choice([("raw", "x"), ("", "x"), ("r:", "1:p"), ("1", ":p"),
                                   *[(None, c) for c in ("p", "q", ":p", "1:p", "")] * 2])
                      for _ in range(draw.randrange(4))]
            rows.append((run, number, out, inputs if draw.random() < 0.8 else None))
    return rows


def test_short_and_long_runs_against_a_walk(spark):
    draw = random.Random(5)
    rows = [r for run in "abcdef" for r in busy_rows(draw, run, 12)]
    short = walked(rows)
    assert edges_with_nulls(spark, rows, 5_000_000) == short
    assert edges_with_nulls(spark, rows, 3) == short
    # One run with most of the rows and some with few, in one log.
    rows += busy_rows(draw, "long", column_log.WALKED)
    assert edges_with_nulls(spark, rows, 5_000_000) == walked(rows)


def test_short_runs_write_no_rounds(spark, monkeypatch):
    written = []
    plain = column_log.materialize
    monkeypatch.setattr(column_log, "materialize", lambda df, label: (
        written.append(label), plain(df, label))[1])
    rows = [(f"r{r}", n, "c", [(None, "c")] if n else [("raw", "x")]) for r in range(50) for n in range(20)]
    assert edges(spark, rows) == sorted((f"r{r}", "c", "raw", "x") for r in range(50))
    assert written == ["column-long-runs"]


def test_constants_drops_and_what_is_missing(spark):
    rows = [("r", 1, "one", []), ("r", 1, "gone", [("raw", "x")]), ("r", 2, "kept", [(None, "gone")]),
            ("r", 2, "gone", None), ("r", 3, "late", [(None, "gone")]), (None, 1, "z", [("raw", "x")]),
            ("r", None, "z", [("raw", "x")]), ("r", 4, None, [("raw", "x")]), ("r", 5, "w", [("raw", None)])]
    found = logged_column_edges(spark.createDataFrame(rows, STEP_SCHEMA),
                                spark.createDataFrame([("r", "t", T0)], RUNS))
    assert {(r["dst_col"], r["src"], r["src_col"]) for r in found.collect()} == {
        ("kept", "raw", "x"), ("late", None, "gone")}


def test_empty_log(spark):
    found = logged_column_edges(spark.createDataFrame([], STEP_SCHEMA),
                                spark.createDataFrame([], RUNS))
    assert column_summary(found).count() == 0


def test_summary_counts_runs(spark):
    rows = [(run, 1, "c", [("raw", "x")]) for run in "ab"]
    found = logged_column_edges(spark.createDataFrame(rows, STEP_SCHEMA),
                                spark.createDataFrame([(r, "t", T0) for r in "ab"], RUNS))
    assert column_summary(found).select("runs", F.col("first_seen")).collect() == [(2, T0)]


def test_declared_chain(spark, folder):
    inputs = {t: load(spark, folder, t) for t in ("orders", "customer")}
    steps = [
        {"op": "join", "table": "customer", "left_key": "o_custkey", "right_key": "c_custkey"},
        {"op": "aggregate", "keys": ["c_mktsegment"],
         "measures": {"revenue": "sum(o_totalprice)", "n": "count(o_orderkey)"}},
        {"op": "rank_segment", "order_by": ["-revenue", "c_mktsegment"], "as": "label",
         "segments": {"top": 0.2, "rest": 1.0}}]
    found = column_edges(inputs, steps, "mart", "run", T0).select("src", "src_col", "dst_col")
    assert sorted(map(tuple, found.collect())) == [
        ("customer", "c_mktsegment", "c_mktsegment"), ("customer", "c_mktsegment", "label"),
        ("orders", "o_orderkey", "n"), ("orders", "o_totalprice", "label"),
        ("orders", "o_totalprice", "revenue")]
