"""Which table came from which: edges from run logs and declared steps, and upstream search."""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from gatewell.functions import literal
from gatewell.operators.skew import distinct_names, skew_join
from gatewell.operators.steps import apply_step, referenced_columns
from gatewell.session import materialize

EDGE_SCHEMA = ("src string, dst string, src_col string, dst_col string, run_id string, "
               "ts timestamp_ntz")


def run_edges(runs: DataFrame) -> DataFrame:
    """One edge per run and source from rows with ``run_id, sources, target, ts``."""
    return runs.select(F.explode("sources").alias("src"), F.col("target").alias("dst"),
                       "run_id", "ts")


def edge_summary(edges: DataFrame) -> DataFrame:
    """Distinct edges with how many runs used them and when first and last."""
    return edges.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("runs"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))


def upstream(edges: DataFrame, starts: DataFrame | None = None,
             max_depth: int | None = None) -> DataFrame:
    """All ancestors of the start nodes (of every node by default) with the shortest distance.

    Level by level: the frontier is joined with the edges, pairs already known are dropped, and
    every level is stored, so a lost executor never replays earlier levels and plans stay short.
    Ancestors shared by very many nodes are heavy join keys and take the skew-safe route. Cycles
    end because a pair is expanded only once, so ``max_depth`` is only for callers who want less.
    """
    known_ends = F.col("src").isNotNull() & F.col("dst").isNotNull()
    edges = materialize(edges.select("src", "dst").where(known_ends).distinct(), "edges")
    step = edges.select(F.col("dst").alias("_child"), F.col("src").alias("_parent"))
    first = edges if starts is None else edges.join(
        starts.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    frontier = materialize(first.select(F.col("dst").alias("node"), F.col("src").alias("ancestor"),
                                        F.lit(1).cast("bigint").alias("distance")), "upstream")
    known = frontier
    for distance in itertools.count(2):
        if max_depth is not None and distance > max_depth:
            break
        reached = (skew_join(frontier.select("node", "ancestor"), step, "ancestor", "_child")
                   .select("node", F.col("_parent").alias("ancestor")).distinct()
                   .join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
                   .withColumn("distance", F.lit(distance).cast("bigint")))
        frontier = materialize(reached, "upstream")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def column_edges(inputs: Mapping[str, DataFrame], steps: Sequence[Mapping[str, Any]], target: str,
                 run_id: str, ts: datetime.datetime, start: str | None = None) -> DataFrame:
    """Source column to target column edges of a declared chain.

    The steps run over empty frames, so only schemas are looked at. Each current column carries the
    set of source columns it was computed from.
    """
    spark = next(iter(inputs.values())).sparkSession
    inputs = {name: spark.createDataFrame([], df.schema) for name, df in inputs.items()}
    start = start if start is not None else next(iter(inputs))
    df = inputs[start]
    origin = {c: {(start, c)} for c in df.columns}

    def of(frame: DataFrame, text: str) -> set:
        return set().union(*[origin[c] for c in referenced_columns(frame, text)])

    for step in steps:
        op, before = step["op"], df
        if op == "rank_segment":
            added = [*([step["rank_as"]] if "rank_as" in step else []), *step.get("tiles", {}),
                     step.get("as", "segment")]
            df = df.select("*", *[F.lit(None).cast("string").alias(name) for name in added])
        else:
            df = apply_step(df, step, inputs)
        if op == "derive":
            computed = {name: of(before, text) for name, text in step["columns"].items()}
            origin = {**origin, **computed}
        elif op == "rename":
            origin = {step["columns"].get(c, c): o for c, o in origin.items()}
        elif op == "join":
            other = inputs[step["table"]].columns
            names = distinct_names(before.columns, other)  # a left column keeps its origin
            origin = {**origin, **{names.get(c, c): {(step["table"], c)} for c in other}}
        elif op == "aggregate":
            measured = {name: of(before, text) for name, text in step["measures"].items()}
            origin = {**{c: origin[c] for c in step["keys"]}, **measured}
        elif op == "rank_segment":
            order = [t.lstrip("-") for t in step["order_by"]]
            ordered = set().union(*[origin[c] for c in order])
            origin = {**origin, **{name: ordered for name in added}}
        elif op == "sql":
            # The text is opaque: every result column may depend on every column it could read.
            tables = step.get("tables", {}).values()
            everything = set().union(*origin.values(), *[
                {(t, c) for c in inputs[t].columns} for t in tables])
            origin = {c: everything for c in df.columns}
        origin = {c: origin[c] for c in df.columns}
    rows = [(src, target, src_col, dst_col, run_id) for dst_col, sources in origin.items()
            for src, src_col in sorted(sources)]
    frame = spark.createDataFrame(
        rows, "src string, dst string, src_col string, dst_col string, run_id string")
    return frame.withColumn("ts", literal(ts))
