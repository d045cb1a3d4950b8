"""Declared transformation steps: an ordered list of dicts, each mapped to one DataFrame call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.errors import AnalysisException

from gatewell.functions import quoted, text_number
from gatewell.operators.ranking import global_rank, ntile_of, top_per_group
from gatewell.operators.skew import distinct_names, skew_join

Step = Mapping[str, Any]


def _order(terms: Sequence[str]):
    """``"-name"`` sorts descending, ``"name"`` ascending."""
    return [F.col(quoted(t[1:])).desc() if t.startswith("-") else F.col(quoted(t)).asc()
            for t in terms]


def select(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in step["columns"]])


def filter_rows(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return df.where(F.expr(step["predicate"]))


def derive(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in step["columns"].items()})


def cast(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Casts never stop the run: what does not fit becomes null."""
    types = dict(df.dtypes)
    return df.withColumns({
        name: text_number(F.col(quoted(name)), to)
        if types[name] == "string" and _is_number(to) else F.col(quoted(name)).try_cast(to)
        for name, to in step["columns"].items()})


def _is_number(to: str) -> bool:
    return to.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double",
                                "decimal")


def rename(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return df.withColumnsRenamed(dict(step["columns"]))


def fill_null(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return df.withColumns({
        name: F.coalesce(F.col(quoted(name)), F.lit(value).cast(df.schema[name].dataType))
        for name, value in step["values"].items()})


def drop_null(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    # dropna reads NaN as null as well; only null counts here.
    keep = F.lit(True)
    for name in step["columns"]:
        keep = keep & F.col(quoted(name)).isNotNull()
    return df.where(keep)


def dedupe_latest(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return top_per_group(df, step["keys"], _order(step["order_by"]), 1, "_rank").drop("_rank")


def join(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Heavy keys are looked for in the rows so far, which reads them once more; a step that is
    costly to repeat and known to be even can say ``"skew_safe": False``. Columns of the other
    table whose name is taken come out as ``right_<name>``."""
    other, how = inputs[step["table"]], step.get("how", "inner")
    left, right = step["left_key"], step["right_key"]
    if step.get("skew_safe", True):
        return skew_join(df, other, left, right, how)
    names = distinct_names(df.columns, other.columns)
    other, right = other.withColumnsRenamed(names), names.get(right, right)
    return df.join(other, df[quoted(left)] == other[quoted(right)], how)


def aggregate(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    measures = [F.expr(text).alias(name) for name, text in step["measures"].items()]
    return df.groupBy(*[F.col(quoted(c)) for c in step["keys"]]).agg(*measures)


def rank_segment(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Label rows by their share from the top: the first label whose limit they are within.

    ``rank_as`` also keeps the place itself, ``tiles`` (name to number) adds tiles of equal size.
    """
    ranked = global_rank(df, _order(step["order_by"]), "_rank", total="_total")
    label = F.lit(None).cast("string")
    for name, limit in reversed(list(step["segments"].items())):
        label = F.when(F.col("_rank") <= F.ceil(F.lit(limit) * F.col("_total")),
                       F.lit(name)).otherwise(label)
    extra = [F.col("_rank").alias(step["rank_as"])] if "rank_as" in step else []
    extra += [ntile_of(F.col("_rank"), F.col("_total"), n).alias(name)
              for name, n in step.get("tiles", {}).items()]
    return ranked.select(*df.columns, *extra, label.alias(step.get("as", "segment")))


def sql(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """A SQL text over ``{current}`` and the inputs named in ``tables``, with bound parameters."""
    frames = {alias: inputs[table] for alias, table in step.get("tables", {}).items()}
    return df.sparkSession.sql(step["text"], args=step.get("args"), current=df, **frames)


STEPS = {
    "select": select, "filter": filter_rows, "derive": derive, "cast": cast, "rename": rename,
    "fill_null": fill_null, "drop_null": drop_null, "dedupe_latest": dedupe_latest, "join": join,
    "aggregate": aggregate, "rank_segment": rank_segment, "sql": sql,
}


def apply_step(df: DataFrame, step: Step, inputs: Mapping[str, DataFrame]) -> DataFrame:
    if step.get("op") not in STEPS:
        raise ValueError(f"unknown step: {step.get('op')!r}")
    return STEPS[step["op"]](df, step, inputs)


def apply_steps(inputs: Mapping[str, DataFrame], steps: Sequence[Step],
                start: str | None = None) -> DataFrame:
    """Run the steps in order, beginning with the input ``start`` (the first one by default)."""
    df = inputs[start if start is not None else next(iter(inputs))]
    for step in steps:
        df = apply_step(df, step, inputs)
    return df


def handle_nulls(df: DataFrame, policy: Mapping[str, Any]) -> DataFrame:
    """Per-column null policy: ``{"fill": {col: value}, "drop": [cols]}``; other columns keep."""
    df = drop_null(df, {"columns": policy.get("drop", [])}, {})
    return fill_null(df, {"values": policy.get("fill", {})}, {})


def step_metrics(inputs: Mapping[str, DataFrame], steps: Sequence[Step],
                 start: str | None = None) -> DataFrame:
    """Rows in, rows out and null cells out of every step, as a table.

    Counted by aggregates, so the numbers hold even when stages are recomputed; each step costs
    one evaluation of the chain up to it. ``observe_steps`` is the free, less strict form.
    """
    df = inputs[start if start is not None else next(iter(inputs))]
    frames = [("source", df)]
    for step in steps:
        df = apply_step(df, step, inputs)
        frames.append((step["op"], df))
    counted = None
    for number, (name, frame) in enumerate(frames):
        row = frame.agg(F.count(F.lit(1)).alias("rows_out"), _null_cells(frame).alias("null_cells"))
        row = row.select(F.lit(number).cast("bigint").alias("step_no"), F.lit(name).alias("step"),
                         "rows_out", "null_cells")
        counted = row if counted is None else counted.unionByName(row)
    # One row per declared step; the pairing needs no more than a list on the executor.
    return (counted.agg(F.array_sort(F.collect_list(F.struct(
        "step_no", "step", "rows_out", "null_cells"))).alias("all"))
        .select(F.expr(
            "inline(transform(all, (x, i) -> named_struct('step_no', x.step_no, 'step', x.step, "
            "'rows_in', if(i = 0, x.rows_out, all[greatest(i - 1, 0)].rows_out), "
            "'rows_out', x.rows_out, 'null_cells', x.null_cells)))")))


def _null_cells(df: DataFrame):
    per_column = [F.count_if(F.col(quoted(c)).isNull()) for c in df.columns]
    return sum(per_column[1:], per_column[0])


def observe_steps(inputs: Mapping[str, DataFrame], steps: Sequence[Step],
                  start: str | None = None) -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """The chain with a row count hooked to every step, filled in when the result is written.

    For progress logs: no extra pass, but a stage that is recomputed after a lost executor may be
    counted twice.
    """
    df = inputs[start if start is not None else next(iter(inputs))]
    hooks = []
    for number, step in enumerate(steps):
        df = apply_step(df, step, inputs)
        hook = Observation(f"step{number}")
        df = df.observe(hook, F.count(F.lit(1)).alias("rows_out"))
        hooks.append((step["op"], hook))
    return df, hooks


def referenced_columns(df: DataFrame, text: str) -> list[str]:
    """Columns an expression reads, found by asking Spark to resolve it without each of them."""
    found = []
    for name in df.columns:
        try:
            df.drop(name).select(F.expr(text)).schema
        except AnalysisException:
            found.append(name)
    return found


