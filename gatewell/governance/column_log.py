"""Column lineage of logged runs: which source columns each result column was computed from.

Steps are data. A row of the step log says that in one step of one run a column was computed from
some inputs, or was dropped:

    run_id string, step bigint, out_col string, in_cols array<struct<src string, col string>>

An input with ``src`` is a column of that table; one without is the run's own column as it was
before the step. An empty list makes a constant, a null list drops the column. Several rows for one
column of one step add up.

Most runs are short: their rows meet in one shuffle and are walked in order, run by run. What a walk
keeps grows with the square of its run, so it is for runs of at most ``WALKED`` entries. A longer run
is spread over the cluster: its versions are numbered and the pointers between them doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.operators.running import MAX_GROUP, running_sum
from gatewell.operators.skew import skew_join
from gatewell.session import materialize

STEP_SCHEMA = ("run_id string, step bigint, out_col string, "
               "in_cols array<struct<src: string, col: string>>")
# How an event of a column is sorted within a step: a step reads columns before it writes them.
_READ, _WRITE = 0, 1
# Rows of a run and their inputs, counted together, that are walked within one row of the plan.
WALKED = 256


def _code(src: Column, col: Column) -> Column:
    """A source column as one text, with the length of ``src`` in front; ``:col`` without ``src``."""
    return F.when(src.isNull(), F.concat(F.lit(":"), col)).otherwise(
        F.concat(F.length(src).cast("string"), F.lit(":"), src, col))


def _src_and_col(code: Column) -> tuple[Column, Column]:
    head = F.substring_index(code, ":", 1)
    start = F.length(head) + 2
    long = F.when(head != "", head.cast("int"))
    return (F.when(head != "", F.substring(code, start, long)),
            F.substring(code, start + F.coalesce(long, F.lit(0)), F.length(code)))


def _walked(steps: DataFrame) -> DataFrame:
    """Short runs, one row each: its rows are sorted and folded into the origins of its columns."""
    codes = F.transform(F.filter("in_cols", lambda i: i["col"].isNotNull()),
                        lambda i: _code(i["src"], i["col"]))
    # A step's drops come before what it makes, and the rows of one column are neighbours.
    logs = (steps.select("run_id", F.struct(
                "step", F.col("in_cols").isNotNull().alias("made"),
                F.concat(F.lit(":"), "out_col").alias("out"), codes.alias("inputs")).alias("row"))
            .groupBy("run_id").agg(F.sort_array(F.collect_list("row")).alias("log")))

    # Columns have the codes of inputs without a source: one that was not made is its own origin.
    def after(state: Column, row: Column) -> Column:
        same_step = row["step"].eqNullSafe(state["step"])
        before = F.when(same_step, state["before"]).otherwise(state["now"])
        origins = F.array_distinct(F.flatten(F.transform(
            row["inputs"], lambda i: F.coalesce(F.element_at(before, i), F.array(i)))))
        adds_up = same_step & (row["out"] == state["made"])
        replaced = F.transform_values(state["now"], lambda column, was: F.when(
            column != row["out"], was).when(adds_up, F.array_union(was, origins)).otherwise(origins))
        written = F.when(F.map_contains_key(state["now"], row["out"]), replaced).otherwise(
            F.map_concat(state["now"], F.create_map(row["out"], origins)))
        dropped = F.map_filter(state["now"], lambda column, _: column != row["out"])
        return F.struct(
            row["step"].alias("step"), F.when(row["made"], row["out"]).alias("made"),
            before.alias("before"), F.when(row["made"], written).otherwise(dropped).alias("now"))

    empty = F.expr("CAST(map() AS map<string, array<string>>)")
    start = F.struct(F.lit(None).cast(steps.schema["step"].dataType).alias("step"),
                     F.lit(None).cast("string").alias("made"), empty.alias("before"),
                     empty.alias("now"))
    return logs.select("run_id", F.aggregate("log", start, after, lambda s: s["now"]).alias("columns"))


def _origins(walked: DataFrame) -> DataFrame:
    others = [c for c in walked.columns if c != "columns"]
    src, col = _src_and_col(F.col("origin"))
    return (walked.select(*others, F.explode("columns").alias("out", "origins"))
            .select(*others, "out", F.explode("origins").alias("origin"))
            .select(*others, src.alias("src"), col.alias("src_col"),
                    F.expr("substring(out, 2)").alias("dst_col")))


def _versions(steps: DataFrame, max_group: int) -> tuple[DataFrame, DataFrame]:
    """Reads and writes of columns, each with the version it meets: the n-th write of its column.

    A run that holds a large part of the log is spread by column and, beyond ``max_group`` events
    of one column, by ranges of its steps.
    """
    written = steps.groupBy("run_id", F.col("out_col").alias("col"), "step").agg(
        F.max(F.col("in_cols").isNotNull()).alias("made"))
    read = (steps.select("run_id", "step", F.explode("in_cols").alias("i"))
            .where("i.src IS NULL AND i.col IS NOT NULL")
            .select("run_id", F.col("i.col").alias("col"), "step").distinct())
    events = materialize(
        written.withColumn("kind", F.lit(_WRITE)).unionByName(
            read.withColumn("made", F.lit(None).cast("boolean")).withColumn("kind", F.lit(_READ))),
        "column-events")
    counted = materialize(
        running_sum(events, ["run_id", "col"], "step", "kind",
                    (F.col("kind") == _WRITE).cast("bigint"), "version", max_group),
        "column-versions")
    writes = counted.where(F.col("kind") == _WRITE).select("run_id", "col", "step", "made", "version")
    reads = counted.where(F.col("kind") == _READ).select("run_id", "col", "step", "version")
    return writes, reads


def _followed(steps: DataFrame, max_group: int) -> DataFrame:
    """Origins of the columns of runs of any length.

    Each write of a column is a version. Versions point at the versions and source columns they were
    computed from; the pointers are then doubled, so a chain of n steps is followed in about log2(n)
    joins, each written to the shared folder.
    """
    writes, reads = _versions(steps, max_group)

    made = writes.where("made").select("run_id", F.col("col").alias("out_col"), "step",
                                       F.col("version").alias("out_version"))
    inputs = (steps.select("run_id", "step", "out_col", F.explode("in_cols").alias("i"))
              .where("i.col IS NOT NULL")
              .select("run_id", "step", "out_col", F.col("i.src").alias("src"),
                      F.col("i.col").alias("col"))
              .distinct().join(made, ["run_id", "step", "out_col"]))
    # What a read finds: the version before the step, if that one is not a drop.
    there = writes.where("made").select("run_id", "col", "version")
    resolved = reads.join(there, ["run_id", "col", "version"]).select("run_id", "step", "col", "version")
    own = (inputs.where("src IS NULL").drop("src")
           .join(resolved, ["run_id", "step", "col"], "left")
           .withColumn("src", F.lit(None).cast("string")))
    direct = inputs.where("src IS NOT NULL").withColumn("version", F.lit(None).cast("bigint"))
    shape = ["run_id", "out_col", "out_version", "src", "col", "version"]
    found = materialize(own.select(shape).unionByName(direct.select(shape)).distinct(), "column-inputs")

    final = (writes.groupBy("run_id", F.col("col").alias("out_col"))
             .agg(F.max(F.struct("version", "made")).alias("last")).where("last.made")
             .select("run_id", "out_col", F.col("last.version").alias("out_version")))
    while True:
        open_ = found.where("version IS NOT NULL")
        if open_.isEmpty():
            break
        behind = found.select("run_id", F.col("out_col").alias("col"),
                              F.col("out_version").alias("version"), F.col("src").alias("_src"),
                              F.col("col").alias("_col"), F.col("version").alias("_version"))
        followed = open_.drop("src").join(behind, ["run_id", "col", "version"]).select(
            "run_id", "out_col", "out_version", F.col("_src").alias("src"),
            F.col("_col").alias("col"), F.col("_version").alias("version"))
        found = materialize(
            found.where("version IS NULL").unionByName(followed).distinct(), "column-inputs")

    return (found.join(final, ["run_id", "out_col", "out_version"])
            .select("run_id", "src", F.col("col").alias("src_col"), F.col("out_col").alias("dst_col")))


def logged_column_edges(steps: DataFrame, runs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges ``src, dst, src_col, dst_col, run_id, ts`` of every run, from its step log.

    ``runs`` has ``run_id, target, ts``. Runs of up to ``WALKED`` rows and inputs (``max_group``, if
    that is less) are walked, longer ones are followed from version to version. Only columns that a
    run's last write left in place have edges.

    An input of the run that no earlier step made, or that was dropped before, comes out as an edge
    with a null ``src``. Rows without run, step or column, and inputs without a column name, are left
    out. Constants have no edges. Repeated rows change nothing; an empty log gives no rows.
    """
    steps = steps.select("run_id", "step", "out_col", "in_cols").where(
        "run_id IS NOT NULL AND step IS NOT NULL AND out_col IS NOT NULL")
    runs = runs.select("run_id", "target", "ts").distinct()
    entries = F.sum(F.lit(1) + F.coalesce(F.array_size("in_cols"), F.lit(0)))
    long = materialize(steps.groupBy("run_id").agg(entries.alias("entries"))
                       .where(F.col("entries") > min(WALKED, max_group)), "column-long-runs")
    if long.isEmpty():
        found = _origins(_walked(steps).join(runs, "run_id"))
    else:
        marked = skew_join(steps, long, "run_id", "run_id", "left")
        short = marked.where("entries IS NULL").select(steps.columns)
        rest = materialize(marked.where("entries IS NOT NULL").select(steps.columns), "column-long-steps")
        found = (_origins(_walked(short)).unionByName(_followed(rest, max_group))
                 .join(runs, "run_id"))
    return found.select("src", F.col("target").alias("dst"), "src_col", "dst_col", "run_id", "ts")


def column_summary(edges: DataFrame) -> DataFrame:
    """Distinct column edges with how many runs used them and when first and last."""
    return edges.groupBy("src", "src_col", "dst", "dst_col").agg(
        F.count(F.lit(1)).alias("runs"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))
