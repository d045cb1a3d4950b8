"""Keyed changes between two states of a table: upsert and before/after comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.operators.ranking import top_per_group
from gatewell.sinks.tables import overwrite_partitions


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           order_by: Sequence[Column] | None = None) -> DataFrame:
    """The target after new keys are inserted and known keys replaced.

    With ``order_by`` only the first source row per key counts; without it a repeated source key is
    refused, which reads the source's keys once more. Nulls in keys are equal to each other here, so a row with a null key replaces the one
    before it. Write the result as a new version: files cannot be overwritten while they are read.
    """
    if order_by:
        source = top_per_group(source, keys, order_by, 1, "_rank").drop("_rank")
    elif not (source.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_rows"))
              .where("_rows > 1").isEmpty()):
        raise ValueError(f"the source repeats a key of {list(keys)}: say which row counts by order_by")
    known = source.select(*[F.col(quoted(k)).alias(f"_key{n}") for n, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [
        F.col(quoted(k)).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)])
    return target.join(known, same, "left_anti").unionByName(source)


def upsert_partitions(source: DataFrame, table: str, keys: Sequence[str], partition_by: str,
                      order_by: Sequence[Column] | None = None) -> None:
    """Upsert into a partitioned table by rewriting only the partitions the source touches.

    The partition of a key must not change: that is checked, and nothing is written if one did.
    Touched partitions are found by a null-safe semi-join, so rows without a partition value are
    kept like all others and no list of values reaches the driver.
    """
    target = source.sparkSession.table(table)
    touched = source.select(F.col(quoted(partition_by)).alias("_touched")).distinct()
    affected = target.join(touched, F.col(quoted(partition_by)).eqNullSafe(F.col("_touched")),
                           "left_semi")
    elsewhere = target.select(*[F.col(quoted(k)).alias(f"_key{n}") for n, k in enumerate(keys)],
                              F.col(quoted(partition_by)).alias("_at"))
    moved = reduce(lambda a, b: a & b, [
        F.col(quoted(k)).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]
        + [~F.col(quoted(partition_by)).eqNullSafe(F.col("_at"))])
    if not source.join(elsewhere, moved, "left_semi").isEmpty():
        raise ValueError(f"a key of the source is in another partition of {table}")
    overwrite_partitions(upsert(affected, source.select(*target.columns), keys, order_by), table,
                         partition_by)


def merge_into(source: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Upsert by row-level MERGE, for catalogs that support it (Parquet tables do not)."""
    match = [F.col(f"{table}.{quoted(k)}") == F.col(f"source.{quoted(k)}") for k in keys]
    (source.alias("source").mergeInto(table, reduce(lambda a, b: a & b, match))
     .whenMatched().updateAll().whenNotMatched().insertAll().merge())


def table_diff(before: DataFrame, after: DataFrame, keys: Sequence[str],
               compare: Sequence[str]) -> DataFrame:
    """Added, removed and changed keys with the values of both sides.

    Both states are stacked and grouped by key, so every row shuffles once and repeated keys do
    not multiply: a key that occurs twice on a side is reported as ``ambiguous``.
    """
    stacked = (before.select(*keys, *compare, F.lit("b").alias("_side"))
               .unionByName(after.select(*keys, *compare, F.lit("a").alias("_side"))))
    old, new = F.col("_side") == "b", F.col("_side") == "a"
    grouped = stacked.groupBy(*keys).agg(
        F.count_if(old).alias("_n_old"), F.count_if(new).alias("_n_new"),
        *[F.max(F.when(old, F.col(quoted(c)))).alias(f"before_{c}") for c in compare],
        *[F.max(F.when(new, F.col(quoted(c)))).alias(f"after_{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(quoted(f"before_{c}")).eqNullSafe(F.col(quoted(f"after_{c}")))
    kind = (F.when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), "ambiguous")
            .when(F.col("_n_old") == 0, "added").when(F.col("_n_new") == 0, "removed")
            .when(~same, "changed"))
    return (grouped.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
            .drop("_n_old", "_n_new"))


def row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whole-row differences for tables without a key, with how many copies more or less."""
    columns = before.columns
    stacked = (before.select(*columns, F.lit(-1).alias("_n"))
               .unionByName(after.select(*columns, F.lit(1).alias("_n"))))
    return (stacked.groupBy(*[F.col(quoted(c)) for c in columns])
            .agg(F.sum("_n").alias("copies_delta")).where(F.col("copies_delta") != 0))
