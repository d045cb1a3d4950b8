"""Per-key running values that also work when one key holds a large part of the rows.

An ordinary window puts all rows of a key in one task. It is used only when a sketch of the keys
shows that the largest group is small enough. Otherwise the rows are sorted by (key, time) into
parts of equal size, the window runs inside the parts, and what crosses a border between parts
comes from a summary with one row per part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewell.functions import quoted
from gatewell.operators.ranking import sorted_parts
from gatewell.operators.skew import largest_group

# Rows of one key that a single task may sort.
MAX_GROUP = 5_000_000


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(quoted(k)) for k in keys])


def next_time(df: DataFrame, keys: Sequence[str], time: str, tie: str, out: str,
              max_group: int = MAX_GROUP) -> DataFrame:
    """Add the time of the key's next row in (time, tie) order; null on its last row."""
    if largest_group(df, keys) <= max_group:
        window = Window.partitionBy(*keys).orderBy(time, tie)
        return df.withColumn(out, F.lead(time).over(window))
    placed = sorted_parts(df, [*keys, time, tie]).withColumn("_key", _key(keys))
    # One row per part: the first row of the part after it.
    heads = placed.where(F.col("_row") == 0).select("_part", "_key", F.col(time).alias("_time"))
    by_part = Window.orderBy("_part")
    following = heads.select("_part", F.lead("_key").over(by_part).alias("_head_key"),
                             F.lead("_time").over(by_part).alias("_head_time"))
    inside = Window.partitionBy("_part").orderBy("_row")
    paired = (placed.withColumn("_next_key", F.lead("_key").over(inside))
              .withColumn("_next_time", F.lead(time).over(inside))
              .join(F.broadcast(following), "_part"))
    value = (F.when(F.col("_next_key").isNotNull(),
                    F.when(F.col("_next_key").eqNullSafe(F.col("_key")), F.col("_next_time")))
             .when(F.col("_head_key").eqNullSafe(F.col("_key")), F.col("_head_time")))
    return paired.select(*df.columns, value.alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: Column, out: str,
                max_group: int = MAX_GROUP) -> DataFrame:
    """Add the running sum of ``value`` over the key's rows in (time, tie) order."""
    to_here = (Window.unboundedPreceding, Window.currentRow)
    if largest_group(df, keys) <= max_group:
        window = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(*to_here)
        return df.withColumn(out, F.sum(value).over(window))
    placed = (sorted_parts(df.withColumn("_value", value), [*keys, time, tie])
              .withColumn("_key", _key(keys)))
    # One row per part: its first key, its last key, and what the last key sums to in the part.
    sums = placed.groupBy("_part", "_key").agg(
        F.sum("_value").alias("_sum"), F.min("_row").alias("_from"))
    edges = sums.groupBy("_part").agg(
        F.min_by("_key", "_from").alias("_first_key"), F.max_by("_key", "_from").alias("_last_key"),
        F.max_by("_sum", "_from").alias("_last_sum"))
    # A key that goes on in the next part is the last key of every part before it that it reaches.
    through = edges.withColumn("_through", F.sum("_last_sum").over(
        Window.partitionBy("_last_key").orderBy("_part").rowsBetween(*to_here)))
    by_part = Window.orderBy("_part")
    carried = through.select(
        "_part", "_first_key",
        F.when(F.lag("_last_key").over(by_part).eqNullSafe(F.col("_first_key")),
               F.lag("_through").over(by_part)).alias("_carry"))
    inside = Window.partitionBy("_part", "_key").orderBy("_row").rowsBetween(*to_here)
    carry = F.when(F.col("_first_key").eqNullSafe(F.col("_key")), F.col("_carry"))
    return (placed.withColumn("_inside", F.sum("_value").over(inside))
            .join(F.broadcast(carried), "_part")
            .select(*df.columns, _total(F.col("_inside"), carry).alias(out)))


def _total(a: Column, b: Column) -> Column:
    """The sum of what is there; null only if both are, as in a window's sum."""
    return F.coalesce(a + b, a, b)
