"""Exact global ranks and quantiles without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewell.functions import quoted
from gatewell.session import materialize

# monotonically_increasing_id keeps the row number within a partition in the lower 33 bits.
ROW_BITS = 33


def sorted_parts(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Range-sort a frame over all tasks and store it, with ``_part`` and ``_row`` (from 0).

    Parts are of about equal size whatever the values are, because the sampled borders cover the
    whole order. The order must be total (end it with a key), so that retried tasks reproduce it.
    """
    stored = materialize(
        df.orderBy(*order_by).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    return (stored.withColumn("_part", F.shiftright("_place", ROW_BITS))
            .withColumn("_row", F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)).drop("_place"))


def global_rank(df: DataFrame, order_by: Sequence[Column | str], rank: str = "rank",
                total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in the order given.

    The sizes of the sorted parts give each part its offset. Ties and heavy values are split like
    any other rows.
    """
    placed = sorted_parts(df, order_by)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition: small enough for an unpartitioned window and a broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"))
    ranked = placed.join(F.broadcast(offsets), "_part")
    extra = [F.col("_total").alias(total)] if total else []
    return ranked.select(*df.columns, (F.col("_offset") + F.col("_row") + 1).alias(rank), *extra)


def ntile_of(rank: Column, total: Column, tiles: int) -> Column:
    """The tile SQL's ``ntile`` gives to a row: the first ``total % tiles`` tiles are one larger."""
    base = F.floor(total / F.lit(tiles))
    larger = total - base * tiles
    edge = larger * (base + 1)
    head = F.floor((rank - 1) / (base + 1)) + 1
    tail = larger + F.floor((rank - 1 - edge) / F.greatest(base, F.lit(1))) + 1
    return F.when(rank <= edge, head).otherwise(tail).cast("bigint")


def percent_rank_of(rank: Column, total: Column) -> Column:
    return F.when(total > 1, (rank - 1).cast("double") / (total - 1).cast("double")).otherwise(0.0)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    Equal values of a group are first counted together, before any shuffle, so one value that most
    rows have is one row from there on. The counted values are sorted by (keys, value) into parts
    of equal size; a part knows from one summary row per part how many rows of its first group
    came before. A value then covers a range of places in its group, and the wanted places are
    picked by one aggregate. Groups without any value have no row.
    """
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value"))
               .agg(F.count(F.lit(1)).alias("_count")))
    placed = sorted_parts(counted, [*keys, "_value"]).withColumn(
        "_key", F.struct(*[F.col(quoted(k)) for k in keys]))
    sums = placed.groupBy("_part", "_key").agg(F.sum("_count").alias("_sum"))
    # One row per part and group; a group in several parts gets an offset in each but the first.
    sizes = placed.groupBy("_key").agg(F.sum("_count").alias("_n"),
                                       F.countDistinct("_part").alias("_parts"))
    split = sums.join(sizes.where("_parts > 1").select("_key"), "_key", "left_semi")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.select("_part", "_key", F.sum("_sum").over(before).alias("_before"))
    inside = (Window.partitionBy("_part", "_key").orderBy("_row")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # At most as many rows as there are borders between parts.
    ranked = (placed.withColumn("_upto", F.sum("_count").over(inside))
              .join(F.broadcast(offsets), ["_part", "_key"], "left")
              .withColumn("_upto", F.col("_upto") + F.coalesce("_before", F.lit(0)))
              .join(sizes.select("_key", "_n"), "_key"))
    picks = []
    for name, prob in probs.items():
        at = F.lit(prob) * (F.col("_n") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_count"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"{name}_{side}"))
    ends = ranked.groupBy(*[F.col(quoted(k)) for k in keys], "_n").agg(*picks)
    result = []
    for name, prob in probs.items():
        at = F.lit(prob) * (F.col("_n") - 1)
        beyond = at - F.floor(at)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        result.append((low * (1 - beyond) + high * beyond).alias(name))
    return ends.select(*keys, *result)


# Up to this many rows per group Spark itself cuts groups down before the shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str],
                  n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    Filtering ``row_number`` lets Spark keep at most ``n`` rows per group in every map task before
    the shuffle, so a hot group shrinks before it meets in one task. For an ``n`` beyond Spark's
    limit for that, the groups are first cut down in salted parts.
    """
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order_by)
        df = (df.withColumn("_salt", salt).withColumn("_part_rank", F.row_number().over(part))
              .where(F.col("_part_rank") <= n).drop("_salt", "_part_rank"))
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return (df.withColumn(rank, F.row_number().over(window))
            .where(F.col(rank) <= n)
            .withColumn(rank, F.col(rank).cast("bigint")))
