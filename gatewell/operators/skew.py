"""Joins that stay balanced when a few keys hold most of the rows.

Spark's adaptive skew join splits oversized partitions at run time; that is enough for most
joins. The helper here does not depend on run-time thresholds: the heavy keys are found first by a
sketch (one pass over the key column), and only their rows take another route. A key is heavy when
it holds at least ``min_share`` of the rows, so there can never be more than ``1 / min_share``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from gatewell.functions import quoted

MIN_SHARE = 0.01
# Rows and bytes of the other side that may be broadcast for the heavy keys.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 32 << 20
SALTS = 32


def hot_keys(df: DataFrame, key: str, min_share: float = MIN_SHARE) -> list[Any]:
    """Values of ``key`` that hold at least ``min_share`` of the rows.

    The sketch may misjudge a key near the limit. That only changes which route its rows take,
    never the result.
    """
    limit = int(1 / min_share)
    found = df.where(F.col(quoted(key)).isNotNull()).agg(
        F.expr(f"approx_top_k({quoted(key)}, {limit}, {limit * 20})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    ).first()
    return [item["item"] for item in found["top"] or [] if item["count"] >= found["total"] * min_share]


# Keys the group-size sketch follows. It may be off by up to about 4 / TRACKED of all rows.
TRACKED = 20_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """No key has more rows than this: an upper bound from a sketch, in one pass over the keys."""
    listed = ", ".join(quoted(k) for k in keys)
    found = df.agg(F.expr(f"approx_top_k(xxhash64({listed}), 1, {TRACKED})").alias("top"),
                   F.count(F.lit(1)).alias("total")).first()
    error = -(-4 * found["total"] // TRACKED)
    return max([item["count"] for item in found["top"] or []] + [0]) + error


def skew_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
              how: str = "inner", min_share: float = MIN_SHARE) -> DataFrame:
    """Join ``big`` to ``small`` (``inner`` or ``left``), with heavy keys of ``big`` kept apart.

    Rows with a heavy key meet a broadcast of the few matching rows of ``small``; if those are more
    than ``BROADCAST_ROWS``, the rows are salted instead. All other rows take an ordinary shuffle
    join. Rows without a key cannot match, so a left join passes them on without a shuffle.

    Columns of ``small`` whose name ``big`` has too come out as ``right_<name>``, whichever route
    the rows take.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    new_names = distinct_names(big.columns, small.columns)
    small, small_key = small.withColumnsRenamed(new_names), new_names.get(small_key, small_key)
    left_key, right_key = F.col(quoted(big_key)), F.col(quoted(small_key))
    present = big.where(left_key.isNotNull())
    hot = hot_keys(big, big_key, min_share)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, left[quoted(big_key)] == right[quoted(small_key)], how)

    if hot:
        hot_small = small.where(right_key.isin(hot))
        hot_big = present.where(left_key.isin(hot))
        if _is_small(hot_small):
            hot_part = joined(hot_big, F.broadcast(hot_small))
        else:
            hot_part = _salted(hot_big, hot_small, big_key, small_key, how)
        result = joined(present.where(~left_key.isin(hot)),
                        small.where(~right_key.isin(hot))).unionByName(hot_part)
    else:
        result = joined(present, small)
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema]
        result = result.unionByName(big.where(left_key.isNull()).select("*", *empty))
    return result


def distinct_names(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """New names for the columns on the right that clash with one on the left."""
    taken = {c.lower() for c in [*left, *right]}
    names = {}
    for name in right:
        if name.lower() in {c.lower() for c in left}:
            new = f"right_{name}"
            while new.lower() in taken:
                new = f"right_{new}"
            taken.add(new.lower())
            names[name] = new
    return names


def _is_small(df: DataFrame) -> bool:
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]))))
    row = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    return row["n"] <= BROADCAST_ROWS and (row["bytes"] or 0) <= BROADCAST_BYTES


def _salted(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
            how: str) -> DataFrame:
    """Spread every key of ``left`` over salts and repeat ``right`` once per salt."""
    # The salt is a hash of the row, so a recomputed task makes the same choice again.
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    salted_right = right.withColumn(
        "_salt_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    condition = ((salted_left[quoted(left_key)] == salted_right[quoted(right_key)])
                 & (F.col("_salt") == F.col("_salt_r")))
    return salted_left.join(salted_right, condition, how).drop("_salt", "_salt_r")
