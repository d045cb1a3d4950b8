"""The named joins: customers with orders, orphan detection, fact rows to dimension keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import quoted
from gatewell.operators.skew import skew_join

UNKNOWN_MEMBER = -1


def customer_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Every order with its customer; one customer may hold a large part of the orders."""
    return skew_join(orders, customer, "o_custkey", "c_custkey")


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str,
                parent_key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows. Null keys are not orphans.

    Child rows are counted per key before the join, so a hot key is one row when it shuffles.
    """
    keys = (child.where(F.col(quoted(child_key)).isNotNull())
            .groupBy(F.col(quoted(child_key)).alias("key")).agg(F.count(F.lit(1)).alias("rows")))
    parents = parent.select(F.col(quoted(parent_key)).alias("key"))
    return keys.join(parents, "key", "left_anti")


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, member: str,
           out: str, unknown: Column | None = None) -> DataFrame:
    """Replace a natural key by the dimension's ``member`` (a surrogate key, or a struct of them).

    Keys that are null or not found get the unknown member, -1 unless another is given.
    """
    if unknown is None:
        unknown = F.lit(UNKNOWN_MEMBER).cast(dim.schema[member].dataType)
    members = dim.select(F.col(quoted(dim_key)).alias("_dim_key"),
                         F.col(quoted(member)).alias("_member"))
    joined = skew_join(fact, members, fact_key, "_dim_key", "left")
    return joined.withColumn(out, F.coalesce("_member", unknown)).drop("_dim_key", "_member")
