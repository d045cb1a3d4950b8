"""Marts and dimensions built from the customer, order and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewell.functions import money
from gatewell.operators.ranking import global_rank, ntile_of, percent_rank_of


def customer_revenue(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, revenue, average order value and last order per customer with orders.

    Orders are aggregated before the join: a customer with very many orders is reduced to one row
    per map task, and the join itself is between unique keys.
    """
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(money("o_totalprice")).alias("_revenue"),
        F.max("o_orderdate").alias("last_order"))
    revenue = F.col("_revenue").cast("double")
    return (customer.join(per_customer, customer["c_custkey"] == per_customer["o_custkey"])
            .select("c_custkey", "c_name", "c_mktsegment", "n_orders",
                    revenue.alias("revenue"),
                    (revenue / F.col("n_orders")).alias("avg_order_value"), "last_order"))


def segment_customers(revenue: DataFrame, high: float = 0.1, mid: float = 0.5) -> DataFrame:
    """Label customers by their place in the revenue order; ties are broken by the key."""
    ranked = global_rank(revenue, [F.col("revenue").desc(), F.col("c_custkey").asc()],
                         "revenue_rank", total="_total")
    rank, total = F.col("revenue_rank"), F.col("_total")
    label = (F.when(rank <= F.ceil(F.lit(high) * total), "high")
             .when(rank <= F.ceil(F.lit(mid) * total), "mid").otherwise("low"))
    return ranked.select(*revenue.columns, "revenue_rank",
                         ntile_of(rank, total, 10).alias("decile"),
                         percent_rank_of(rank, total).alias("pct_rank"),
                         label.alias("segment"))


def daily_sales(lineitem: DataFrame) -> DataFrame:
    """Lines, quantity, gross and discounted revenue per ship date."""
    price = money("l_extendedprice")
    net = price * (F.lit(1).cast("decimal(5,4)") - F.col("l_discount").cast("decimal(5,4)"))
    return lineitem.groupBy(F.to_date("l_shipdate").alias("sale_date")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.sum(price).cast("double").alias("gross_revenue"),
        F.sum(net).cast("double").alias("net_revenue"))


def surrogate_key(*parts: Column) -> Column:
    """A key that depends on the natural key only: no counter, no order, no coordination.

    Each part is written with its length in front, and a null as such, so no two different natural
    keys give the same text.
    """
    def written(part: Column) -> Column:
        text = part.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null"))
    return F.sha2(F.concat_ws("|", *[written(p) for p in parts]), 256)


def customer_dim(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
              .select("n_nationkey", "n_name", "r_name"))
    return (customer.join(places, customer["c_nationkey"] == places["n_nationkey"], "left")
            .select(surrogate_key(F.lit("customer"), F.col("c_custkey")).alias("customer_sk"),
                    "c_custkey", "c_name", "c_mktsegment",
                    F.coalesce("n_name", F.lit("unknown")).alias("nation"),
                    F.coalesce("r_name", F.lit("unknown")).alias("region")))


def customer_value(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """The full customer mart: revenue metrics with the segment of every customer."""
    return segment_customers(customer_revenue(customer, orders)).drop("pct_rank")
