"""X1: point-in-time customer history (purchase count, return rate).

The reference takes these two features ready-made; here they are derived
without leaking the future: for each order line, only the customer's orders
from strictly earlier dates count.

Plan: lines are first aggregated per (customer, date) — partial aggregation
collapses a hot customer's rows on every task — then a running sum runs over
each customer's *dates* (rows = distinct order dates, bounded by the
calendar, not by the customer's row count), and the result is joined back on
(customer, date).  A customer holding a third of all rows therefore never
puts a third of the rows into one window partition; the join key includes
the date, and AQE splits any remaining skewed (customer, date) partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_history(lines: DataFrame, customer: str = "customer_id", date: str = "order_date",
                  order: str = "order_id", actual: str = "actual") -> DataFrame:
    """(customer, date, prior_orders, prior_lines, prior_returns)."""
    daily = (lines.groupBy(customer, date)
             .agg(F.count_distinct(order).alias("d_orders"),
                  F.count(F.lit(1)).alias("d_lines"),
                  F.sum(F.col(actual).cast("long")).alias("d_returns")))
    w = (Window.partitionBy(customer).orderBy(date)
         .rowsBetween(Window.unboundedPreceding, -1))
    return daily.select(
        customer, date,
        F.coalesce(F.sum("d_orders").over(w), F.lit(0)).cast("bigint").alias("prior_orders"),
        F.coalesce(F.sum("d_lines").over(w), F.lit(0)).cast("bigint").alias("prior_lines"),
        F.coalesce(F.sum("d_returns").over(w), F.lit(0)).cast("bigint").alias("prior_returns"))


def with_history(lines: DataFrame, customer: str = "customer_id", date: str = "order_date",
                 order: str = "order_id", actual: str = "actual") -> DataFrame:
    """Every line with its customer's history strictly before its order date:
    prior_orders, prior_lines, prior_return_rate (NULL without history)."""
    hist = daily_history(lines, customer, date, order, actual)
    rate = F.when(F.col("prior_lines") > 0,
                  F.col("prior_returns").cast("double") / F.col("prior_lines").cast("double"))
    return (lines.join(hist, [customer, date], "left")
            .select(*[F.col(c) for c in lines.columns], "prior_orders", "prior_lines",
                    rate.alias("prior_return_rate")))
