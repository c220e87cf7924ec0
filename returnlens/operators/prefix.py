"""Exact running sums over a global order without a single-task window.

A plain ``Window.orderBy(x)`` (no partition) sends every row to one task.
Here rows are dealt by ranges of (group, ordered key) - Spark samples the
full keys, whatever their type, so long common prefixes or uneven values do
not matter - and stored once with the number of their range.  The running sum
is taken inside (group, range); each range's offset comes from a table with a
row for each (group, range), whose number follows the session's shuffle
partitions, not the data.  There is one plan for every size.

A value that holds a third of all rows still collapses to one row, because
callers pass tables with one row per distinct ordered key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RANGE = "__range"


def ranged(df: DataFrame, group_cols: Sequence[str], order_col: str) -> DataFrame:
    """``df`` stored by ranges of (group, order), with the range's number,
    which never decreases in that order.  Rows without an order value go."""
    cut = (df.where(F.col(order_col).isNotNull()).repartitionByRange(*group_cols, order_col)
           .withColumn(RANGE, F.spark_partition_id()))
    return materialize(cut)


def running_sums(df: DataFrame, group_cols: Sequence[str], order_col: str,
                 sum_cols: Sequence[str], descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<s>`` = sum of ``s`` over the rows of the same group whose
    ``order_col`` comes at or before this row's (ascending or descending).

    ``df`` holds one row per (group, order value), as it is or already
    ``ranged`` by the same columns.  Rows with a NULL order value are dropped."""
    cut = df if RANGE in df.columns else ranged(df, group_cols, order_col)

    def by(column: str):
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy(*group_cols, RANGE).orderBy(by(order_col)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = cut.select("*", *[F.sum(s).over(inside).alias(f"__run_{s}") for s in sum_cols])

    totals = cut.groupBy(*group_cols, RANGE).agg(*[F.sum(s).alias(f"__tot_{s}") for s in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy(by(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, RANGE, *[
        F.coalesce(F.sum(f"__tot_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sum_cols])

    joined = running.join(offsets, [*group_cols, RANGE])
    return joined.select(*[F.col(c) for c in cut.columns if c != RANGE],
                         *[(F.col(f"__run_{s}") + F.col(f"__off_{s}")).alias(f"{prefix}{s}") for s in sum_cols])
