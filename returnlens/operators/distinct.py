"""Distinct counts that stop early (PR13, AG20).

A theta sketch of ``2^SKETCH_LOG`` entries holds every distinct value while there are
few, and merges.  One aggregate with a sketch for each column therefore gives the
exact count of all columns with at most ``EXACT`` values, without a row of theirs
in a shuffle; of the others it only proves that they have more.  (Values are told
apart by 64-bit hashes: among 2,048 values two meet with a chance of 1e-13.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_LOG = 12
#: Half of the entries: a sketch that has begun to estimate gives far more.
EXACT = 2_048


def sketchable(c: Column, dtype: T.DataType) -> Column:
    """``c`` as a type that sketches take; -0.0 equals 0.0."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("double") + F.lit(0.0)
    return c.cast("string")


def sketched_counts(df: DataFrame, columns: dict[str, Column], **more: Column) -> tuple[dict[str, int | None], dict[str, int]]:
    """Distinct non-null values of each of ``columns`` (``sketchable`` ones), None
    for more than ``EXACT``, and the aggregates ``more``; one job."""
    found = [F.theta_sketch_estimate(F.theta_sketch_agg(x, SKETCH_LOG)).alias(f"d{i}") for i, x in enumerate(columns.values())]
    row = df.agg(*found, *[c.alias(f"m_{k}") for k, c in more.items()]).first()
    counts = {c: row[f"d{i}"] or 0 for i, c in enumerate(columns)}
    return {c: n if n <= EXACT else None for c, n in counts.items()}, {k: row[f"m_{k}"] for k in more}
