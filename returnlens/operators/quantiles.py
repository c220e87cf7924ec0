"""Exact order statistics (medians, class cuts) from a sketch's bracket.

A first pass takes a mergeable quantile sketch of every column, which brackets the
rank asked for.  A second counts what lies below the bracket and keeps only the
values inside it, a few parts in ``SKETCH`` of all: what is shuffled does not
depend on how many distinct values a column has.  The rank is then exact among the
values kept, by running counts over ranges (``prefix``), so no task ever holds a
whole column.  The counts prove that a bracket holds its rank; one that does not
is opened to all values, so results never depend on the sketch.
Only one row for each rank asked for reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import running_sums

#: Accuracy of the sketch: its ranks are off by at most one row in so many.
SKETCH = 10_000
_ALL = (float("-inf"), float("inf"))


def rank_values(counts: DataFrame, targets: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Value at each requested 0-based rank: ``{(column, rank): value}``.
    Ranks must be below the column's row total."""
    hit = None
    for c, ranks in targets.items():
        for k in sorted(set(ranks)):
            at = (F.col("column") == c) & (F.col("cum_n") - F.col("n") <= k) & (F.col("cum_n") > k)
            hit = at if hit is None else hit | at
    if hit is None:
        return {}
    rows = running_sums(counts, ["column"], "value", ["n"]).where(hit).collect()
    return {(c, k): r["value"] for c, ranks in targets.items() for k in ranks
            for r in rows if r["column"] == c and r["cum_n"] - r["n"] <= k < r["cum_n"]}


def value_counts(long: DataFrame) -> DataFrame:
    """(column, value, n) from (column, value) pairs."""
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _bracketed(df: DataFrame, columns: dict[str, Column], brackets: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, value, n) of the values inside their column's bracket, and with
    the value NULL the number of those below it.  Stored."""
    cells = []
    for c, (lo, hi) in brackets.items():
        x = columns[c]
        cells.append(F.when(x <= hi, F.struct(F.lit(c).alias("column"), F.when(x >= lo, x).alias("value"))))
    long = df.select(F.explode(F.array(*cells)).alias("kv")).where(F.col("kv").isNotNull()).select("kv.*")
    return materialize(value_counts(long))


def order_statistics(df: DataFrame, columns: dict[str, Column], share: float,
                     wanted: Callable[[int], Sequence[int]]) -> dict[tuple[str, int], float]:
    """``{(column, rank): value}`` for the 0-based ranks ``wanted(n)`` of each of
    ``columns`` (DOUBLE, not NaN) with ``n`` values; NULLs don't count, and columns
    without values are absent.  The ranks lie near ``share`` of ``n``: the nearer,
    the less is kept, but any rank below ``n`` is found."""
    if not columns:
        return {}
    around = F.array(F.lit(max(0.0, share - 2 / SKETCH)), F.lit(min(1.0, share + 2 / SKETCH)))
    seen = df.agg(*[a for i, x in enumerate(columns.values()) for a in (
        F.count(x).alias(f"n{i}"), F.percentile_approx(x, around, SKETCH).alias(f"q{i}"))]).first()
    ranks, brackets = {}, {}
    for i, c in enumerate(columns):
        found = list(wanted(seen[f"n{i}"])) if seen[f"n{i}"] else []
        if found:
            ranks[c], brackets[c] = found, tuple(seen[f"q{i}"])
    out: dict[tuple[str, int], float] = {}
    while brackets:
        kept = _bracketed(df, columns, brackets)
        sums = {r["column"]: r for r in kept.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("inside")).collect()}
        held = {c: sums[c]["below"] for c in brackets if c in sums and
                sums[c]["below"] <= min(ranks[c]) and max(ranks[c]) < sums[c]["below"] + sums[c]["inside"]}
        got = rank_values(kept.where(F.col("value").isNotNull()), {c: [k - below for k in ranks[c]] for c, below in held.items()})
        out |= {(c, k + held[c]): x for (c, k), x in got.items()}
        if any(brackets[c] == _ALL for c in brackets if c not in held):
            raise ValueError("a rank lies beyond its column's values")
        brackets = {c: _ALL for c in brackets if c not in held}
    return out


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """Exact medians (mean of the two middle values for an even count) of
    ``columns`` over ``df``; columns without values are absent."""
    got = order_statistics(df, columns, 0.5, lambda n: [(n - 1) // 2, n // 2])
    middle: dict[str, list[float]] = {}
    for (c, _), x in sorted(got.items()):
        middle.setdefault(c, []).append(x)
    return {c: (xs[0] + xs[-1]) / 2.0 for c, xs in middle.items()}
