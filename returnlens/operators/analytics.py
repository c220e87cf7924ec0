"""Result analytics: group rates, top-k, histograms, filters (AG13, AG15-AG19,
FI1, FI2, SO1, SO2).

Group-bys aggregate partially on every task before the shuffle, so a key
holding a third of the rows costs one partial row per task.  Top-k uses
``orderBy(...).limit(k)``, which Spark plans as a per-task top-k followed by
a merge of k rows per task (TakeOrderedAndProject) — no full sort.  Every
top-k has a total order (a tie key), so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import decide as D
from ..functions.coerce import column_to_double, qcol
from ..session import materialize


def _c(x) -> Column:
    return qcol(x) if isinstance(x, str) else x


def class_counts(df: DataFrame, label="actual") -> DataFrame:
    """AG13: rows per class and the class share (normalised frequency)."""
    counts = materialize(df.groupBy(_c(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("__total"))     # one row
    return counts.join(total).select("label", "n", F.round(F.col("n") / F.col("__total"), 6).alias("share"))


def target_rate(df: DataFrame, label="actual") -> DataFrame:
    """AG13: mean of a 0/1 target."""
    return df.agg(F.round(F.avg(_c(label).cast("double")), 6).alias("target_rate"),
                  F.count(F.lit(1)).alias("rows"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """AG15: the ``k`` most frequent values (ties: smaller value first)."""
    return (df.groupBy(_c(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k))


def group_mean_top(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """AG16 + SO1 + SO2: mean of ``value`` per ``key``, highest first
    (ties: smaller key first), first ``k``."""
    return (df.groupBy(_c(key).alias("key"))
            .agg(F.round(F.avg(_c(value).cast("double")), 6).alias("mean"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("mean").desc(), F.col("key").asc_nulls_last()).limit(k))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """AG17: equal-width histogram between the column's min and max
    (the max falls in the last bin).  (bin, lower, upper, n) for non-empty
    bins.  Bounds come from one aggregate (two numbers)."""
    return histograms(df, [(column, column, bins)]).drop("variable")


def histograms(df: DataFrame, specs: Sequence[tuple[str, str, int]]) -> DataFrame:
    """AG17 for several columns at once: ``specs`` lists (variable, column,
    bins).  The columns are stored once, so the plan behind ``df`` runs once.
    One aggregate finds every column's bounds (two numbers each),
    then one pass bins each row once per column (an array of structs,
    exploded) and counts per (variable, bin): (variable, bin, lower, upper,
    n) for non-empty bins.  Missing values have no bin; they are counted out
    in the aggregate rather than filtered per row, so no filter on the
    computed bin is pushed into the input's joins."""
    df = materialize(df.select(*[column_to_double(df, col).alias(f"x{i}") for i, (_, col, _) in enumerate(specs)]))
    xs = [F.col(f"x{i}") for i in range(len(specs))]
    r = df.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)],
               *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]).collect()[0]
    items, lows, widths = [], {}, {}
    for i, ((var, _, bins), x) in enumerate(zip(specs, xs)):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None:
            continue
        span = hi - lo
        if span == 0:
            b = F.when(x.isNotNull(), F.lit(0))
        else:
            # least() skips NULLs, so guard: a missing value has no bin
            b = F.when(x.isNotNull(), F.least(
                F.floor((x - F.lit(lo)) / F.lit(span) * F.lit(float(bins))).cast("int"), F.lit(bins - 1)))
        items.append(F.struct(F.lit(var).alias("variable"), b.alias("bin")))
        lows[var], widths[var] = lo, (span / bins if span else 0.0)
    if not items:
        return df.sparkSession.createDataFrame(
            [], "variable string, bin int, lower double, upper double, n bigint")

    def per_variable(values: dict[str, float]) -> Column:
        expr = None
        for var, v in values.items():
            cond = F.col("variable") == F.lit(var)
            expr = F.when(cond, F.lit(float(v))) if expr is None else expr.when(cond, F.lit(float(v)))
        return expr

    lo_c, width_c = per_variable(lows), per_variable(widths)
    return (df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")
            .groupBy("variable", "bin").agg(F.count("bin").alias("n"))
            .where(F.col("n") > 0)
            .select("variable", "bin",
                    F.round(lo_c + F.col("bin") * width_c, 6).alias("lower"),
                    F.round(lo_c + (F.col("bin") + 1) * width_c, 6).alias("upper"),
                    "n"))


def risk_distribution(df: DataFrame, p="Return_Probability") -> DataFrame:
    """AG18: rows per risk band (SC12)."""
    return (df.select(D.risk_band(_c(p)).alias("risk_band"))
            .groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")))


def dataset_summary(df: DataFrame, target: str, price: str, rating: str, delivery: str) -> DataFrame:
    """AG19: rows, return rate, mean price / rating / delivery time."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg(_c(target).cast("double")), 6).alias("return_rate"),
        F.round(F.avg(column_to_double(df, price)), 6).alias("avg_price"),
        F.round(F.avg(column_to_double(df, rating)), 6).alias("avg_rating"),
        F.round(F.avg(column_to_double(df, delivery)), 6).alias("avg_delivery_time"))


def filter_results(df: DataFrame, min_probability: float = 0.0, prediction: str = "All") -> DataFrame:
    """FI1 + FI2: keep rows with Return_Probability >= t and, unless 'All',
    only predicted returns ('Return') or non-returns ('Not Return').

    The score passes through a one-element ``explode``: a filter on it stays
    above, instead of moving into the scoring joins' conditions, where the whole
    score would be worked out a second time for each joined row."""
    columns = df.columns
    df = df.withColumn("Return_Probability", F.explode(F.array("Return_Probability"))).select(*[qcol(c) for c in columns])
    out = df.where(F.col("Return_Probability") >= F.lit(float(min_probability)))
    if prediction == "Return":
        out = out.where(F.col("Prediction") == 1)
    elif prediction == "Not Return":
        out = out.where(F.col("Prediction") == 0)
    elif prediction != "All":
        raise ValueError(prediction)
    return out


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """SO2: first ``n`` rows by an explicit order (Spark has no input order)."""
    if not order:
        raise ValueError("an order key is required")
    return df.orderBy(*order).limit(n)


def bands_table(df: DataFrame, p="Return_Probability", threshold: float = K.DECISION_CUTOFF) -> DataFrame:
    """SC7-SC12 side by side: every band of every ladder for each row."""
    prob = _c(p)
    dec = D.decision(prob, K.DECISION_CUTOFF)
    return df.select(
        "*",
        D.label(dec).alias("label"),
        D.confidence6(prob).alias("confidence6"),
        D.confidence7(prob).alias("confidence7"),
        D.confidence_by_distance(prob, threshold).alias("confidence_distance"),
        D.confidence2(prob).alias("confidence2"),
        D.risk_band(prob).alias("risk_band"))
