"""Profiling and validation (AG1-AG5, AG20, FI3, FI4).

Each check is one aggregate over the table; the long report is that one
aggregate row unpivoted, plus the name-level findings, as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import names as N
from ..functions.coerce import column_to_double, qcol
from .distinct import sketchable, sketched_counts
from .projections import feature_types


def _is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column (pandas counts both as missing)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return qcol(c).isNull() | F.isnan(qcol(c))
    return qcol(c).isNull()


def table_counts(df: DataFrame) -> DataFrame:
    """AG1: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"))


def missing_counts(df: DataFrame, total: bool = False) -> DataFrame:
    """AG2 per column: (column, missing), from one aggregate; with ``total``
    also the whole table's under the name '*'."""
    row = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
             for i, c in enumerate(df.columns)]
    if total:
        pairs.append(F.struct(F.lit("*").alias("column"), _total(df).alias("missing")))
    return row.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")


def _total(df: DataFrame) -> Column:
    return sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))


def missing_total(df: DataFrame) -> DataFrame:
    """AG2: missing cells over the whole table."""
    row = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return row.select(_total(df).alias("missing_values"))


def _quality_checks(df: DataFrame, include_amount: bool) -> list[tuple[str, str, Column]]:
    words = ["price", "cost"] + (["amount"] if include_amount else [])
    checks = [("negative_values", c, column_to_double(df, c) < 0) for c in df.columns if N.contains_any(c, words)]
    for c in df.columns:
        if N.contains_any(c, ["age"]):
            x = column_to_double(df, c)
            checks.append(("unreasonable_age", c, (x < K.AGE_VALID_RANGE[0]) | (x > K.AGE_VALID_RANGE[1])))
    return checks


def quality_issues(df: DataFrame, include_amount: bool = False) -> DataFrame:
    """AG3 + AG4: negatives in price/cost (and amount) columns; ages below 0
    or above 120 in age columns.  (check, column, n) for every checked
    column, from one aggregate."""
    checks = _quality_checks(df, include_amount)
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, column string, n bigint")
    row = df.agg(*[F.count_if(cond).alias(f"q{i}") for i, (_, _, cond) in enumerate(checks)])
    pairs = [F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(f"q{i}").alias("n"))
             for i, (k, c, _) in enumerate(checks)]
    return row.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")


def is_empty(df: DataFrame) -> DataFrame:
    """FI3 as a one-row frame: is_empty, is_valid (looks for one row only)."""
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(
        (F.col("n") == 0).alias("is_empty"), (F.col("n") > 0).alias("is_valid"))


def validation_report(df: DataFrame, limit: int = K.TYPE_LIMIT_FLEXIBLE,
                      leakage_mode: str = "substring", target_mode: str = "exact") -> DataFrame:
    """AG5: a long (check, column, value, severity) report.

    Data-level numbers (rows, missing cells, quality issues) come from one
    aggregate; name-level findings (leakage, target, feature types) from
    the schema and PR13.  An empty table reports only the error.  The
    "ultra" variant is ``limit=20, leakage_mode='keyword',
    target_mode='keyword'`` (its negatives check also covers 'amount').
    """
    spark = df.sparkSession
    schema = "check string, column string, value string, severity string"
    checks = _quality_checks(df, include_amount=(leakage_mode == "keyword"))
    missing = [F.count_if(_is_missing(df, c)) for c in df.columns]
    got = df.agg(F.count(F.lit(1)).alias("n"), sum(missing, F.lit(0).cast("bigint")).alias("missing"),
                 *[F.count_if(cond).alias(f"q{i}") for i, (_, _, cond) in enumerate(checks)]).collect()[0]
    if got["n"] == 0:
        return spark.createDataFrame([("empty", None, "Dataset is empty", "error")], schema)
    rows: list[tuple] = [("rows", None, str(got["n"]), "info"), ("columns", None, str(len(df.columns)), "info"),
                         ("missing_values", None, str(got["missing"]), "warning" if got["missing"] else "info")]
    for c in N.leakage_columns(df.columns, leakage_mode):
        rows.append(("leakage_column", c, "removed before scoring", "warning"))
    target = (N.find_target_keyword(df.columns) if target_mode == "keyword"
              else N.find_target_exact(df.columns))
    if target:
        rows.append(("target_column", target, "compared with predictions", "warning"))
    rows += [(kind, c, str(got[f"q{i}"]), "warning") for i, (kind, c, _) in enumerate(checks) if got[f"q{i}"]]
    numeric, categorical = feature_types(df, limit, leakage_mode)
    rows.append(("numeric_features", None, str(len(numeric)), "info"))
    rows.append(("categorical_features", None, str(len(categorical)), "info"))
    if len(numeric) + len(categorical) < 2:
        rows.append(("few_features", None, str(len(numeric) + len(categorical)), "warning"))
    return spark.createDataFrame(rows, schema)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """AG20: distinct non-null values per column as (column, n_distinct).

    One aggregate counts all columns of few values (``distinct``); the others are
    unpivoted and de-duplicated on (column, value), so one column's values spread
    over all tasks.  ``approx`` uses HyperLogLog++."""
    columns = list(df.columns) if columns is None else list(columns)
    if approx:
        row = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(columns)])
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                 for i, c in enumerate(columns)]
        return row.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")
    few, _ = sketched_counts(df, {c: sketchable(qcol(c), df.schema[c].dataType) for c in columns})
    known = df.sparkSession.createDataFrame([(c, n) for c, n in few.items() if n], "column string, n_distinct bigint")
    items = [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in columns if few[c] is None]
    if not items:
        return known
    long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")
    return known.unionAll(long.where(F.col("value").isNotNull()).distinct()
                          .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def row_errors(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """FI4: an ``errors`` array per row with the messages of every failed
    check.  ``names`` maps the checked features (Product_Price, Customer_Age,
    Product_Rating, Delivery_Time, Return_History_Rate) to columns; an absent
    feature counts as 0, a NULL value fails nothing."""
    names = names or {}
    msgs = []
    for feat, lo, hi, message in K.ROW_CHECKS:
        col = names.get(feat, feat if feat in df.columns else None)
        x = column_to_double(df, col) if col else F.lit(0.0)
        bad = None
        if lo is not None:
            bad = (x <= lo) if feat in K.ROW_CHECK_EXCLUSIVE_FLOOR else (x < lo)
        if hi is not None:
            bad = (x > hi) if bad is None else (bad | (x > hi))
        msgs.append(F.when(bad, F.lit(message)))
    errors = F.array_compact(F.array(*msgs))
    return df.select("*", errors.alias("errors"))
