"""Schema-driven projections (PR1-PR13).

The name rules live in ``functions.names``; here they become DataFrame →
DataFrame projections.  Only ``scoring_columns`` (its numeric fallback) and
``detect_types`` look at data, each with one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import names as N
from ..functions.coerce import column_to_double, qcol, is_numeric_type
from .distinct import EXACT, sketchable, sketched_counts


def drop_identifiers(df: DataFrame) -> DataFrame:
    """PR1: drop Order_ID and Customer_ID when present."""
    present = [c for c in K.ID_COLUMNS if c in df.columns]
    return df.drop(*present) if present else df


def drop_leakage(df: DataFrame, mode: str = "substring", protect: Sequence[str] = ()) -> DataFrame:
    """PR2 (``substring``) / PR3 (``keyword``): drop columns whose name marks
    them as outcome leakage."""
    drop = [c for c in N.leakage_columns(df.columns, mode) if c not in set(protect)]
    return df.drop(*drop) if drop else df


def target_column(df: DataFrame, mode: str = "exact") -> str | None:
    """PR4 (``exact``), its 4-name variant (``short``), or PR5 (``keyword``,
    with exclusions; ``keyword_loose`` without)."""
    if mode == "exact":
        return N.find_target_exact(df.columns)
    if mode == "short":
        return N.find_target_exact(df.columns, K.TARGET_NAMES_SHORT, strip=False)
    if mode == "keyword":
        return N.find_target_keyword(df.columns, with_exclusions=True)
    if mode == "keyword_loose":
        return N.find_target_keyword(df.columns, with_exclusions=False)
    raise ValueError(mode)


def to_canonical(df: DataFrame) -> DataFrame:
    """PR7 + PR8: rename mapped source columns to canonical names and add
    literal defaults for the canonical features nothing maps to."""
    mapping = N.map_canonical(df.columns)
    out = []
    for feat in K.CANONICAL_ALIASES:
        if feat in mapping:
            out.append(qcol(mapping[feat]).alias(feat))
        else:
            out.append(F.lit(K.CANONICAL_DEFAULTS[feat]).alias(feat))
    return df.select(*out)


def select_relevant(df: DataFrame, limit: int | None = None, word_match: bool = False) -> DataFrame:
    """PR9: columns whose name has a relevant word (price, cost, amount, age,
    rating, score, time, day)."""
    return df.select(*[qcol(c) for c in N.relevant_columns(df.columns, limit, word_match)])


def scoring_columns(df: DataFrame, numeric_fallback: bool = True) -> list[str]:
    """PR10: relevant-word columns; with fewer than two, add the first
    columns holding any numeric value (up to four in all); with still fewer
    than two, the first four columns.  Never lists a column twice."""
    chosen = N.relevant_columns(df.columns)
    if len(chosen) < 2 and numeric_fallback:
        row = df.agg(*[F.count(column_to_double(df, c)).alias(f"n{i}")
                       for i, c in enumerate(df.columns)]).collect()[0]
        for i, c in enumerate(df.columns):
            if len(chosen) >= 4:
                break
            if row[f"n{i}"] > 0 and c not in chosen:
                chosen.append(c)
    if len(chosen) < 2:
        chosen = list(df.columns)[:4]
    return chosen


def display_columns(df: DataFrame, n_inputs: int = 10) -> DataFrame:
    """PR11: the first ``n_inputs`` input columns plus the result columns,
    each name once."""
    inputs = [c for c in df.columns if c not in K.RESULT_COLUMNS][:n_inputs]
    results = [c for c in K.RESULT_COLUMNS if c in df.columns]
    return df.select(*[qcol(c) for c in dict.fromkeys(inputs + results)])


def replace_result_columns(df: DataFrame) -> DataFrame:
    """PR12 (first half): drop stale result columns before new ones are added."""
    stale = [c for c in K.RESULT_COLUMNS if c in df.columns]
    return df.drop(*stale) if stale else df


def detect_types(df: DataFrame, limit: int = K.TYPE_LIMIT_FLEXIBLE,
                 leakage_mode: str = "substring") -> DataFrame:
    """PR13 (see ``type_stats``): (column, n_numeric, n_distinct, kind,
    position) for one cardinality limit."""
    return with_kind(type_stats(df, leakage_mode), limit)


def with_kind(stats: DataFrame, limit, *more: str) -> DataFrame:
    """Classify ``type_stats`` rows under a cardinality limit (a number or a
    column); ``more`` columns are carried along."""
    kind = F.when((F.col("n_numeric") > 0) & (F.col("n_distinct") <= limit), F.lit("numeric")) \
        .otherwise(F.lit("categorical"))
    return stats.select("column", "n_numeric", "n_distinct", kind.alias("kind"), "position", *more)


def _features(df: DataFrame, leakage_mode: str) -> list[str]:
    """Columns that are neither leakage nor the target."""
    leak, target = set(N.leakage_columns(df.columns, leakage_mode)), N.find_target_exact(list(df.columns))
    return [c for c in df.columns if c not in leak and c != target]


def _few(df: DataFrame, feats: Sequence[str]) -> tuple[dict[str, int | None], dict[str, int]]:
    """Distinct values of each feature (None: more than a sketch holds) and cells
    that convert to a number, one aggregate.  Numeric columns are keyed by the
    number."""
    numbers = {c: column_to_double(df, c) for c in feats}
    keys = {c: sketchable(numbers[c], T.DoubleType()) if is_numeric_type(df.schema[c].dataType) else qcol(c).cast("string") for c in feats}
    few, more = sketched_counts(df, keys, **{f"n{i}": F.count(numbers[c]) for i, c in enumerate(feats)})
    return few, {c: more[f"n{i}"] for i, c in enumerate(feats)}


def type_stats(df: DataFrame, leakage_mode: str = "substring") -> DataFrame:
    """PR13 statistics per feature column: cells that convert to a number
    and distinct values (a column is 'numeric' when some value converts and
    it has at most ``limit`` distinct values, see ``with_kind``).

    Leakage columns and the target are left out first.  One aggregate counts all
    columns of few values exactly (``distinct``); only the others are unpivoted to
    (column, text, number), and their distinct counting shuffles on (column,
    value), so one wide column never sits in one task.  Numeric columns are keyed
    by the number itself: no per-cell number-to-text formatting, and -0.0 equals
    0.0 as in pandas.  Returns (column, n_numeric, n_distinct, position).
    """
    schema = "column string, n_numeric bigint, n_distinct bigint, position int"
    feats = _features(df, leakage_mode)
    if not feats:
        return df.sparkSession.createDataFrame([], schema)
    few, numeric = _few(df, feats)
    items = []
    for c in (c for c in feats if few[c] is None):
        is_number = is_numeric_type(df.schema[c].dataType)
        items.append(F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("text") if is_number else qcol(c).cast("string").alias("text"),
                              (column_to_double(df, c) if is_number else F.lit(None).cast("double")).alias("num")))
    if items:
        long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").where("text IS NOT NULL OR num IS NOT NULL").distinct()
        few |= {r["column"]: r["count"] for r in long.groupBy("column").count().collect()}      # one row per column
    return df.sparkSession.createDataFrame([(c, numeric[c], few[c], i) for i, c in enumerate(feats)], schema)


def feature_types(df: DataFrame, limit: int = K.TYPE_LIMIT_FLEXIBLE,
                  leakage_mode: str = "substring") -> tuple[list[str], list[str]]:
    """PR13 as two name lists (numeric, categorical), in column order.  Up to a
    limit of ``distinct.EXACT`` one aggregate is all: columns with more values are
    never counted."""
    if limit > EXACT:
        rows = {r["column"]: r["kind"] for r in detect_types(df, limit, leakage_mode).collect()}
        kinds = {c: rows[c] for c in _features(df, leakage_mode)}
    else:
        feats = _features(df, leakage_mode)
        few, numeric = _few(df, feats) if feats else ({}, {})
        kinds = {c: "numeric" if numeric[c] and few[c] is not None and few[c] <= limit else "categorical" for c in feats}
    return [c for c, k in kinds.items() if k == "numeric"], [c for c, k in kinds.items() if k == "categorical"]
