"""Column transforms: fit → small statistics, apply → one projection.

Every ``fit_*`` runs one distributed job and returns per-column statistics
(one value per column: bounded by the schema, never by the data).  Every
``apply`` inlines those statistics as literals in a single ``select``, so the
same apply works on a batch or a stream and never joins the data to a
statistics row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import names as N
from ..functions.coerce import column_to_double, is_numeric_type, nan_to_null, qcol
from ..session import materialize
from . import quantiles as Q
from .prefix import running_sums

# ---------------------------------------------------------------------------
# TR1 / TR2 coercion
# ---------------------------------------------------------------------------


def coerce_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """TR1: every listed column becomes DOUBLE; cells that are not numbers
    become NULL.  Other columns pass through unchanged."""
    columns = list(df.columns) if columns is None else list(columns)
    wanted = set(columns)
    return df.select(*[column_to_double(df, c).alias(c) if c in wanted else qcol(c)
                       for c in df.columns])


def convertible_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """TR2 decision: numeric columns, plus text columns in which *every*
    non-null cell converts.  One aggregate over the table."""
    columns = list(df.columns) if columns is None else list(columns)
    out, text = [], []
    for c in columns:
        dt = df.schema[c].dataType
        if is_numeric_type(dt):
            out.append(c)
        elif isinstance(dt, T.StringType):
            text.append(c)
    if text:
        row = df.agg(*[
            F.count_if(qcol(c).isNotNull() & column_to_double(df, c).isNull()).alias(f"b{i}")
            for i, c in enumerate(text)]).collect()[0]
        out += [c for i, c in enumerate(text) if row[f"b{i}"] == 0]
    return [c for c in columns if c in set(out)]


def coerce_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """TR2: convert a column only when all its non-null cells convert."""
    conv = [c for c in convertible_columns(df, columns)
            if isinstance(df.schema[c].dataType, T.StringType)]
    return coerce_cells(df, conv) if conv else df


# ---------------------------------------------------------------------------
# TR3 / TR4 / TR16 value clean-up
# ---------------------------------------------------------------------------


def clip(c: Column, lo, hi, dtype: T.DataType = T.DoubleType()) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (bounds take the column's type)."""
    lo_c, hi_c = F.lit(lo).cast(dtype), F.lit(hi).cast(dtype)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo_c), hi_c))


def clip_ranges(df: DataFrame, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """TR3: clip each listed column to its range; others unchanged."""
    ranges = K.CLIP_RANGES if ranges is None else ranges
    return df.select(*[
        clip(qcol(c), *ranges[c], df.schema[c].dataType).alias(c) if c in ranges else qcol(c)
        for c in df.columns])


def clean_category(c: Column) -> Column:
    """TR4: text form of the value; missing (or the text 'nan') → 'Unknown'."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == "nan"), F.lit("Unknown")).otherwise(s)


def clean_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wanted = set(columns)
    return df.select(*[clean_category(qcol(c)).alias(c) if c in wanted else qcol(c)
                       for c in df.columns])


def round_half_even(c: Column, digits: int) -> Column:
    """TR16: NumPy-style rounding (half to even)."""
    return F.bround(c, digits)


# ---------------------------------------------------------------------------
# TR5-TR8 imputation statistics (exact, distributed)
# ---------------------------------------------------------------------------


def _long_values(df: DataFrame, columns: Sequence[str], as_text: bool) -> DataFrame:
    """(column, value) pairs for the listed columns, NULLs dropped."""
    vals = [qcol(c).cast("string") if as_text else column_to_double(df, c) for c in columns]
    items = [F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in zip(columns, vals)]
    return (df.select(F.explode(F.array(*items)).alias("kv"))
            .select("kv.*").where(F.col("value").isNotNull()))


def median_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians (the mean of the two middle values for an even count)
    as a (column, median) table, one row per column with values.

    A sketch brackets the middle and only values inside the bracket are shuffled
    and ranked (``quantiles.medians``), so no task ever holds a whole column.
    """
    meds = fit_medians(df, columns, missing=None)
    rows = [(c, meds[c]) for c in columns if meds.get(c) is not None]
    return df.sparkSession.createDataFrame(rows, "column string, median double")


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, smallest value on ties, as
    (column, mode, n).  All-NULL columns have no row."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, mode string, n bigint")
    counts = (_long_values(df, columns, as_text=True)
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = F.min_by(F.struct(F.col("value"), F.col("n")),
                    F.struct((-F.col("n")).alias("neg_n"), F.col("value")))
    return (counts.groupBy("column").agg(best.alias("b"))
            .select("column", F.col("b.value").alias("mode"), F.col("b.n").alias("n")))


def fit_medians(df: DataFrame, columns: Sequence[str], missing: float | None = 0.0
                ) -> dict[str, float | None]:
    """TR5/TR7 fit: column → exact median; an all-NULL column gets
    ``missing`` (0, as in the reference)."""
    if not columns:
        return {}
    got = Q.medians(df, {c: column_to_double(df, c) for c in columns})
    return {c: (got[c] if got.get(c) is not None else missing) for c in columns}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """TR6/TR8 fit: column → mode; a column without values gets 'Unknown'."""
    got = {r["column"]: r["mode"] for r in mode_table(df, columns).collect()}
    return {c: (got.get(c) if got.get(c) is not None else "Unknown") for c in columns}


def impute(df: DataFrame, medians: dict[str, float] | None = None,
           modes: dict[str, str] | None = None) -> DataFrame:
    """Apply frozen statistics: numeric NULLs (and NaN) → median, text
    NULLs → mode.  One projection; works on streams."""
    medians, modes = medians or {}, modes or {}
    out = []
    for c in df.columns:
        dt = df.schema[c].dataType
        if c in medians and isinstance(dt, (T.FloatType, T.DoubleType)):
            filled = F.coalesce(nan_to_null(qcol(c).cast("double")), F.lit(float(medians[c])))
            out.append(filled.cast(dt).alias(c))
        elif c in medians and is_numeric_type(dt):
            # always DOUBLE: the type must not follow this batch's median
            out.append(F.coalesce(qcol(c).cast("double"), F.lit(float(medians[c]))).alias(c))
        elif c in modes:
            out.append(F.coalesce(qcol(c).cast("string"), F.lit(modes[c])).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# TR9 scaling
# ---------------------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """TR9 fit: column → (mean, population std) in one aggregate."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = column_to_double(df, c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std, with a zero (or undefined) std replaced by 1."""
    out = []
    for c in df.columns:
        if c in stats:
            mean, std = stats[c]
            mean = 0.0 if mean is None else float(mean)
            std = 1.0 if not std else float(std)
            out.append(((column_to_double(df, c) - F.lit(mean)) / F.lit(std)).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# TR10 / TR11 label encoding
# ---------------------------------------------------------------------------


def fit_label_encoder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """TR10 fit: (column, value, code) with codes 0..k-1 in sorted order.

    Dense ranks over distinct values are running sums over ranges of the full
    text, so a column with many distinct values is never ranked in one task."""
    distinct = _long_values(df, columns, as_text=True).distinct().withColumn("one", F.lit(1))
    ranked = running_sums(distinct, ["column"], "value", ["one"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, encoder: DataFrame, columns: Sequence[str],
                 unseen: str = "null") -> DataFrame:
    """TR10/TR11 apply: replace each listed column by its code.

    ``unseen='null'`` leaves unknown values NULL; ``unseen='first'`` gives
    them code 0, the first class in sorted order.  The planner decides by the
    encoder's measured size whether to broadcast it."""
    out = df
    for c in columns:
        enc = (encoder.where(F.col("column") == c)
               .select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__code_{c}")))
        out = out.join(enc, qcol(c).cast("string") == F.col(f"__v_{c}"), "left")
        code = F.col(f"__code_{c}")
        if unseen == "first":
            code = F.coalesce(code, F.lit(0))
        out = out.withColumn(c, code).drop(f"__v_{c}", f"__code_{c}")
    return out


# ---------------------------------------------------------------------------
# PR6 target binarisation
# ---------------------------------------------------------------------------


def binarise_target(c: Column, dtype: T.DataType) -> Column:
    """PR6: 1 when lower(text) is one of returned/return/yes/true/1, else 0;
    missing → 0.  Text is not trimmed.  Numeric targets count 1 as positive
    (also 1.0, a documented deviation from text comparison)."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit(1)).otherwise(F.lit(0))
    if is_numeric_type(dtype):
        return F.when(c.cast("double") == 1.0, F.lit(1)).otherwise(F.lit(0))
    return F.when(F.lower(c.cast("string")).isin(*K.POSITIVE_TARGET_VALUES), F.lit(1)).otherwise(F.lit(0))


# ---------------------------------------------------------------------------
# TR14 standardise to the canonical schema
# ---------------------------------------------------------------------------


def standardise(df: DataFrame, keep: Sequence[str] = (), protect: Sequence[str] = (),
                drop_null_target: bool = False) -> tuple[DataFrame, dict[str, str], str | None]:
    """TR14: leakage drop → target → name mapping → defaults → coercion and
    clipping → category clean-up → binarised target, as one projection.

    Returns (frame, mapping canonical→source, target column name).  The frame
    has the 12 canonical features (numeric as DOUBLE), ``target`` (INT) when
    a target was found, and any ``keep`` columns first.  ``protect`` lists
    columns that must not be removed as leakage (the reference removes
    return_history_rate; protecting it keeps the feature).  A missing target
    counts as 0; with ``drop_null_target`` such rows go instead.
    """
    cols = list(df.columns)
    N.check_unambiguous(cols)
    leakage = [c for c in N.leakage_columns(cols, "substring") if c not in protect]
    target = N.find_target_exact(cols)
    if target and drop_null_target:
        df = df.where(qcol(target).isNotNull())
    dropped = set(leakage) | ({target} if target else set())
    remaining = [c for c in cols if c not in dropped]
    mapping = N.map_canonical(remaining)

    out = [qcol(c) for c in keep]
    for feat in K.CANONICAL_ALIASES:
        src = mapping.get(feat)
        if feat in K.CANONICAL_NUMERIC:
            x = column_to_double(df, src) if src else F.lit(float(K.CANONICAL_DEFAULTS[feat]))
            if feat in K.CLIP_RANGES:
                x = clip(x, *K.CLIP_RANGES[feat])
            out.append(x.alias(feat))
        else:
            x = clean_category(qcol(src)) if src else F.lit(K.CANONICAL_DEFAULTS[feat])
            out.append(x.alias(feat))
    if target:
        out.append(binarise_target(qcol(target), df.schema[target].dataType).alias("target"))
    return df.select(*out), mapping, target


# ---------------------------------------------------------------------------
# TR15 prepare for scoring
# ---------------------------------------------------------------------------


def cell_gaps(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """column → (missing cells, cells that are not numbers), one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        number = column_to_double(df, c)
        missing = number.isNull() if is_numeric_type(df.schema[c].dataType) else qcol(c).isNull()
        aggs += [F.count_if(missing).alias(f"m{i}"), F.count_if(~missing & number.isNull()).alias(f"f{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"m{i}"], row[f"f{i}"]) for i, c in enumerate(columns)}


def fit_fill_statistics(df: DataFrame, columns: Sequence[str], per_cell: bool = False, stored: bool = False
                        ) -> tuple[list[str], dict[str, float], dict[str, str]]:
    """Batch fill statistics: (numeric columns, medians of those with gaps,
    modes of the others with gaps).

    Numeric columns are the numeric types and the text columns whose every
    cell converts (TR2); with ``per_cell`` every column is coerced cell by
    cell (TR1) and non-numbers count as gaps.  One aggregate finds the gaps;
    only columns that have some are counted by value (a fill changes nothing
    elsewhere), so identifiers are never grouped.  The columns are stored once (unless
    ``df`` reads a ``stored`` table), so the plan behind ``df`` (joins, for example)
    runs once for all statistics."""
    if not columns:
        return [], {}, {}
    if not stored and not any(isinstance(df.schema[c].dataType, T.NullType) for c in columns):   # Parquet has no such type
        df = materialize(df.select(*[qcol(c) for c in columns]))
    gaps = cell_gaps(df, columns)
    if per_cell:
        numeric = list(columns)
    else:
        numeric = [c for c in columns if is_numeric_type(df.schema[c].dataType) or
                   (isinstance(df.schema[c].dataType, T.StringType) and gaps[c][1] == 0)]
    fill = [c for c in columns if gaps[c][0] or (per_cell and gaps[c][1])]
    medians = fit_medians(df, [c for c in fill if c in numeric])
    modes = fit_modes(df, [c for c in fill if c not in numeric])
    return numeric, medians, modes


def scoring_fills(df: DataFrame, leakage_mode: str = "substring",
                  only: Sequence[str] | None = None, stored: bool = False) -> tuple[dict[str, Column], list[str], list[str]]:
    """TR15 as expressions over ``df``: for every non-leakage column, the
    prepared value (numeric → DOUBLE with gaps at the batch median; other →
    text with gaps at the batch mode).

    Returns (column → Column, leakage columns dropped, numeric columns).  The
    fills are row-local, so callers can keep every input column alongside.
    ``only`` limits the work to the columns a caller will read; ``stored`` tells
    that ``df`` reads a stored table.
    """
    leakage = N.leakage_columns(df.columns, leakage_mode)
    remaining = [c for c in df.columns if c not in set(leakage)]
    if only is not None:
        remaining = [c for c in remaining if c in set(only)]
    numeric, medians, modes = fit_fill_statistics(df, remaining, stored=stored)
    fills: dict[str, Column] = {}
    for c in remaining:
        if c in medians:
            fills[c] = F.coalesce(column_to_double(df, c), F.lit(float(medians[c])))
        elif c in modes:
            fills[c] = F.coalesce(qcol(c).cast("string"), F.lit(modes[c]))
        elif c in numeric:
            fills[c] = column_to_double(df, c)
        else:
            fills[c] = qcol(c).cast("string")
    return fills, leakage, numeric


def prepare_for_scoring(df: DataFrame, leakage_mode: str = "substring"
                        ) -> tuple[DataFrame, list[str]]:
    """TR15: drop leakage columns, convert fully-numeric text columns, then
    fill numeric NULLs with the batch median and the rest with the batch
    mode.  Returns (prepared frame, dropped leakage columns)."""
    fills, leakage, _ = scoring_fills(df, leakage_mode)
    return df.select(*[e.alias(c) for c, e in fills.items()]), leakage
