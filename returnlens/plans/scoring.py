"""Score a whole table (SC14): prepare → score → decide → label → band.

Every rule scorer is one projection over the input (the imputing ones add
one small statistics job first).  The output is the input with the four
result columns replaced (PR12): Prediction, Return_Probability,
Prediction_Label, Confidence_Level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import decide as D
from ..functions import names as N
from ..functions import rules as R
from ..functions.coerce import column_to_double, qcol, text_to_double
from ..operators import transforms as TR
from ..operators.evaluate import metrics_from_confusion
from ..operators.merging import score_metrics
from ..operators.projections import replace_result_columns, scoring_columns
from ..session import materialize


def decorate(df: DataFrame, p: Column, bands: str = "six", threshold: float | None = K.DECISION_CUTOFF,
             inclusive: bool = False) -> DataFrame:
    """Append the four result columns computed from probability ``p``
    (existing result columns are dropped first, PR12)."""
    base = replace_result_columns(df)
    prob = F.col("Return_Probability")
    dec = D.decision(prob, threshold, inclusive)
    if bands == "six":
        conf = D.confidence6(prob)
    elif bands == "seven":
        conf = D.confidence7(prob)
    elif bands == "distance":
        conf = D.confidence_by_distance(prob, K.DECISION_CUTOFF if threshold is None else threshold)
    else:
        raise ValueError(bands)
    # Two projections; Catalyst collapses them into one.
    with_p = base.select("*", p.alias("Return_Probability"))
    return with_p.select(
        *[qcol(c) for c in base.columns],
        dec.alias("Prediction"),
        prob,
        D.label(dec).alias("Prediction_Label"),
        conf.alias("Confidence_Level"),
    )


def _inputs(df: DataFrame):
    return [c for c in df.columns if c not in K.RESULT_COLUMNS]


def plain_probability(df: DataFrame) -> Column:
    """SC1 probability: plain rules over every column, no imputation."""
    cols = [(c, column_to_double(df, c)) for c in _inputs(df) if N.plain_family(c) is not None]
    return R.clamp(R.plain_rule_score(cols))


def score_plain(df: DataFrame) -> DataFrame:
    """SC1 (+SC5, SC7, SC8)."""
    return decorate(df, plain_probability(df), "six")


def quick_probability(df: DataFrame, numeric_fallback: bool = True) -> Column:
    """SC2 probability: scoring columns (PR10) with NULLs at the batch
    median (TR5), then the plain rules over those columns."""
    base = df.select(*[qcol(c) for c in _inputs(df)])
    chosen = scoring_columns(base, numeric_fallback=numeric_fallback)
    # a median only fills gaps: complete columns need none (one profile pass)
    scored = [c for c in chosen if N.plain_family(c) is not None]
    _, medians, _ = TR.fit_fill_statistics(base, scored, per_cell=True)
    filled = [(c, F.coalesce(column_to_double(base, c), F.lit(float(medians[c])))
               if c in medians else column_to_double(base, c)) for c in chosen]
    return R.clamp(R.plain_rule_score(filled))


def score_quick(df: DataFrame, numeric_fallback: bool = True) -> DataFrame:
    """SC2 (+SC5, SC7, SC8)."""
    return decorate(df, quick_probability(df, numeric_fallback), "six")


def production_columns(columns: Sequence[str]) -> list[str]:
    """The columns that some rule family of SC3 reads."""
    leak = set(N.leakage_columns(columns, "substring"))
    return [c for c in columns if c not in leak
            and any(N.contains_any(c, words) for words, _ in K.PRODUCTION_RULES)]


def production_probability(df: DataFrame, stored: bool = False) -> Column:
    """SC3 probability: batch preparation (TR15: leakage drop, column
    coercion, median/mode fill), then the four rule families over the
    prepared columns; text values coerce per cell and mostly add nothing."""
    base = df.select(*[qcol(c) for c in _inputs(df)])
    # Only columns some rule family reads matter (the output keeps the
    # original columns), and of those only the ones with missing cells need
    # batch statistics: a fill changes nothing in a complete column, and
    # per-cell coercion of complete text equals converting the column.
    used = production_columns(base.columns)
    fills, _, numeric = TR.scoring_fills(base, only=used, stored=stored)
    cols = [(c, fills[c] if c in numeric else text_to_double(fills[c])) for c in used]
    return R.clamp(R.production_rule_score(cols))


def score_production(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """SC3 (+SC5, SC7, SC9) over the input; every input column is kept.

    With ``keep``, of the input only these columns and those that the rules read;
    they are stored once, so the plan behind ``df`` (joins, for example) runs
    once for the batch statistics and the scores."""
    if keep is not None:
        wanted = {*keep, *production_columns(_inputs(df))}
        df = materialize(df.select(*[qcol(c) for c in df.columns if c in wanted]))
    return decorate(df, production_probability(df, stored=keep is not None), "seven")


def score_with_probability(df: DataFrame, p: Column, threshold: float | None,
                           bands: str = "distance") -> DataFrame:
    """SC6 (+SC7, SC10) for a model probability and a tuned threshold."""
    return decorate(df, p, bands, threshold, inclusive=True)


def score_with_model(df: DataFrame, model) -> DataFrame:
    """SC13, then SC6, SC7 and SC10 at the model's threshold, with PR12: the
    table with a fitted model's result columns."""
    return decorate(model.score(df, "__p"), F.col("__p"), "distance", model.threshold, inclusive=True).drop("__p")


def model_report(df: DataFrame, model, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A fitted model over a whole table: the results (``score_with_model``), stored,
    and one row on them: model kind and threshold, AG6, AG7 and AG2, the leakage
    columns left out, and with a ``target`` of 0 and 1 the confusion matrix and
    its metrics (AG8, AG9, AG21).  The report is one aggregate."""
    results = materialize(score_with_model(df, model))
    d, cells = F.col("Prediction"), {}
    if target is not None:
        hit = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
        cells = {k: F.count_if((qcol(target) == y) & (d == p)) for k, (y, p) in hit.items()}
        cells["actual_rate"] = F.round(F.avg(qcol(target).cast("double")), 6)
    metrics = score_metrics(F.col("Return_Probability"), d, [c for c in df.columns if c not in K.RESULT_COLUMNS])
    row = results.agg(F.lit(model.kind).alias("kind"), F.lit(model.threshold).cast("double").alias("threshold"),
                      F.lit(len(N.leakage_columns(df.columns, "substring"))).alias("leakage_columns"),
                      *[c.alias(k) for k, c in (metrics | cells).items()])
    extra = ("kind", "threshold", "leakage_columns", *metrics, *(["actual_rate"] if target is not None else []))
    return results, (metrics_from_confusion(row, extra) if target is not None else row)
