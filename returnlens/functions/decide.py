"""Decisions, labels, confidence and risk bands (SC5-SC12) as Columns.

A missing probability compares as false everywhere: it is no return and falls
into the last band of each ladder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _d(x: float) -> Column:
    return F.lit(float(x))


def decision(p: Column, threshold: float = K.DECISION_CUTOFF, inclusive: bool = False) -> Column:
    """SC5 (``p > t``, rules) or SC6 (``p >= t``, tuned models) as INT 0/1.
    A NULL threshold (no useful cut, T15) makes every row negative."""
    if threshold is None:
        return F.lit(0)
    cond = p >= _d(threshold) if inclusive else p > _d(threshold)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def label(decision_col: Column) -> Column:
    """SC7: 0 → 'Not Return', 1 → 'Return'."""
    return F.when(decision_col == 1, F.lit(K.LABELS[1])).when(decision_col == 0, F.lit(K.LABELS[0]))


def _ladder(p: Column, ladder) -> Column:
    expr = None
    fallback = None
    for bound, band in ladder:
        if bound is None:
            fallback = band
            continue
        cond = p > _d(bound)
        expr = F.when(cond, F.lit(band)) if expr is None else expr.when(cond, F.lit(band))
    return expr.otherwise(F.lit(fallback))


def confidence6(p: Column) -> Column:
    """SC8: six bands on the probability."""
    return _ladder(p, K.CONFIDENCE_6)


def confidence7(p: Column) -> Column:
    """SC9: seven bands on the probability."""
    return _ladder(p, K.CONFIDENCE_7)


def confidence_by_distance(p: Column, threshold: float, inverted: bool = True) -> Column:
    """SC10: bands on |p - t|.  The original ladder calls the rows *closest*
    to the threshold 'Very High' (``inverted=True``, the default, keeps that);
    ``inverted=False`` reverses the ladder so far-from-threshold is confident."""
    d = F.abs(p - _d(threshold))
    bands = [band for _, band in K.CONFIDENCE_DISTANCE]
    if not inverted:
        bands = bands[::-1]
    expr = None
    for (bound, _), band in zip(K.CONFIDENCE_DISTANCE, bands):
        if bound is None:
            return expr.otherwise(F.lit(band))
        cond = d < _d(bound)
        expr = F.when(cond, F.lit(band)) if expr is None else expr.when(cond, F.lit(band))
    return expr  # pragma: no cover


def confidence2(p: Column) -> Column:
    """SC11: 'High' when p > 0.7 or p < 0.3, else 'Medium'."""
    lo, hi = K.CONFIDENCE_2
    return F.when((p > _d(hi)) | (p < _d(lo)), F.lit("High")).otherwise(F.lit("Medium"))


def risk_band(p: Column) -> Column:
    """SC12: High > 0.7, Medium (0.3, 0.7], else Low."""
    return (F.when(p > _d(K.RISK_HIGH), F.lit("High"))
            .when(p > _d(K.RISK_LOW), F.lit("Medium"))
            .otherwise(F.lit("Low")))
