"""Rule scores and propensity formulas as single Column expressions.

Every score is a left fold of DOUBLE additions in a fixed order, so the
result is bit-identical to adding the same deltas one after another (0.3 +
0.2 is exactly 0.5, 0.3 - 0.1 is 0.19999999999999998).  Catalyst does not
reassociate floating-point additions, so the order written here is the order
executed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .names import contains_any, plain_family


def _d(x: float) -> Column:
    return F.lit(float(x))


def clamp(p: Column, lo: float = K.PROBABILITY_FLOOR, hi: float = K.PROBABILITY_CEILING) -> Column:
    """max(lo, min(hi, p)); a NULL score stays NULL (``least``/``greatest``
    would otherwise skip it and return a bound)."""
    return F.when(p.isNotNull(), F.greatest(_d(lo), F.least(_d(hi), p)))


def _delta(v: Column, conditions) -> Column:
    """CASE over one family's conditions; 0.0 when none fires or ``v`` is NULL."""
    expr = None
    for op, bound, delta in conditions:
        if op == ">":
            cond = v > _d(bound)
        elif op == "<":
            cond = v < _d(bound)
        elif op == "outside":
            lo, hi = bound
            cond = (v < _d(lo)) | (v > _d(hi))
        else:  # pragma: no cover - constants are fixed
            raise ValueError(op)
        expr = F.when(cond, _d(delta)) if expr is None else expr.when(cond, _d(delta))
    return expr.otherwise(_d(0.0))


def plain_rule_score(columns: Sequence[tuple[str, Column]]) -> Column:
    """SC1/SC2 raw score: base 0.3; each column, in the given order, adds the
    delta of the first family its name matches (price/cost, then age, then
    rating/score).  ``columns`` pairs a name with its DOUBLE value."""
    p = _d(K.RULE_BASE)
    for name, value in columns:
        fam = plain_family(name)
        if fam is None:
            continue
        p = p + _delta(value, K.PLAIN_RULES[fam][1])
    return p


def production_rule_score(columns: Sequence[tuple[str, Column]]) -> Column:
    """SC3 raw score: base 0.3; all price/cost columns, then all rating
    columns, then discount, then delivery/shipping, each adding its delta.
    One column may take part in several families."""
    p = _d(K.RULE_BASE)
    for words, conditions in K.PRODUCTION_RULES:
        for name, value in columns:
            if contains_any(name, words):
                p = p + _delta(value, conditions)
    return p


def propensity(variant: str, features: dict[str, Column]) -> Column:
    """SC4: fixed linear return propensity (unclamped).

    ``features`` maps the formula's feature names (price, category, delivery,
    rating, return_rate, discount, quantity, age) to Columns.  A NULL numeric
    feature makes the score NULL, as NaN does in the original arithmetic.
    """
    base, terms = K.PROPENSITY_FORMULAS[variant]
    p = _d(base)
    for kind, feature, param, weight in terms:
        x = features[feature]
        if kind == "ratio":
            t = x / _d(param) * _d(weight)
        elif kind == "invert":
            t = (_d(param) - x) / _d(4) * _d(weight)
        elif kind == "linear":
            t = x * _d(weight)
        elif kind == "member":
            t = F.when(x.isin(*param), _d(1.0)).otherwise(_d(0.0)) * _d(weight)
        elif kind == "greater":  # a comparison with a missing value is false
            t = F.when(x > _d(param), _d(1.0)).otherwise(_d(0.0)) * _d(weight)
        elif kind == "less":
            t = F.when(x < _d(param), _d(1.0)).otherwise(_d(0.0)) * _d(weight)
        else:  # pragma: no cover
            raise ValueError(kind)
        p = p + t
    return p
