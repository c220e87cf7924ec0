"""The best threshold by branch and bound against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from returnlens.operators import evaluate as EV


def brute(pairs):
    """(J x P x N, threshold, tps, fps): the best cut, the highest on ties."""
    known = [(s, y == 1) for s, y in pairs if s is not None]
    key = lambda s: (math.isnan(s), 0.0 if math.isnan(s) else s)                     # NaN is the highest
    P, N = sum(y for _, y in known), sum(not y for _, y in known)
    best, tps, fps = (0, None, 0, 0), 0, 0
    known.sort(key=lambda r: key(r[0]), reverse=True)
    for i, (s, y) in enumerate(known):
        tps, fps = tps + y, fps + (not y)
        if i + 1 == len(known) or key(known[i + 1][0]) != key(s):
            best = max(best, (tps * N - fps * P, s, tps, fps), key=lambda b: b[0])
    return *best[1:], P, N


def signal(rnd):
    y = int(rnd.random() < 0.4)
    return rnd.gauss(0.3 * y, 1), y


CASES = {
    "signal": signal,
    "noise": lambda rnd: (rnd.random(), rnd.randint(0, 1)),
    "reversed": lambda rnd: (lambda s: (s, int(rnd.random() > s)))(rnd.random()),
    "ties": lambda rnd: (float(rnd.randint(0, 6)), rnd.randint(0, 1)),
    "hot": lambda rnd: (0.5 if rnd.random() < 0.34 else rnd.random(), rnd.randint(0, 1)),
    "wide": lambda rnd: (math.copysign(10 ** rnd.uniform(-300, 308), rnd.random() - 0.4), rnd.randint(0, 1)),
    "special": lambda rnd: (rnd.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e308, rnd.random()]), rnd.choice([0, 1, 1, None])),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(EV, "FIRST_BINS", 16)                 # so that many rounds are needed
    monkeypatch.setattr(EV, "SPLITS", 64)
    rnd = random.Random(case)
    pairs = [CASES[case](rnd) for _ in range(1500)]
    got = tuple(EV.youden_cut(spark.createDataFrame(pairs, "score double, label int")).values())
    want = brute(pairs)
    assert got[1:] == want[1:] and (got[0] == want[0] or (math.isnan(got[0]) and math.isnan(want[0])))


def test_no_row_for_each_distinct_score(spark, monkeypatch):
    seen = []
    inner = EV._bins
    monkeypatch.setattr(EV, "_bins", lambda rows, edges: seen.append(inner(rows, edges)) or seen[-1])
    df = spark.range(200_000).select((F.rand(3) + F.col("id") % 3 * 0.2).alias("score"), (F.col("id") % 3 == 2).cast("int").alias("label"))
    cut = EV.youden_cut(df)
    roc = EV.roc_curve(df)
    best = roc.agg(F.max_by("score", F.struct(F.col("tpr") - F.col("fpr"), "score"))).first()[0]
    assert cut["threshold"] == best
    assert len(seen) > 1 and sum(map(len, seen)) < 20_000


def test_one_class_empty_and_nothing_better(spark):
    schema = "score double, label int"
    assert EV.youden_threshold(spark.createDataFrame([], schema)).first()["threshold"] == 0.5
    assert EV.youden_threshold(spark.createDataFrame([(0.1, 1), (0.7, 1)], schema)).first()["threshold"] == 0.5
    worst = EV.youden_threshold(spark.createDataFrame([(0.1, 1), (0.7, 0)], schema)).first()
    assert (worst["threshold"], worst["youden_j"]) == (None, 0.0)
