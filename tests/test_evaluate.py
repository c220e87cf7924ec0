"""Evaluation operators against brute force on small tables."""

from __future__ import annotations

import random

from returnlens.operators import evaluate as EV


def _scored(spark, n=400, seed=5, levels=None):
    rnd = random.Random(seed)
    data = []
    for _ in range(n):
        y = rnd.randint(0, 1)
        s = rnd.choice(levels) if levels else round(rnd.random() * 0.6 + 0.3 * y, 3)
        data.append((s, y))
    return data, spark.createDataFrame(data, "score double, label int")


def _auc_brute(data):
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    win = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return win / (len(pos) * len(neg))


def test_auc_matches_pairwise_count(spark):
    for levels in (None, [0.1, 0.2, 0.3, 0.5]):  # continuous, and heavy ties
        data, df = _scored(spark, levels=levels)
        got = EV.roc_auc(df).collect()[0]["auc"]
        assert abs(got - _auc_brute(data)) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0.3, 1), (0.6, 1)], "score double, label int")
    assert EV.roc_auc(df).collect()[0]["auc"] is None


def test_roc_curve_and_youden(spark):
    data, df = _scored(spark, n=300, seed=9)
    P = sum(y for _, y in data)
    N = len(data) - P
    roc = {r["score"]: r for r in EV.roc_curve(df).collect()}
    best, best_s = 0.0, None
    for s in sorted({s for s, _ in data}, reverse=True):
        tp = sum(1 for x, y in data if x >= s and y == 1)
        fp = sum(1 for x, y in data if x >= s and y == 0)
        assert roc[s]["tps"] == tp and roc[s]["fps"] == fp
        j = tp / P - fp / N
        if j > best:
            best, best_s = j, s
    assert EV.best_threshold(df) == best_s


def test_youden_edge_cases(spark):
    one = spark.createDataFrame([(0.3, 0), (0.6, 0)], "score double, label int")
    assert EV.best_threshold(one) == 0.5
    # scores that rank negatives first: no cut beats J = 0 → NULL (nothing positive)
    bad = spark.createDataFrame([(0.9, 0), (0.1, 1)], "score double, label int")
    assert EV.best_threshold(bad) is None


def test_confusion_and_metrics_with_one_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "actual int, Prediction int")
    r = EV.classification_report(df).collect()[0]
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 1, 0, 0)
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["accuracy"] == round(2 / 3, 6) and r["predicted_rate"] == round(1 / 3, 6)


def test_summary_and_distribution(spark):
    df = spark.createDataFrame([(0.8, 1), (0.5, 0), (0.3, 0), (0.2, 0)], "Return_Probability double, Prediction int")
    s = EV.score_summary(df).collect()[0]
    assert (s["total_records"], s["predicted_returns"], s["high_risk_count"], s["medium_risk_count"],
            s["low_risk_count"]) == (4, 1, 1, 1, 2)
    d = EV.probability_distribution(df).collect()[0]
    assert d["probability_min"] == 0.2 and d["probability_max"] == 0.8
    assert d["share_above"] == 0.25 and d["share_below"] == 0.5
    q = EV.probability_distribution(df, variant="quick").collect()[0]
    assert q["share_below"] == 0.75


def test_auc_over_billions_of_rows(spark, monkeypatch):
    """Counts as they come from billions of scored rows must not overflow."""
    from returnlens.operators import evaluate as E
    counts = spark.createDataFrame([(0.1, 1_000_000_000, 5_000_000_000), (0.5, 500_000_000, 3_000_000_000), (0.9, 1_500_000_000, 1_000_000_000)],
                                   "score double, pos bigint, neg bigint")
    monkeypatch.setattr(E, "score_counts", lambda *a: counts)
    r = E.roc_auc(counts, "score", "pos").collect()[0]
    rows = [(0.1, 10, 50), (0.5, 5, 30), (0.9, 15, 10)]
    want = sum(p * n * (1.0 if s > t else 0.5 if s == t else 0.0) for s, p, _ in rows for t, _, n in rows) / (30 * 90)
    assert abs(r["auc"] - want) < 1e-12 and r["positives"] == 3_000_000_000
