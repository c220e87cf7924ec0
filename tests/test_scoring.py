"""End-to-end scorers on golden and hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.functions import decide as D
from returnlens.operators import evaluate as EV
from returnlens.plans import scoring as S

# FIXED VALUES: five input rows whose scores are known.
SAMPLE = [
    (69.9, 18.0, 4.1, 2, 20, "Electronics", 7, "Credit", 0),
    (39.47, 31.0, 4.3, 2, 5, "Electronics", 15, "Credit", 0),
    (80.07, 32.0, 4.8, 4, 10, "Electronics", 9, "Cash", 0),
    (176.04, 25.0, 4.8, 4, 10, "Books", 14, "Credit", 0),
    (36.21, 35.0, 2.3, 6, 10, "Books", 14, "Credit", 1),
]
SAMPLE_SCHEMA = ("item_price double, customer_age double, product_rating double, delivery_days int, "
                 "discount_percent int, category string, purchase_history int, payment_method string, "
                 "return_status int")

# Hand-made rows on both sides of each limit: probability, decision, label,
# 7-band confidence, what happened.
SCORED = [
    (0.95, 1, "Return", "Very High", "Returned"),
    (0.80, 1, "Return", "High", "Not Returned"),
    (0.71, 1, "Return", "High", "Returned"),
    (0.70, 1, "Return", "Medium-High", "Not Returned"),
    (0.51, 1, "Return", "Medium", "Returned"),
    (0.50, 0, "Not Return", "Medium", "Returned"),
    (0.40, 0, "Not Return", "Medium-Low", "Not Returned"),
    (0.30, 0, "Not Return", "Low", "Not Returned"),
    (0.20, 0, "Not Return", "Very Low", "Not Returned"),
    (0.05, 0, "Not Return", "Very Low", "Not Returned"),
]


def test_plain_rules_golden_first_five(spark):
    df = spark.createDataFrame(SAMPLE, SAMPLE_SCHEMA)
    got = S.score_plain(df).select("Return_Probability", "Prediction", "Prediction_Label").collect()
    assert [r[0] for r in got] == [0.4, 0.3, 0.3, 0.5, 0.3]
    assert [r[1] for r in got] == [0, 0, 0, 0, 0]  # 0.5 is not a return
    assert got[3][2] == "Not Return"


def test_scored_sample_labels_and_bands(spark):
    df = spark.createDataFrame(SCORED, "p double, pred int, label string, band string, status string")
    out = df.select("label", "band", D.label(F.col("pred")).alias("l2"), D.confidence7(F.col("p")).alias("b2"),
                    D.decision(F.col("p")).alias("d2"), "pred").collect()
    for r in out:
        assert r["l2"] == r["label"] and r["b2"] == r["band"] and r["d2"] == r["pred"]


def test_scored_sample_confusion(spark):
    df = spark.createDataFrame(SCORED, "p double, Prediction int, label string, band string, status string")
    df = df.withColumn("actual", F.when(F.col("status") == "Returned", 1).otherwise(0))
    r = EV.classification_report(df).collect()[0]
    # hand count over the ten rows
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (4, 2, 1, 3)


def test_result_columns_are_replaced(spark):
    df = spark.createDataFrame([(150.0, 0.9, 1, "x", "y")],
                               "price double, Return_Probability double, Prediction int, "
                               "Prediction_Label string, Confidence_Level string")
    out = S.score_plain(df)
    assert out.columns == ["price", "Prediction", "Return_Probability", "Prediction_Label", "Confidence_Level"]
    assert out.collect()[0]["Return_Probability"] == 0.5


def test_quick_scorer_imputes_and_falls_back(spark):
    # no relevant names: the first columns holding numbers are used (up to four)
    df = spark.createDataFrame([("a", "5", 10.0), ("b", None, 30.0), ("c", "abc", None)],
                               "name string, level string, weight double")
    from returnlens.operators.projections import scoring_columns
    assert scoring_columns(df) == ["level", "weight"]
    with_price = spark.createDataFrame([(None, 30.0), (150.0, 20.0), (10.0, 70.0)],
                                       "unit_price double, buyer_age double")
    got = [r[0] for r in S.score_quick(with_price).select("Return_Probability").collect()]
    # the NULL price takes the median 80 (no price rule); ages 30, 20 (<25), 70 (>65)
    assert got == [0.3, 0.3 + 0.2 + 0.1, 0.3 - 0.1 + 0.1]


def test_production_scorer_uses_batch_fill(spark):
    df = spark.createDataFrame(
        [(150.0, None, 5, 10, "Returned"), (None, 2.0, 0, 3, "Not Returned"), (10.0, 4.5, 0, 8, None)],
        "item_price double, product_rating double, discount int, delivery_days int, return_status string")
    got = S.score_production(df).select("Return_Probability", "Confidence_Level", "return_status").collect()
    # row 1: price 150 (+0.2), rating NULL → median 3.25 (no rule), discount 5 (+0.1), delivery 10 (+0.15)
    assert got[0][0] == 0.3 + 0.2 + 0.1 + 0.15
    # row 2: price NULL → median 80 (nothing), rating 2 (+0.3)
    assert got[1][0] == 0.3 + 0.3
    # row 3: price 10 (-0.1), rating 4.5 (-0.2), delivery 8 (+0.15)
    assert got[2][0] == 0.3 - 0.1 - 0.2 + 0.15
    assert got[0][2] == "Returned"  # leakage columns stay in the output


def test_production_scorer_runs_the_plan_behind_its_input_once(spark):
    """With ``keep`` the scores, also of the rows that fill statistics came from, read a stored table."""
    df = spark.createDataFrame([(150.0, None, 5, "a"), (None, 2.0, 0, "b"), (10.0, 4.5, 0, None)],
                               "item_price double, product_rating double, discount int, note string")
    joined = df.join(df.select("note", F.lit(1).alias("other")), "note", "left")
    kept = S.score_production(joined, keep=["note"])
    assert kept.columns[:4] == ["note", "item_price", "product_rating", "discount"] and "other" not in kept.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, S.score_production(joined).drop("other").collect()))
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
