"""Scalar Column functions: coercion, rule folds, bands, name rules."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from returnlens import constants as K
from returnlens.functions import decide as D
from returnlens.functions import names as N
from returnlens.functions import rules as R
from returnlens.functions.coerce import column_to_double


def test_to_double_numbers_as_text(spark):
    texts = ["1", "2.5", " 7 ", "1e3", "1d", "1_0", "abc", "nan", "inf", "True", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", column_to_double(df, "t").alias("x")).collect())
    assert got[0] == 1.0 and got[1] == 2.5 and got[2] == 7.0 and got[3] == 1000.0
    assert got[4] is None and got[5] is None and got[6] is None  # '1d' would parse with a bare try_cast
    assert got[7] is None  # NaN text is missing, not a number
    assert got[8] == math.inf
    assert got[9] is None and got[10] is None and got[11] is None


def test_nan_becomes_null_and_booleans_count(spark):
    df = spark.createDataFrame([(float("nan"), True), (2.0, False)], "x double, b boolean")
    got = df.select(column_to_double(df, "x").alias("x"), column_to_double(df, "b").alias("b")).collect()
    assert got[0]["x"] is None and got[0]["b"] == 1.0 and got[1]["b"] == 0.0


def test_rule_fold_is_bit_identical_to_sequential_addition(spark):
    # price < 20 → 0.3 - 0.1; price > 100 and rating < 2 and age → 0.3+0.2+0.1+0.3
    df = spark.createDataFrame([(10.0, 40.0, 4.0), (150.0, 70.0, 1.0), (150.0, 40.0, 4.0)],
                               "price double, age double, rating double")
    cols = [(c, F.col(c)) for c in df.columns]
    got = [r[0] for r in df.select(R.plain_rule_score(cols)).collect()]
    assert got[0] == 0.3 - 0.1 == 0.19999999999999998
    assert got[1] == 0.3 + 0.2 + 0.1 + 0.3 == 0.8999999999999999
    assert got[2] == 0.5  # exactly 0.5: not a return under p > 0.5


def test_clamp_and_null_score(spark):
    df = spark.createDataFrame([(-0.2,), (1.3,), (None,)], "p double")
    got = [r[0] for r in df.select(R.clamp(F.col("p"))).collect()]
    assert got == [0.05, 0.95, None]


def test_production_families_are_independent(spark):
    # one column named price_rating hits both the price and the rating family
    df = spark.createDataFrame([(150.0, 10, 9)], "price_rating double, discount_pct int, shipping_days int")
    cols = [(c, F.col(c).cast("double")) for c in df.columns]
    got = df.select(R.production_rule_score(cols)).collect()[0][0]
    assert got == 0.3 + 0.2 - 0.2 + 0.1 + 0.15


def test_bands(spark):
    ps = [0.81, 0.75, 0.65, 0.5, 0.35, 0.25, 0.1]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    p = F.col("p")
    got = df.select(D.confidence6(p), D.confidence7(p), D.risk_band(p), D.confidence2(p),
                    D.confidence_by_distance(p, 0.5)).collect()
    assert [r[0] for r in got] == ["Very High", "High", "Medium-High", "Medium", "Medium-Low", "Low", "Low"]
    assert [r[1] for r in got] == ["Very High", "High", "Medium-High", "Medium", "Medium-Low", "Low", "Very Low"]
    assert [r[2] for r in got] == ["High", "High", "Medium", "Medium", "Medium", "Low", "Low"]
    assert [r[3] for r in got] == ["High", "High", "Medium", "Medium", "Medium", "High", "High"]
    # closest to the threshold is called 'Very High' (the reference's ladder)
    assert got[3][4] == "Very High" and got[6][4] == "Medium-Low"


def test_decision_threshold_forms(spark):
    df = spark.createDataFrame([(0.5,), (0.6,)], "p double")
    strict = [r[0] for r in df.select(D.decision(F.col("p"))).collect()]
    tuned = [r[0] for r in df.select(D.decision(F.col("p"), 0.5, inclusive=True)).collect()]
    none = [r[0] for r in df.select(D.decision(F.col("p"), None)).collect()]
    assert strict == [0, 1] and tuned == [1, 1] and none == [0, 0]


def test_leakage_and_target_names():
    cols = ["Order_ID", "Return_Status", "return_history_rate", "Prediction", "price", "order_status"]
    assert N.leakage_columns(cols, "substring") == ["Return_Status", "return_history_rate", "Prediction"]
    assert N.leakage_columns(cols, "keyword") == ["Return_Status", "return_history_rate", "Prediction",
                                                  "order_status"]
    assert N.find_target_exact([" Returned ", "Return_Status"]) == " Returned "
    assert N.find_target_exact(["x", " Returned "], K.TARGET_NAMES_SHORT, strip=False) is None
    assert N.find_target_keyword(["return_history_rate", "order_outcome"]) == "order_outcome"
    assert N.find_target_keyword(["return_history_rate", "order_outcome"], with_exclusions=False) \
        == "return_history_rate"


def test_canonical_mapping_exact_partial_and_shared_source():
    cols = ["Price", "User_Age", "Payment_Type", "Return_Rate", "shipping", "type"]
    m = N.map_canonical(cols)
    assert m["product_price"] == "Price"
    assert m["customer_age"] == "User_Age"
    assert m["payment_method"] == "Payment_Type"
    # exact 'type' wins for the category
    assert m["product_category"] == "type"
    # one source feeds two canonical features
    assert m["shipping_method"] == "shipping" and m["delivery_time"] == "shipping"
    assert m["return_history_rate"] == "Return_Rate"


def test_substring_age_trap():
    # 'age' is inside 'average_rating', 'language' and 'percentage'
    assert N.plain_family("average_rating") == 1
    assert N.plain_family("storage_cost") == 0  # price/cost is tried first
    assert N.plain_family("language") == 1
    assert N.relevant_columns(["language", "shipping_cost", "Delivery_Method", "x"]) == \
        ["language", "shipping_cost"]


def test_ambiguous_names_are_rejected():
    import pytest
    with pytest.raises(ValueError):
        N.check_unambiguous(["Price", "price"])


def test_sign_of_infinity_after_any_white_space(spark):
    from returnlens.functions.coerce import text_to_double
    texts = ["\t-inf", "\n -Infinity\t", "\tinf", " 1", "\t2.5\n"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_to_double(F.col("t")).alias("v")).collect()]
    assert got == [-math.inf, -math.inf, math.inf, None, 2.5]


def test_display_formats(spark):
    from returnlens.functions import formats as FM
    r = spark.range(1).select(FM.percent(F.lit(0.1234)), FM.money(F.lit(1234.5)), FM.money(F.lit(1234.5), True), FM.thousands(F.lit(1234567)),
                              FM.days(F.lit(3.25)), FM.fixed(F.lit(2.0), 3)).first()
    assert list(r) == ["12.34%", "$1234.50", "$1,234.50", "1,234,567", "3.3 days", "2.000"]


def test_word_match_and_null_targets(spark):
    from returnlens.functions import names as N
    from returnlens.operators import transforms as TR
    assert N.relevant_columns(["percentage", "customer_age", "languages"], word_match=True) == ["customer_age"]
    assert N.relevant_columns(["percentage", "customer_age", "color"]) == ["percentage", "customer_age"]
    df = spark.createDataFrame([(1.0, "yes"), (2.0, None), (3.0, "no")], "price double, returned string")
    assert TR.standardise(df)[0].count() == 3 and TR.standardise(df, drop_null_target=True)[0].count() == 2
