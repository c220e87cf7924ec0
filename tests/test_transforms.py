"""Fit/apply transforms on hand-written edge tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from returnlens.operators import transforms as TR

from .conftest import rows


@pytest.fixture()
def ties(spark):
    # values 1, 2, 3, 10, NULL with categories b, a, a, b, NULL
    return spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)],
                                 "v double, cat string")


def test_median_mode_std_on_ties(ties):
    assert TR.fit_medians(ties, ["v"]) == {"v": 2.5}
    assert TR.fit_modes(ties, ["cat"]) == {"cat": "a"}  # tie a/b → smallest
    mean, std = TR.fit_scaler(ties, ["v"])["v"]
    assert mean == 4.0 and math.isclose(std, 3.5355339, rel_tol=1e-7)  # population std


def test_all_null_statistics(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    assert TR.fit_medians(df, ["x"]) == {"x": 0.0}
    assert TR.fit_modes(df, ["s"]) == {"s": "Unknown"}


def test_impute_apply_keeps_types(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2.0, None), (4, 6.0, "a")], "i int, d double, s string")
    out = TR.impute(df, {"i": 2.5, "d": 4.0}, {"s": "a"})
    got = out.collect()
    assert [r["i"] for r in got] == [1.0, 2.5, 4.0]  # fractional median → double
    assert [r["d"] for r in got] == [4.0, 2.0, 6.0]
    assert [r["s"] for r in got] == ["a", "a", "a"]
    whole = TR.impute(df, {"i": 2.0}, {})
    assert dict(whole.dtypes)["i"] == "double"  # whatever the median is


def test_clip_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1000.0,), (1001.0,), (None,), (float("nan"),)], "product_price double")
    coerced = TR.coerce_cells(df)  # NaN → NULL first, as on ingest
    got = [r[0] for r in TR.clip_ranges(coerced).collect()]
    assert got == [1.0, 1.0, 1000.0, 1000.0, None, None]


def test_clean_categories(spark):
    df = spark.createDataFrame([("a",), (None,), ("nan",), ("1.0",)], "c string")
    assert [r[0] for r in TR.clean_categories(df, ["c"]).collect()] == ["a", "Unknown", "Unknown", "1.0"]


def test_binarise_target_values(spark):
    vals = ["Returned", "RETURN", "yes", "True", "1", "1.0", "0", "no", " returned ", None]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(TR.binarise_target(F.col("t"), df.schema["t"].dataType)).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]  # text is not trimmed; '1.0' is not '1'
    num = spark.createDataFrame([(1,), (0,), (None,)], "t int")
    assert [r[0] for r in num.select(TR.binarise_target(F.col("t"), num.schema["t"].dataType)).collect()] \
        == [1, 0, 0]


def test_convertible_columns(spark):
    df = spark.createDataFrame([("1", "a", " 2.5 ", 3), (None, "4", "7", None)], "x string, y string, z string, n int")
    assert TR.convertible_columns(df) == ["x", "z", "n"]
    assert dict(TR.coerce_columns(df).dtypes) == {"x": "double", "y": "string", "z": "double", "n": "int"}


def test_standardise_aliases(spark):
    df = spark.createDataFrame(
        [("Books", 1500.0, 3, 15.0, "Ohio", "UPI", "Express", 10, 5, 12, 0.15, 4.8, "Returned"),
         (None, None, 1, None, "Texas", "Cash", "Standard", 0, 9, 7, 0.02, None, "Not Returned")],
        "Product_Category string, Price double, Quantity int, User_Age double, Location string, "
        "Payment_Type string, Shipping_Type string, Discount int, Delivery_Days int, Order_Count int, "
        "Return_Rate double, Rating double, Return_Status string")
    out, mapping, target = TR.standardise(df)
    assert target == "Return_Status"
    # Return_Rate is leakage (contains 'return'); the rest map (11 of 12)
    assert "return_history_rate" not in mapping and len(mapping) == 11
    got = out.collect()
    assert got[0]["product_price"] == 1000.0  # clipped
    assert got[0]["customer_age"] == 18.0     # clipped up
    assert got[0]["return_history_rate"] == 0.1  # default
    assert got[1]["product_category"] == "Unknown"
    assert got[1]["product_price"] is None    # NULL stays NULL
    assert [r["target"] for r in got] == [1, 0]
    protected, m2, _ = TR.standardise(df, protect=["Return_Rate"])
    assert m2["return_history_rate"] == "Return_Rate"


def test_label_encoder_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "cat string")
    enc = TR.fit_label_encoder(train, ["cat"])
    assert rows(enc, "value", "code") == [("a", 0), ("b", 1), ("c", 2)]
    test = spark.createDataFrame([("c",), ("z",), (None,)], "cat string")
    assert sorted(r[0] for r in TR.label_encode(test, enc, ["cat"], unseen="first").collect()) == [0, 0, 2]
    assert sorted([r[0] for r in TR.label_encode(test, enc, ["cat"]).collect()], key=str) == [2, None, None]


def test_prepare_for_scoring(spark):
    df = spark.createDataFrame([(1.0, "x", "Returned", "5"), (None, None, "No", "7"), (3.0, "x", None, None)],
                               "price double, kind string, return_status string, qty string")
    prepared, leakage = TR.prepare_for_scoring(df)
    assert leakage == ["return_status"]
    got = prepared.collect()
    assert [r["price"] for r in got] == [1.0, 2.0, 3.0]
    assert [r["kind"] for r in got] == ["x", "x", "x"]
    assert [r["qty"] for r in got] == [5.0, 7.0, 6.0]  # fully numeric text became numeric
