"""Projections, type detection, profiling, validation and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.operators import analytics as AN
from returnlens.operators import profile as PF
from returnlens.operators import projections as PR

from .conftest import rows
from .test_scoring import SAMPLE, SAMPLE_SCHEMA


def test_detect_types_limits(spark):
    # five rows: every column has at most five distinct values, so the limit
    # decides nothing here; text columns are categorical, target/leakage out
    df = spark.createDataFrame(SAMPLE, SAMPLE_SCHEMA)
    num, cat = PR.feature_types(df, limit=10)
    assert "return_status" not in num + cat
    assert cat == ["category", "payment_method"]
    num3, cat3 = PR.feature_types(df, limit=3)
    assert "item_price" in cat3 and "delivery_days" in num3  # 5 distinct prices > 3


def test_display_and_drop(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5, 1)], "Order_ID int, a int, b int, Return_Probability double, Prediction int")
    assert PR.drop_identifiers(df).columns == ["a", "b", "Return_Probability", "Prediction"]
    assert PR.display_columns(df, 2).columns == ["Order_ID", "a", "Prediction", "Return_Probability"]
    assert PR.drop_leakage(df).columns == ["Order_ID", "a", "b"]


def test_to_canonical_defaults(spark):
    df = spark.createDataFrame([(9.5, "Cash")], "Price double, Payment_Type string")
    out = PR.to_canonical(df).collect()[0]
    assert out["product_price"] == 9.5 and out["payment_method"] == "Cash"
    assert out["shipping_method"] == "Standard" and out["customer_age"] == 35.0


def test_missing_and_quality(spark):
    df = spark.createDataFrame([(-1.0, 130, None), (float("nan"), 20, "x")],
                               "unit_price double, customer_age int, note string")
    assert PF.missing_total(df).collect()[0][0] == 2  # NULL and NaN both count
    q = {(r["check"], r["column"]): r["n"] for r in PF.quality_issues(df).collect()}
    assert q == {("negative_values", "unit_price"): 1, ("unreasonable_age", "customer_age"): 1}


def test_validation_report_empty(spark):
    df = spark.createDataFrame([], "a int")
    rep = PF.validation_report(df).collect()
    assert rep[0]["check"] == "empty" and rep[0]["severity"] == "error"
    assert PF.is_empty(df).collect()[0]["is_empty"] is True


def test_row_errors(spark):
    df = spark.createDataFrame([(0.0, 17.0, 3.0, 5.0, 0.5), (20000.0, 40.0, 6.0, 40.0, 1.5),
                                (None, 40.0, 3.0, 5.0, 0.2)],
                               "Product_Price double, Customer_Age double, Product_Rating double, "
                               "Delivery_Time double, Return_History_Rate double")
    got = [r["errors"] for r in PF.row_errors(df).collect()]
    assert got[0] == ["Product price must be greater than 0", "Customer age must be between 18 and 100"]
    assert got[1] == ["Product price seems unusually high", "Product rating must be between 1 and 5",
                      "Delivery time must be between 1 and 30 days",
                      "Return history rate must be between 0 and 1"]
    assert got[2] == []  # a NULL value fails nothing
    missing = spark.createDataFrame([(1,)], "x int")
    assert PF.row_errors(missing).collect()[0]["errors"][0] == "Product price must be greater than 0"


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string")
    assert rows(PF.distinct_counts(df), "column", "n_distinct") == [("x", 2), ("y", 2)]


def test_top_values_and_group_mean_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0), ("b", 0), ("a", 0)], "k string, p int")
    assert [tuple(r) for r in AN.top_values(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    assert [r["key"] for r in AN.group_mean_top(df, "k", "p", 2).collect()] == ["a", "b"]


def test_histogram_bins_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    got = rows(AN.histogram(df, "x", 2), "bin", "lower", "upper", "n")
    assert got == [(0, 0.0, 5.0, 1), (1, 5.0, 10.0, 2)]  # the max lands in the last bin


def test_filter_results(spark):
    df = spark.createDataFrame([(0.7, 1), (0.55, 1), (0.4, 0)], "Return_Probability double, Prediction int")
    assert AN.filter_results(df, 0.6, "Return").count() == 1
    assert AN.filter_results(df, 0.0, "Not Return").count() == 1
    assert AN.filter_results(df).count() == 3


def test_class_counts_share(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "actual int")
    assert rows(AN.class_counts(df), "label", "n", "share") == [(0, 3, 0.75), (1, 1, 0.25)]


def test_columns_of_many_values_are_not_counted(spark, monkeypatch):
    """Counts around the sketch's bound are exact; zero has one sign, gaps count
    for nothing, and a limit beyond the bound counts all."""
    from returnlens.operators import distinct as DI
    n = DI.EXACT
    df = spark.range(3 * n).selectExpr(f"CAST(id AS STRING) AS k_many", f"id % {n} AS k_bound", f"id % {n + 1} AS k_above",
                                       "IF(id % 2 = 0, 0.0D, -0.0D) AS zeros", "CAST(NULL AS STRING) AS nothing", "CONCAT('a', id % 3) AS letters",
                                       "IF(id % 3 = 0, NULL, id % 5) AS gaps", "CAST(id % 4 AS FLOAT) AS f")
    few, _ = DI.sketched_counts(df, {c: DI.sketchable(F.col(c), df.schema[c].dataType) for c in df.columns})
    assert few == {"k_many": None, "k_bound": n, "k_above": None, "zeros": 1, "nothing": 0, "letters": 3, "gaps": 5, "f": 4}
    stats = {r["column"]: (r["n_numeric"], r["n_distinct"]) for r in PR.type_stats(df).collect()}
    assert stats["k_many"] == (3 * n, 3 * n) and stats["k_above"] == (3 * n, n + 1) and stats["k_bound"] == (3 * n, n)
    assert stats["letters"] == (0, 3) and stats["nothing"] == (0, 0) and stats["zeros"] == (3 * n, 1) and stats["gaps"] == (2 * n, 5)
    assert PR.feature_types(df, 4) == (["zeros", "f"], ["k_many", "k_bound", "k_above", "nothing", "letters", "gaps"])
    assert PR.feature_types(df, n + 1)[0] == ["k_bound", "k_above", "zeros", "gaps", "f"]
    assert rows(PF.distinct_counts(df.select("k_many", "k_above", "letters", "nothing")), "column", "n_distinct") == \
        [("k_above", n + 1), ("k_many", 3 * n), ("letters", 3)]
    none = df.limit(0)
    assert PR.feature_types(none, 4)[0] == [] and PF.distinct_counts(none).count() == 0
