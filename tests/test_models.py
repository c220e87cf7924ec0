"""Model fitting on propensity-labelled data, persistence round trip,
unknown-category encoding."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from returnlens.functions import rules as R
from returnlens.operators import evaluate as EV
from returnlens.operators import models as ML
from returnlens.operators import split as SP
from returnlens.operators import transforms as TR
from returnlens.plans.views import order_lines

from .conftest import SF_MID

NUM = ["product_price", "order_quantity", "customer_age", "discount", "delivery_time", "product_rating"]
CAT = ["product_category", "payment_method"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Canonical features with a label drawn from the SC4 propensity by a
    keyed uniform number (deterministic), so the label depends on features."""
    canon, _, _ = TR.standardise(order_lines(spark, SF_MID), keep=["order_id", "line_no"])
    feats = {"price": F.col("product_price"), "category": F.col("product_category"),
             "delivery": F.col("delivery_time"), "rating": F.col("product_rating"),
             "return_rate": F.col("return_history_rate"), "discount": F.col("discount"),
             "quantity": F.col("order_quantity"), "age": F.col("customer_age")}
    p = R.clamp(R.propensity("production", feats))
    u = (SP.key_hash(["order_id", "line_no"], 7) % 1_000_000) / 1_000_000.0
    df = canon.withColumn("y", F.when(u < F.coalesce(p, F.lit(0.5)), 1).otherwise(0))
    return SP.split_train_test(df, ["order_id", "line_no"])


def test_model_learns_propensity_labels(spark, labelled):
    train = labelled.where(F.col("part") == "train")
    test = labelled.where(F.col("part") == "test")
    folds = SP.assign_folds(train, ["order_id", "line_no"], 5)
    model = ML.fit(folds.where("fold > 0"), NUM, CAT, "y", kind="lr", threshold="youden", tune_on=folds.where("fold = 0"), maxIter=50)
    auc = EV.roc_auc(model.score(test), "p", "y").collect()[0]["auc"]
    assert auc > 0.6
    assert model.threshold is None or 0.0 < model.threshold < 1.0
    m = ML.evaluate_model(model, test, "y").collect()[0]
    assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == test.count()


def test_save_load_round_trip(spark, labelled):
    train = labelled.where(F.col("part") == "train")
    model = ML.fit(train, NUM, CAT, "y", kind="rf", numTrees=5, maxDepth=4)
    path = os.path.join(tempfile.mkdtemp(prefix="rl-model-"), "m")
    ML.save(model, path)
    loaded = ML.load(path)
    # (order_id, line_no) is not a key of the view, so compare the multisets
    a = sorted(tuple(r) for r in model.score(train).select("order_id", "line_no", "p").collect())
    b = sorted(tuple(r) for r in loaded.score(train).select("order_id", "line_no", "p").collect())
    assert a == b
    info = ML.model_info(path).collect()[0]
    assert info["model_type"] == "rf" and info["numeric_features"] == len(NUM)
    imp = ML.feature_importance(loaded).collect()
    assert len(imp) <= 10 and abs(sum(r["importance"] for r in imp) - 1.0) < 0.05


def test_unknown_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 1), (3.0, "a", 0), (4.0, "b", 1)],
                                  "x double, c string, y int")
    model = ML.fit(train, ["x"], ["c"], "y", kind="lr", maxIter=10)
    test = spark.createDataFrame([(1.0, "zzz", 0), (1.0, None, 0)], "x double, c string, y int")
    feats = model.pipeline.transform(ML.apply_prep(
        test.select("*", F.col("x").alias("m__x"), F.col("c").alias("m__c")), ML._rename(model.prep, "m__")))
    vecs = [r["features"].toArray().tolist() for r in feats.collect()]
    # unseen → all one-hot slots zero; NULL → the training mode 'a' (frozen fill)
    assert vecs[0][1:] == [0.0, 0.0]
    assert vecs[1][1:] != [0.0, 0.0]


def test_gradient_boosted_trees_fit(spark, labelled):
    train = labelled.where(F.col("part") == "train")
    test = labelled.where(F.col("part") == "test")
    model = ML.fit(train, NUM, CAT, "y", kind="gbt", maxIter=5, maxDepth=3)
    auc = EV.roc_auc(model.score(test), "p", "y").collect()[0]["auc"]
    assert auc > 0.55


def test_model_selection_tie_rules(spark, labelled):
    train = labelled.where(F.col("part") == "train")
    test = labelled.where(F.col("part") == "test")
    m = ML.fit(train, NUM, CAT, "y", kind="lr", maxIter=20)
    name, _, table = ML.select_model([("first", m), ("second", m)], test, "y")
    assert name == "first" and table.count() == 2      # equal F1: the earlier one
    name, _, _ = ML.select_model([("lr", m), ("rf", m)], test, "y", prefer="rf")
    assert name == "rf"                                 # the preferred one wins ties
    assert ML.lr_reg_param(1.0, 1000) == 0.001


def test_unknown_parameters_are_refused():
    for kind, bad in (("lr", "numTrees"), ("rf", "C"), ("gbt", "minInstances")):
        with pytest.raises(ValueError):
            ML.classifier(kind, **{bad: 1})
    with pytest.raises(ValueError):
        ML.classifier("lr", C=1.0)
    assert ML.classifier("gbt", minInstancesPerNode=2).getMinInstancesPerNode() == 2
    lr = ML.classifier("lr", n_rows=200, C=0.1, penalty="l1")
    assert abs(lr.getRegParam() - 0.05) < 1e-12 and lr.getElasticNetParam() == 1.0


def test_grid_has_the_42_candidates():
    assert {k: len(ML.candidates(g)) for k, g in ML.GRIDS.items()} == {"rf": 24, "gbt": 12, "lr": 6}


def test_grid_search_ranks_candidates_and_fits_inside_folds(spark, labelled, monkeypatch):
    train = SP.assign_folds(ML.bounded(labelled, ["order_id", "line_no"], 600), ["order_id", "line_no"], 2)
    fitted_on = []
    prep = ML.fit_prep
    monkeypatch.setattr(ML, "fit_prep", lambda df, *a, **k: fitted_on.append(df.count()) or prep(df, *a, **k))
    out = ML.grid_search(train, NUM, CAT, "y", {"lr": {"C": [0.1, 10.0], "penalty": ["l2"]}, "rf": {"numTrees": [3], "maxDepth": [2]}})
    got = out.orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and [r["mean"] for r in got] == sorted((r["mean"] for r in got), reverse=True)
    assert len(fitted_on) == 4 and all(0 < n < 600 for n in fitted_on)


def test_train_test_report(spark, labelled):
    _, report = ML.train_test_report(ML.bounded(labelled, ["order_id", "line_no"], 600), NUM, CAT, "y", ["order_id", "line_no"], "lr",
                                     folds=2, maxIter=20)
    got = {r["split"]: r for r in report.collect()}
    assert set(got) == {"train", "test"} and 0 <= got["train"]["cv_accuracy"] <= 1 and got["test"]["cv_accuracy"] is None
    assert got["test"]["probability_min"] <= got["test"]["probability_mean"] <= got["test"]["probability_max"]


def test_too_many_categories_are_refused(spark):
    df = spark.createDataFrame([(str(i),) for i in range(30)], "c string")
    with pytest.raises(ValueError):
        ML.check_categories(df, ["c"], 29)
    ML.check_categories(df, ["c"], 30)


def test_one_hot_categories_come_from_all_lines(spark, monkeypatch):
    from returnlens.plans import catalog
    monkeypatch.setattr(catalog, "FIT_ROWS", 1)
    seen = order_lines(spark, SF_MID).where("shipping_method < '4'")
    got = {(r["column"], r["value"]) for r in catalog.q_one_hot_sums(spark, SF_MID).collect()}
    for c in ("shipping_method", "payment_method"):
        assert {v for k, v in got if k == c and v is not None} == {r[0] for r in seen.select(c).distinct().collect()}


def test_regression_on_categories_is_fitted_on_their_combinations(spark, monkeypatch):
    rows_in = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 6 + [("b", 0)] * 18 + [(None, 1)] * 4 + [("b", None)] * 0
    df = spark.createDataFrame(rows_in, "c string, y int")
    seen = []
    fit = ML.Pipeline.fit
    monkeypatch.setattr(ML.Pipeline, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    model = ML.fit(df, [], ["c"], "y", "lr")
    assert seen == [4]
    got = {r["c"]: r["p"] for r in model.score(df).select("c", "p").distinct().collect()}
    assert abs(got["b"] - 0.25) < 1e-4 and abs(got["a"] - 34 / 44) < 1e-4 and got[None] == got["a"]


def test_evaluation_scores_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", 0)] + [("b", 0)] * 4, "c string, y int")
    model = ML.fit(df, [], ["c"], "y", "lr")
    report = ML.evaluate_model(model, df, "y", spread=True)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "LocalTableScan" not in plan
    row = report.first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (4, 1, 0, 3) and abs(row["probability_max"] - 0.75) < 1e-4


def test_model_selection_fits_and_tunes_on_the_whole_train_part(spark, monkeypatch):
    from returnlens.plans import catalog
    from returnlens.session import materialize
    made = [(i // 3, i % 3, float(i % 90), i % 7, 20 + i % 40, i % 11, i % 13, i % 5 / 2, "abc"[i % 3], "xy"[i % 2], None if i % 50 == 0 else "p",
             "s", int(i * 7 % 10 < 4)) for i in range(1_500)]
    data = materialize(SP.split_train_test(spark.createDataFrame(
        made, "order_id long, line_no int, product_price double, order_quantity int, customer_age int, discount int, delivery_time int, "
              "product_rating double, product_category string, customer_location string, payment_method string, shipping_method string, target int"),
        ["order_id", "line_no"]))
    monkeypatch.setattr(catalog, "_model_table", lambda spark, sf_dir: data)
    monkeypatch.setattr(catalog, "FIT_ROWS", 100)
    monkeypatch.setattr(ML, "PRODUCTION", {"rf": {"numTrees": 2, "maxDepth": 2}, "gbt": {"maxIter": 2, "maxDepth": 2}, "lr": {"maxIter": 5, "C": 1.0}})
    seen, learned, fit, learn = [], [], ML.fit, ML.Pipeline.fit
    monkeypatch.setattr(ML, "fit", lambda df, *a, **k: (seen.append((k["kind"], df.count(), k["tune_on"].count())), fit(df, *a, **k))[1])
    monkeypatch.setattr(ML.Pipeline, "fit", lambda self, rows: (learned.append(rows.count()), learn(self, rows))[1])
    got = {r["split"]: r for r in catalog.q_model_selection(spark, "").collect()}
    folds = SP.assign_folds(data.where("part = 'train'"), ["order_id", "line_no"], 5)
    fitted_on, tuned_on = folds.where("fold > 0").count(), folds.where("fold = 0").count()
    assert fitted_on + tuned_on > 1_000 and seen == [(kind, fitted_on, tuned_on) for kind in ("rf", "gbt", "lr")]
    assert learned == [fitted_on] * 3
    assert list(got) == ["rf", "gbt", "lr"] and sum(r["chosen"] for r in got.values()) == 1
    assert {r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in got.values()} == {data.where("part = 'test'").count()}


def test_trees_cut_at_values_that_a_sample_of_rows_misses(spark):
    rare = F.col("id") % 20_000 == 7
    df = spark.range(60_000).select(rare.cast("int").alias("y"), F.when(rare, 9.0).otherwise((F.col("id") % 4).cast("double")).alias("x"),
                                    F.when(rare, "rare").otherwise("often").alias("c"))
    for numeric, categorical in ((["x"], []), ([], ["c"])):
        for seed in (1, 2, 3):      # Spark ML's 10,000 rows hold none of the three with a chance of 0.58
            model = ML.fit(df, numeric, categorical, "y", "rf", whole_cuts=True, numTrees=1, bootstrap=False, maxDepth=1, seed=seed)
            got = {(r["y"], r["p"]): r["count"] for r in model.score(df).groupBy("y", "p").count().collect()}
            assert got == {(0, 0.0): 59_997, (1, 1.0): 3}


def test_cut_values_come_from_all_rows(spark):
    n, inf = 4_000, float("inf")
    df = spark.createDataFrame([(float(i % 5), 0.0 if i < 3_900 else float(i), float(i), 1.0, None,
                                 float("nan") if i == 1 else inf if i == 2 else -inf if i == 3 else float(i % 2)) for i in range(n)],
                               "few double, heavy double, many double, one double, none double, odd double")
    got = ML.cut_values(df, df.columns, 8)
    assert got["few"] == [1.0, 2.0, 3.0, 4.0] and got["one"] == [1.0] and got["none"] == [0.0] and got["odd"] == [1.0]
    assert got["heavy"][0] == 0.0 and 0.0 < got["heavy"][1] < 1e-300       # what lies above the heavy value has a bin of its own
    assert len(got["many"]) == 7 and all(abs(v - n * k / 8) <= 4 for k, v in enumerate(got["many"], 1))
    assert ML.cut_values(df, []) == {}


def test_model_with_whole_cuts_is_saved_and_loaded(spark):
    df = spark.createDataFrame([(float(i % 50), "ab"[i % 2], int(i % 50 > 20)) for i in range(400)], "x double, c string, y int")
    model = ML.fit(df, ["x"], ["c"], "y", "gbt", whole_cuts=True, maxIter=3, maxDepth=3)
    path = os.path.join(tempfile.mkdtemp(), "m")
    ML.save(model, path)
    odd = df.unionByName(spark.createDataFrame([(float("nan"), "z", 0), (None, None, 0), (-1e9, "a", 0), (1e9, "b", 0)], df.schema))
    again = ML.load(path).score(model.score(odd), "again").collect()
    assert all(r["p"] == r["again"] for r in again) and EV.roc_auc(model.score(df), "p", "y").first()["auc"] > 0.99
    assert ML.feature_importance(model, 1).first()["feature"] == "x"
