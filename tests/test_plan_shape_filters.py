"""Missing scores counted out inside aggregates, multi-column histograms
and the fact-scan spreading guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.operators import analytics as AN
from returnlens.operators import evaluate as EV
from returnlens.plans.views import order_lines
from returnlens.sources.tables import table

from .conftest import SF_SMALL, rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_counts_leave_out_null_scores_and_count_null_labels_negative(spark):
    df = spark.createDataFrame(
        [(0.2, 1), (0.2, 0), (None, 1), (None, 0), (0.7, None), (0.7, 1)], "s double, y int")
    got = rows(EV.score_counts(df, "s", "y"), "score", "pos", "neg")
    assert got == [(0.2, 1, 1), (0.7, 1, 1)]


def test_auc_with_null_scores_equals_auc_without_them(spark):
    df = spark.createDataFrame(
        [(0.1, 0), (0.4, 1), (0.5, 0), (0.8, 1), (None, 1), (None, 0)], "s double, y int")
    with_nulls = EV.roc_auc(df, "s", "y").collect()[0]
    without = EV.roc_auc(df.where(F.col("s").isNotNull()), "s", "y").collect()[0]
    assert with_nulls["auc"] == without["auc"] == 0.75
    assert (with_nulls["positives"], with_nulls["negatives"]) == (2, 2)


def test_score_filter_is_not_a_join_condition(spark):
    """No filter on the computed score reaches the view's joins."""
    from returnlens.plans import scoring as S
    scored = S.score_plain(order_lines(spark, SF_SMALL))
    counts = EV.score_counts(scored, "Return_Probability", F.lit(1))
    for line in _plan(counts).splitlines():
        if "BroadcastHashJoin" in line or "SortMergeJoin" in line:
            assert "Return_Probability" not in line and "isnotnull((" not in line


def test_histograms_match_single_histograms(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (None, 20.0), (3.0, 10.0)],
                               "a double, b double")
    both = AN.histograms(df, [("a", "a", 2), ("b", "b", 4)])
    for var, bins in (("a", 2), ("b", 4)):
        one = rows(AN.histogram(df, var, bins), "bin", "lower", "upper", "n")
        assert rows(both.where(F.col("variable") == var), "bin", "lower", "upper", "n") == one
    assert sum(r["n"] for r in both.collect()) == 8  # missing values have no bin


def test_histograms_of_an_all_null_column_are_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    assert AN.histograms(df, [("a", "a", 3)]).count() == 0


def test_lines_are_narrow_before_they_are_shuffled(spark):
    """Flags, prices and dates of a line are worked out below the joins."""
    wanted = ["item_price", "product_rating", "discount", "delivery_days", "shipping_method", "return_status"]
    plan = order_lines(spark, SF_SMALL).select(*wanted)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in reversed(plan.splitlines()) if "Project" in x and "l_partkey" in x)
    assert "AS marks" in line and "AS price" in line and "AS ship_date" in line and "AS percent" in line
    above = plan[:plan.index(line)]
    assert "l_returnflag" not in above and "l_shipdate" not in above and "l_linenumber" not in above and "l_extendedprice" not in above
