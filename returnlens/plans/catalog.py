"""Registered queries: name → (spark, sf_dir) → DataFrame.

Each query reads the driver tables over their whole extent — through the
``order_lines`` view, or the line-item stream — and runs one library
operator or a composition of them.  ``plans.oracle`` holds the equivalent
DuckDB SQL under the same names; only the comparison of fitted models has
none (checked on rows and by its own tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import formats as FM
from ..functions import rules as R
from ..functions.coerce import column_to_double
from ..operators import analytics as AN
from ..operators import evaluate as EV
from ..operators import history as HI
from ..operators import merging as ME
from ..operators import models as ML
from ..operators import profile as PF
from ..operators import projections as PR
from ..operators import search as SE
from ..operators import split as SP
from ..operators import transforms as TR
from ..sources.tables import table
from . import scoring as S
from .views import order_lines, order_lines_with_dates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _actual(df: DataFrame) -> DataFrame:
    return df.withColumn("actual", F.when(F.col("return_status") == "Returned", 1).otherwise(0))


def _per_score(scored: DataFrame) -> DataFrame:
    """Scores grouped: probability, decision, label, band, rows, actual returns."""
    return (_actual(scored)
            .groupBy("Return_Probability", "Prediction", "Prediction_Label", "Confidence_Level")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("actual").cast("bigint").alias("returns")))


def _rows(scored: DataFrame) -> DataFrame:
    return scored.select("order_id", "line_no", "Prediction", "Return_Probability",
                         "Prediction_Label", "Confidence_Level")


def _production(spark, sf_dir) -> DataFrame:
    return _actual(S.score_production(order_lines(spark, sf_dir), keep=["return_status"]))


def _canonical(spark, sf_dir):
    """TR14 over order_lines; returns (frame, mapping, target)."""
    return TR.standardise(order_lines(spark, sf_dir), keep=["order_id", "line_no"])


# ---------------------------------------------------------------------------
# SC: scoring
# ---------------------------------------------------------------------------


@query("score_summary")
def q_score_summary(spark, sf_dir):
    """Flagship: plain rule scoring of every order line, then the summary (AG6)."""
    return EV.score_summary(S.score_plain(order_lines(spark, sf_dir)))


@query("rule_score_plain")
def q_rule_score_plain(spark, sf_dir):
    return _per_score(S.score_plain(order_lines(spark, sf_dir)))


@query("rule_score_plain_rows")
def q_rule_score_plain_rows(spark, sf_dir):
    return _rows(S.score_plain(order_lines(spark, sf_dir)))


@query("rule_score_imputed")
def q_rule_score_imputed(spark, sf_dir):
    return _per_score(S.score_quick(order_lines(spark, sf_dir)))


@query("rule_score_production")
def q_rule_score_production(spark, sf_dir):
    return _per_score(S.score_production(order_lines(spark, sf_dir), keep=["return_status"]))


@query("rule_score_production_rows")
def q_rule_score_production_rows(spark, sf_dir):
    return _rows(S.score_production(order_lines(spark, sf_dir), keep=["order_id", "line_no"]))


@query("propensity")
def q_propensity(spark, sf_dir):
    """SC4: the three propensity formulas (root, flexible, production) on
    the canonical features of every line."""
    canon, _, _ = _canonical(spark, sf_dir)
    feats = {"price": F.col("product_price"), "category": F.col("product_category"),
             "delivery": F.col("delivery_time"), "rating": F.col("product_rating"),
             "return_rate": F.col("return_history_rate"), "discount": F.col("discount"),
             "quantity": F.col("order_quantity"), "age": F.col("customer_age")}
    return canon.select("order_id", "line_no",
                        R.clamp(R.propensity("production", feats)).alias("propensity"),
                        R.clamp(R.propensity("root", feats)).alias("propensity_root"),
                        R.clamp(R.propensity("flexible", feats)).alias("propensity_flexible"))


@query("labels_and_bands")
def q_labels_and_bands(spark, sf_dir):
    """SC5-SC12: every label and band ladder over the production scores."""
    scored = S.score_production(order_lines(spark, sf_dir), keep=[])
    bands = AN.bands_table(scored.select("Return_Probability"))
    return (bands.groupBy("Return_Probability", "label", "confidence6", "confidence7",
                          "confidence_distance", "confidence2", "risk_band")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# AG: summaries and evaluation
# ---------------------------------------------------------------------------


@query("probability_distribution")
def q_probability_distribution(spark, sf_dir):
    return EV.probability_distribution(S.score_production(order_lines(spark, sf_dir), keep=[]))


@query("confusion_metrics")
def q_confusion_metrics(spark, sf_dir):
    """AG8 + AG9 + AG21: production rules against actual returns."""
    return EV.classification_report(_production(spark, sf_dir), "actual", "Prediction")


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    """AG10 on the production rule score (19 distinct values: many ties)."""
    return EV.roc_auc(_production(spark, sf_dir), "Return_Probability", "actual")


@query("roc_auc_propensity")
def q_roc_auc_propensity(spark, sf_dir):
    """AG10 on the continuous SC4 propensity (NULL scores left out)."""
    canon, _, _ = _canonical(spark, sf_dir)
    feats = {"price": F.col("product_price"), "category": F.col("product_category"),
             "delivery": F.col("delivery_time"), "rating": F.col("product_rating"),
             "return_rate": F.col("return_history_rate"), "discount": F.col("discount"),
             "quantity": F.col("order_quantity"), "age": F.col("customer_age")}
    scored = canon.select(R.clamp(R.propensity("production", feats)).alias("score"), "target")
    return EV.roc_auc(scored, "score", "target")


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    """AG11: TPR / FPR at every distinct production score."""
    roc = EV.roc_curve(_production(spark, sf_dir), "Return_Probability", "actual")
    return roc.select("score", "tps", "fps", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("youden_threshold")
def q_youden_threshold(spark, sf_dir):
    """AG12 on the production rule score."""
    return EV.youden_threshold(_production(spark, sf_dir), "Return_Probability", "actual")


@query("youden_continuous")
def q_youden_continuous(spark, sf_dir):
    """AG12 by branch and bound on the continuous SC4 propensity: nearly every
    line has a score of its own."""
    canon, _, _ = _canonical(spark, sf_dir)
    feats = {"price": F.col("product_price"), "category": F.col("product_category"),
             "delivery": F.col("delivery_time"), "rating": F.col("product_rating"),
             "return_rate": F.col("return_history_rate"), "discount": F.col("discount"),
             "quantity": F.col("order_quantity"), "age": F.col("customer_age")}
    cut = EV.youden_cut(canon.select(R.clamp(R.propensity("production", feats)).alias("score"), "target"), "score", "target")
    return spark.createDataFrame([tuple(cut.values())], "threshold double, tps bigint, fps bigint, positives bigint, negatives bigint")


@query("tuned_decisions")
def q_tuned_decisions(spark, sf_dir):
    """SC4 → AG12 → SC6 → SC7 → SC10: the propensity as a score, its Youden
    threshold tuned against actual returns, decisions p >= t, labels and
    distance-to-threshold bands, counted."""
    from ..session import materialize
    canon, _, _ = _canonical(spark, sf_dir)
    feats = {"price": F.col("product_price"), "category": F.col("product_category"),
             "delivery": F.col("delivery_time"), "rating": F.col("product_rating"),
             "return_rate": F.col("return_history_rate"), "discount": F.col("discount"),
             "quantity": F.col("order_quantity"), "age": F.col("customer_age")}
    # stored: the tuning and the decisions read it, and the joins run once
    scored = materialize(canon.select(R.clamp(R.propensity("production", feats)).alias("p"), "target"))
    t = EV.best_threshold(scored, "p", "target")
    out = S.score_with_probability(scored, F.col("p"), t, bands="distance")
    # A line without a score is no return: the comparison is false.
    return out.groupBy("Prediction", "Prediction_Label", "Confidence_Level").agg(
        F.count(F.lit(1)).alias("n"), F.count("Return_Probability").alias("scored"),
        F.sum("target").cast("bigint").alias("returns"), F.lit(t).cast("double").alias("threshold"))


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """AG13 + AG14: rows, share and balanced weight per class."""
    return SP.class_weights(_actual(order_lines(spark, sf_dir)), "actual", with_share=True)


@query("class_counts")
def q_class_counts(spark, sf_dir):
    """AG13: rows and share of each class beside the target rate."""
    from ..session import materialize
    df = materialize(_actual(order_lines(spark, sf_dir)).select("actual"))
    return AN.class_counts(df, "actual").join(AN.target_rate(df, "actual"))


@query("actual_vs_predicted")
def q_actual_vs_predicted(spark, sf_dir):
    """AG21: mean actual return rate beside the mean predicted rate."""
    return EV.actual_vs_predicted(_production(spark, sf_dir))


@query("top_rows")
def q_top_rows(spark, sf_dir):
    """SO1 + SO2: the twenty dearest lines."""
    df = order_lines(spark, sf_dir).select("item_price", "order_id", "line_no")
    return AN.top_rows(df, 20, F.col("item_price").desc_nulls_last(), F.col("order_id"), F.col("line_no"))


@query("top_categories")
def q_top_categories(spark, sf_dir):
    """AG15: five most frequent product categories."""
    return AN.top_values(order_lines(spark, sf_dir), "product_category", 5)


@query("category_return_rate")
def q_category_return_rate(spark, sf_dir):
    """AG16 + SO1 + SO2: mean predicted return per category, top 10."""
    return AN.group_mean_top(S.score_production(order_lines(spark, sf_dir), keep=["product_category"]),
                             "product_category", "Prediction", 10)


@query("histograms")
def q_histograms(spark, sf_dir):
    """AG17: price (20 bins), rating (10 bins), probability (20 bins)."""
    scored = S.score_production(order_lines(spark, sf_dir), keep=["item_price", "product_rating"])
    return AN.histograms(scored, [("price", "item_price", K.HIST_BINS["price"]),
                                  ("rating", "product_rating", K.HIST_BINS["rating"]),
                                  ("probability", "Return_Probability", K.HIST_BINS["probability"])])


@query("risk_distribution")
def q_risk_distribution(spark, sf_dir):
    return AN.risk_distribution(S.score_production(order_lines(spark, sf_dir), keep=[]))


@query("dataset_summary")
def q_dataset_summary(spark, sf_dir):
    """AG19: rows, actual return rate, mean price / rating / delivery days."""
    return AN.dataset_summary(_actual(order_lines(spark, sf_dir)), "actual", "item_price",
                              "product_rating", "delivery_days")


@query("distinct_counts")
def q_distinct_counts(spark, sf_dir):
    return PF.distinct_counts(order_lines(spark, sf_dir))


@query("missing_report")
def q_missing_report(spark, sf_dir):
    """AG2 per column, with the table total as an extra row."""
    return PF.missing_counts(order_lines(spark, sf_dir), total=True)


@query("quality_report")
def q_quality_report(spark, sf_dir):
    """AG3 + AG4 on the view plus two derived columns: the net price after
    the discount percentage, and years since the customer turned 30 (an
    'age' column with negatives)."""
    df = order_lines(spark, sf_dir).select(
        "*", (F.col("item_price") - F.col("discount")).alias("net_price"),
        (F.col("customer_age") - 30).alias("years_past_age_30"))
    return PF.quality_issues(df, include_amount=True)


@query("table_counts")
def q_table_counts(spark, sf_dir):
    """AG1 + FI3: rows, columns, and the empty-table check."""
    df = order_lines(spark, sf_dir)
    return PF.table_counts(df).join(PF.is_empty(df).select(F.col("is_empty").cast("int").alias("is_empty")))


@query("validation_report")
def q_validation_report(spark, sf_dir):
    """AG5: the long validation report (rows, columns, missing cells,
    leakage and target columns, quality issues, feature types)."""
    return PF.validation_report(order_lines(spark, sf_dir))


@query("ultra_validation")
def q_ultra_validation(spark, sf_dir):
    """AG5, "ultra" variant: keyword leakage (PR3), keyword target (PR5),
    type limit 20, amount columns in the negatives check."""
    return PF.validation_report(order_lines(spark, sf_dir), K.TYPE_LIMIT_ULTRA, "keyword", "keyword")


@query("csv_round_trip")
def q_csv_round_trip(spark, sf_dir):
    """IO2 then IO1: scored lines written as CSV to the shared checkpoint
    folder, read back with an explicit schema, summarised per band."""
    from ..session import scratch_path
    from ..sources import files as FS
    scored = S.score_plain(order_lines(spark, sf_dir)).select(
        "order_id", "line_no", "item_price", "Prediction", "Return_Probability", "Confidence_Level")
    path = scratch_path(spark, "csv")
    FS.write_csv(scored, path)
    back = FS.read_csv(spark, path, "order_id long, line_no int, item_price double, Prediction int, "
                                    "Return_Probability double, Confidence_Level string")
    return back.groupBy("Confidence_Level").agg(
        F.count(F.lit(1)).alias("n"), F.count("item_price").alias("priced"),
        F.sum("Prediction").cast("bigint").alias("predicted_returns"),
        F.round(F.sum("Return_Probability"), 6).alias("probability_sum"))


@query("parquet_round_trip")
def q_parquet_round_trip(spark, sf_dir):
    """IO2, Parquet form: scored lines in folders by band, read back by band."""
    from ..session import scratch_path
    from ..sources import files as FS
    scored = S.score_plain(order_lines(spark, sf_dir)).select("order_id", "Prediction", "Confidence_Level")
    path = scratch_path(spark, "parquet")
    FS.write_parquet(scored, path, partition_by=["Confidence_Level"])
    return spark.read.parquet(path).groupBy("Confidence_Level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Prediction").cast("bigint").alias("predicted_returns"))


@query("observed_write")
def q_observed_write(spark, sf_dir):
    """IO2 + AG2 + AG6 + AG7: scored lines written as Parquet once; summary,
    distribution and missing cells are collected by the job that writes them."""
    from ..session import scratch_path
    scored = S.score_plain(order_lines(spark, sf_dir))
    inputs = [c for c in scored.columns if c not in K.RESULT_COLUMNS]
    return ME.write_observed(scored, scratch_path(spark, "scored"), ME.score_metrics(F.col("Return_Probability"), F.col("Prediction"), inputs))


PROFILE_BOUNDS = {"item_price": (0.0, 200.0), "order_quantity": (0.0, 50.0), "customer_age": (18.0, 98.0), "product_rating": (1.0, 5.0)}


@query("stored_profile")
def q_stored_profile(spark, sf_dir):
    """AG2 + AG17 + AG20: profiles of each day's lines, stored, and merged over a
    range of days without the lines; whether the merged estimate of distinct values
    is within 5 % of their number."""
    from ..session import materialize
    lines = order_lines_with_dates(spark, sf_dir)
    parts = materialize(ME.profile_parts(lines, F.col("order_date"), PROFILE_BOUNDS, ["payment_method", "order_id"]))
    merged = ME.merged_profile(parts.where("part >= DATE '1994-03-05' AND part < DATE '1996-07-01'"))
    some = lines.where("order_date >= DATE '1994-03-05' AND order_date < DATE '1996-07-01'")
    exact = some.agg(*[F.count_distinct(c).alias(c) for c in [*PROFILE_BOUNDS, "payment_method", "order_id"]])
    number = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("number")) for c in exact.columns])))
    return merged.join(number, "column").select(
        "column", "rows", "missing", "least", "most", F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"),
        (F.abs(F.col("distinct") - F.col("number")) <= 0.05 * F.col("number")).cast("int").alias("near"), "number")


@query("csv_inferred")
def q_csv_inferred(spark, sf_dir):
    """IO2 then IO1 without a schema: type, cells and largest value of each column."""
    from ..session import scratch_path
    from ..sources import files as FS
    lines = order_lines(spark, sf_dir).select(
        "order_id", "item_price", "customer_age", "return_status", (F.col("item_price") > 100).alias("dear"),
        F.when(F.col("line_no") == 1, "12").otherwise(" -1.5e1").alias("mixed"), F.concat(F.lit("1234567890123456789"), "line_no").alias("long_number"),
        F.when(F.col("line_no") == 1, "true").otherwise("1").alias("flag_or_number"), F.lit("NA").alias("nothing"))
    path = scratch_path(spark, "csv")
    FS.write_csv(lines, path)
    back = FS.read_csv(spark, path, infer=True)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(c).alias("cells"),
                     (F.max(F.col(c).cast("double")) if t != "string" else F.lit(None).cast("double")).alias("largest")) for c, t in back.dtypes]
    return back.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("csv_quoted_round_trip")
def q_csv_quoted_round_trip(spark, sf_dir):
    """IO2 then IO1 on text with quotes, commas, line breaks and spaces."""
    from ..session import scratch_path
    from ..sources import files as FS
    cu = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    note = F.concat(F.lit(' "'), "c_name", F.lit('", '), "c_mktsegment", F.lit("\nline 2, ""\\ end"),
                    F.when(F.col("c_custkey") % 3 == 0, F.lit('"')).otherwise(F.lit(" ")))
    text = cu.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 > 0, note).alias("note"), "c_acctbal")
    path = scratch_path(spark, "csv")
    FS.write_csv(text, path)
    back = FS.read_csv(spark, path, "c_custkey long, c_mktsegment string, note string, c_acctbal double", multi_line=True)
    return back.select("c_custkey", "c_mktsegment", "note", F.length("note").alias("note_length"), "c_acctbal")


# ---------------------------------------------------------------------------
# PR: projections and type detection
# ---------------------------------------------------------------------------


@query("detect_types")
def q_detect_types(spark, sf_dir):
    """PR13 with both cardinality limits (10 flexible, 20 ultra)."""
    stats = PR.type_stats(order_lines(spark, sf_dir))
    limits = F.explode(F.array(F.lit(K.TYPE_LIMIT_FLEXIBLE), F.lit(K.TYPE_LIMIT_ULTRA)))
    return PR.with_kind(stats.withColumn("type_limit", limits), F.col("type_limit"), "type_limit")


@query("drop_leakage")
def q_drop_leakage(spark, sf_dir):
    """PR1-PR6: identifiers and leakage dropped, target found and binarised."""
    df = order_lines(spark, sf_dir)
    target = PR.target_column(df, "exact")
    kept = PR.drop_leakage(PR.drop_identifiers(df), "substring").columns
    return df.select(*kept, TR.binarise_target(F.col(target), df.schema[target].dataType).alias("target"))


@query("drop_identifiers")
def q_drop_identifiers(spark, sf_dir):
    """PR1 on a table that has the identifiers under their fixed names."""
    df = order_lines(spark, sf_dir).select(
        F.col("order_id").alias("Order_ID"), F.col("customer_id").alias("Customer_ID"), "line_no", "discount", "shipping_method")
    return PR.drop_identifiers(df)


@query("replace_stale_results")
def q_replace_stale_results(spark, sf_dir):
    """PR12: scoring a table that was scored before replaces its results."""
    stale = order_lines(spark, sf_dir).withColumns({
        "Prediction": F.lit(9), "Confidence_Level": F.lit("old"), "Return_Probability": F.lit(0.123)})
    return _rows(S.score_plain(stale))


@query("canonical_partial_names")
def q_canonical_partial_names(spark, sf_dir):
    """PR7 + PR8 on names that are not aliases but contain one."""
    df = order_lines(spark, sf_dir).select(
        F.col("product_category").alias("main_product_category_name"), F.col("item_price").alias("net_item_price_eur"),
        F.col("customer_age").alias("the_customer_age_years"), F.col("product_rating").alias("mean_product_rating_stars"))
    return PR.to_canonical(df).select("product_category", "product_price", "customer_age", "product_rating",
                                      "return_history_rate", "purchase_history_count")


@query("scoring_columns_fallback")
def q_scoring_columns_fallback(spark, sf_dir):
    """PR10 where no name is relevant: the first columns with numbers."""
    df = order_lines(spark, sf_dir).select("payment_method", "order_quantity", "shipping_method", "discount", "line_no")
    return df.select(*PR.scoring_columns(df))


@query("filtered_results")
def q_filtered_results(spark, sf_dir):
    """FI1 + FI2 + PR11 + PR12: confident predicted returns, display columns."""
    lines = order_lines(spark, sf_dir)
    scored = S.score_production(lines, keep=lines.columns)
    return PR.display_columns(AN.filter_results(scored, 0.6, "Return"), 10)


@query("filtered_download")
def q_filtered_download(spark, sf_dir):
    """FI1 + FI2 + IO2: the confident predicted returns written as CSV, all
    columns, and read back without a schema (IO1)."""
    from ..session import scratch_path
    from ..sources import files as FS
    path = scratch_path(spark, "csv")
    lines = order_lines(spark, sf_dir)
    FS.write_csv(AN.filter_results(S.score_production(lines, keep=lines.columns), 0.6, "Return"), path)
    return FS.read_csv(spark, path, infer=True)


@query("row_validation")
def q_row_validation(spark, sf_dir):
    """FI4: all six record checks over every line, on raw values that really
    leave their ranges: the extended price, ship minus order days, a rating up to
    6 from the part's size, a rate up to 1.2 from the discount."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_discount"])
    od = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    pa = table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    base = li.join(od, li.l_orderkey == od.o_orderkey).join(pa, li.l_partkey == pa.p_partkey).select(
        (F.col("l_extendedprice") - 2000).alias("price"),
        (F.lit(10) + F.col("o_custkey") % 63).cast("int").alias("age"),
        (F.col("p_size") % 13 / F.lit(2.0)).alias("rating"),
        F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).alias("delivery_days"),
        (F.round(F.col("l_discount") * 100) * 12 / F.lit(100.0)).alias("rate"))
    checked = PF.row_errors(base, {"Product_Price": "price", "Customer_Age": "age", "Product_Rating": "rating",
                                   "Delivery_Time": "delivery_days", "Return_History_Rate": "rate"})
    return (checked.select(F.explode_outer("errors").alias("error"))
            .groupBy("error").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# TR: transforms
# ---------------------------------------------------------------------------


@query("coerce_cells")
def q_coerce_cells(spark, sf_dir):
    """TR1 + TR2 on text forms of the view's columns."""
    df = order_lines(spark, sf_dir).select(
        F.col("order_quantity").cast("string").alias("quantity_text"),
        F.concat(F.lit(" "), F.col("discount").cast("string"), F.lit(" ")).alias("discount_text"),
        F.col("item_price").cast("string").alias("price_text"),
        F.col("shipping_method"),
        F.concat(F.col("discount").cast("string"), F.lit("%")).alias("discount_pct"))
    conv = set(TR.convertible_columns(df))
    coerced = TR.coerce_cells(df)
    aggs = []
    for c in df.columns:
        aggs += [F.count(F.col(c)).alias(f"{c}__n"),
                 F.round(F.sum(F.col(c)), 6).alias(f"{c}__sum")]
    row = coerced.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_numeric"),
                      F.col(f"{c}__sum").alias("total"), F.lit(c in conv).cast("int").alias("converts"))
             for c in df.columns]
    return row.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")


@query("coerce_columns")
def q_coerce_columns(spark, sf_dir):
    """TR2 on text forms: only columns whose every cell converts change."""
    df = order_lines(spark, sf_dir).select(
        F.concat(F.lit("\t"), F.col("order_quantity").cast("string")).alias("quantity_text"), F.col("item_price").cast("string").alias("price_text"),
        F.when(F.col("order_id") % 2 == 0, F.col("discount").cast("string")).otherwise(F.lit("none")).alias("half_text"), "shipping_method")
    out = TR.coerce_columns(df)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(c).alias("n")) for c, t in out.dtypes])
    return out.agg(items.alias("a")).select(F.explode("a").alias("kv")).select("kv.*")


@query("round_half_even")
def q_round_half_even(spark, sf_dir):
    """TR16: ratings rounded to whole stars, half to even (2.5 → 2, 3.5 → 4)."""
    df = order_lines(spark, sf_dir)
    return (df.groupBy(F.col("product_rating").alias("rating"),
                     TR.round_half_even(F.col("product_rating"), 0).alias("rounded"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("relevant_columns")
def q_relevant_columns(spark, sf_dir):
    """PR9: the columns whose names carry a relevant word (price, cost,
    amount, age, rating, score, time, day), every row."""
    return PR.select_relevant(order_lines(spark, sf_dir))


@query("clip_ranges")
def q_clip_ranges(spark, sf_dir):
    """TR3 on values that leave their ranges on both sides."""
    df = order_lines(spark, sf_dir).select(
        "order_id", "line_no", (F.col("item_price") * 20 - 200).alias("product_price"), (F.col("customer_age") * 2 - 30).alias("customer_age"),
        (F.col("order_quantity") * 4 - 20).alias("order_quantity"), (F.col("discount") * 15 - 10).alias("discount"),
        (F.col("delivery_days") * 2 - 5).alias("delivery_time"), (F.col("product_rating") * 1.5 - 1).alias("product_rating"))
    return TR.clip_ranges(df)


@query("clean_categories")
def q_clean_categories(spark, sf_dir):
    """TR4 on categories with missing cells and the text 'nan'."""
    df = order_lines(spark, sf_dir).select(*[_with_gaps(c).alias(c) for c in ("shipping_method", "payment_method")])
    return (TR.clean_categories(df, ["shipping_method", "payment_method"])
            .groupBy("shipping_method", "payment_method").agg(F.count(F.lit(1)).alias("n")))


def _with_gaps(c: str) -> F.Column:
    """A category with cells missing, and some that say 'nan'."""
    mark = (F.col("order_id") + F.length(c)) % 7
    return F.when(mark == 0, F.lit(None)).when(mark == 1, F.lit("nan")).otherwise(F.col(c))


@query("impute_mode_apply")
def q_impute_mode_apply(spark, sf_dir):
    """TR8: modes fitted on the lines of even orders, frozen, and filled into
    all lines."""
    df = order_lines(spark, sf_dir).select(
        "order_id", *[F.when((F.col("order_id") + F.length(c)) % 7 > 0, F.col(c)).alias(c) for c in ("shipping_method", "payment_method")])
    modes = TR.fit_modes(df.where(F.col("order_id") % 2 == 0), ["shipping_method", "payment_method"])
    return TR.impute(df, modes=modes).groupBy("shipping_method", "payment_method").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_orders")
def q_canonical_orders(spark, sf_dir):
    """TR14 (PR2, PR4, PR6-PR8, TR1, TR3, TR4): per canonical column
    aggregates after mapping, defaults, coercion, clipping and clean-up."""
    canon, _, _ = _canonical(spark, sf_dir)
    items = []
    for c in K.CANONICAL_NUMERIC:
        items.append(F.struct(F.lit(c).alias("feature"), F.count(F.col(c)).alias("n"),
                              F.round(F.min(c), 6).alias("min_value"), F.round(F.max(c), 6).alias("max_value"),
                              F.round(F.avg(c), 6).alias("mean_value"),
                              F.lit(None).cast("bigint").alias("n_distinct")))
    for c in K.CANONICAL_CATEGORICAL:
        items.append(F.struct(F.lit(c).alias("feature"), F.count(F.col(c)).alias("n"),
                              F.lit(None).cast("double").alias("min_value"),
                              F.lit(None).cast("double").alias("max_value"),
                              F.lit(None).cast("double").alias("mean_value"),
                              F.count_distinct(F.col(c)).alias("n_distinct")))
    items.append(F.struct(F.lit("target").alias("feature"), F.sum("target").cast("bigint").alias("n"),
                          F.lit(None).cast("double").alias("min_value"),
                          F.lit(None).cast("double").alias("max_value"),
                          F.round(F.avg("target"), 6).alias("mean_value"),
                          F.lit(None).cast("bigint").alias("n_distinct")))
    return canon.agg(F.array(*items).alias("a")).select(F.explode("a").alias("kv")).select("kv.*")


@query("impute_median")
def q_impute_median(spark, sf_dir):
    """TR5/TR7 statistics: exact median per numeric column."""
    df = order_lines(spark, sf_dir)
    numeric = ["item_price", "order_quantity", "customer_age", "discount", "delivery_days", "product_rating"]
    return TR.median_table(df, numeric)


@query("impute_mode")
def q_impute_mode(spark, sf_dir):
    """TR6/TR8 statistics: most frequent value per text column (ties: smallest)."""
    df = order_lines(spark, sf_dir)
    return TR.mode_table(df, ["product_category", "customer_location", "payment_method", "shipping_method"])


@query("impute_apply")
def q_impute_apply(spark, sf_dir):
    """TR15 applied: per column, rows, NULLs left and the filled sum."""
    df = order_lines(spark, sf_dir)
    prepared, _ = TR.prepare_for_scoring(df)
    num = ["item_price", "order_quantity", "customer_age", "discount", "delivery_days", "product_rating"]
    items = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"),
                      F.round(F.sum(column_to_double(prepared, c)), 6).alias("total"))
             for c in num]
    return prepared.agg(F.array(*items).alias("a")).select(F.explode("a").alias("kv")).select("kv.*")


@query("standard_scale")
def q_standard_scale(spark, sf_dir):
    """TR9: mean and population std per numeric column, and the scaled
    column's range."""
    df = order_lines(spark, sf_dir)
    num = ["item_price", "order_quantity", "customer_age", "discount", "delivery_days", "product_rating"]
    stats = TR.fit_scaler(df, num)
    scaled = TR.scale(df.select(*num), stats)
    items = [F.struct(F.lit(c).alias("column"),
                      F.lit(round(stats[c][0], 6)).alias("mean"),
                      F.lit(round(stats[c][1], 6)).alias("std"),
                      F.round(F.min(c), 6).alias("scaled_min"),
                      F.round(F.max(c), 6).alias("scaled_max")) for c in num]
    return scaled.agg(F.array(*items).alias("a")).select(F.explode("a").alias("kv")).select("kv.*")


@query("label_encode")
def q_label_encode(spark, sf_dir):
    """TR10: sorted distinct values → codes 0..k-1, per text column."""
    df = order_lines(spark, sf_dir)
    return TR.fit_label_encoder(df, ["product_category", "customer_location", "payment_method",
                                     "shipping_method"])


@query("label_encode_unseen")
def q_label_encode_unseen(spark, sf_dir):
    """TR11: an encoder fitted on supplier nations applied to customer
    nations; nations no supplier has get code 0 (the first class)."""
    sup = table(spark, sf_dir, "supplier", ["s_nationkey"])
    na = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    supplier_nations = sup.join(na, sup.s_nationkey == na.n_nationkey).select(
        F.col("n_name").alias("customer_location"))
    enc = TR.fit_label_encoder(supplier_nations, ["customer_location"])
    lines = order_lines(spark, sf_dir).select("customer_location")
    coded = TR.label_encode(lines.withColumn("raw", F.col("customer_location")), enc,
                            ["customer_location"], unseen="first")
    return (coded.groupBy(F.col("customer_location").alias("code"), F.col("raw").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# SO: splits
# ---------------------------------------------------------------------------


@query("split_80_20")
def q_split(spark, sf_dir):
    df = SP.split_train_test(_actual(order_lines(spark, sf_dir)), ["order_id", "line_no"])
    return SP.split_report(df, "actual", "part")


@query("split_stratified")
def q_split_stratified(spark, sf_dir):
    """SO3 with exact shares of each class."""
    df = SP.split_stratified(_actual(order_lines(spark, sf_dir)), ["order_id", "line_no"], "actual")
    return SP.split_report(df, "actual", "part")


@query("folds_5")
def q_folds(spark, sf_dir):
    df = SP.assign_folds(_actual(order_lines(spark, sf_dir)), ["order_id", "line_no"], 5)
    return df.groupBy(F.col("fold"), F.col("actual").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# SF1 formatting
# ---------------------------------------------------------------------------


@query("format_rates")
def q_format_rates(spark, sf_dir):
    """SF1: per shipping method, predicted return rate as '12.34%' and mean
    probability as '0.123' beside the raw doubles."""
    scored = S.score_production(order_lines(spark, sf_dir), keep=["shipping_method"])
    g = scored.groupBy("shipping_method").agg(F.avg(F.col("Prediction").cast("double")).alias("rate"),
                                              F.avg("Return_Probability").alias("mean_p"))
    return g.select("shipping_method", FM.percent(F.col("rate")).alias("return_rate"),
                    FM.fixed(F.col("mean_p"), 3).alias("avg_probability"),
                    F.round("rate", 6).alias("rate"), F.round("mean_p", 6).alias("mean_p"))


@query("format_summary")
def q_format_summary(spark, sf_dir):
    """SF1: the dataset summary as display text: counts, rate, money, days."""
    return order_lines(spark, sf_dir).agg(
        FM.thousands(F.count(F.lit(1))).alias("total_records"),
        FM.percent(F.avg((F.col("return_status") == "Returned").cast("double"))).alias("return_rate"),
        FM.money(F.avg("item_price")).alias("avg_price"),
        FM.money(F.round(F.sum("item_price"), 2), thousands=True).alias("total_price"),
        FM.fixed(F.avg("product_rating"), 1).alias("avg_rating"),
        FM.days(F.avg("delivery_days")).alias("avg_delivery_time"))


# ---------------------------------------------------------------------------
# X1 / X2 extensions
# ---------------------------------------------------------------------------


@query("customer_history")
def q_customer_history(spark, sf_dir):
    """X1: each line with the customer's orders, lines and return rate from
    strictly earlier order dates."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    od = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"), (F.col("l_returnflag") == "R").cast("int").alias("actual"))
    h = HI.with_history(lines)
    return h.select("order_id", "line_no", "prior_orders", "prior_lines",
                    F.round("prior_return_rate", 6).alias("prior_return_rate"))


@query("stream_window_rates")
def q_stream_window_rates(spark, sf_dir):
    """X2: order lines arrive in four slices of order dates and are scored as a
    stream with frozen batch medians; counts per 30-day window are appended to a
    Parquet table as the watermark closes windows."""
    from ..streaming import stream as ST
    return ST.arriving_window_rates(spark, sf_dir, slices=4)


# ---------------------------------------------------------------------------
# ML: models.  SQL cannot fit them; what they must satisfy is compared.
# ---------------------------------------------------------------------------

_NUM = ["product_price", "order_quantity", "customer_age", "discount", "delivery_time", "product_rating"]
_CAT = ["product_category", "customer_location", "payment_method", "shipping_method"]


def _model_table(spark, sf_dir) -> DataFrame:
    """Canonical features with their train/test part, stored once in the
    shared checkpoint folder: the preparation statistics, every pipeline
    stage, each optimiser iteration and the evaluations read the stored
    table instead of re-running the joins."""
    from ..session import materialize
    canon, _, _ = _canonical(spark, sf_dir)
    return materialize(SP.split_train_test(canon, ["order_id", "line_no"]))


FIT_ROWS = 5_000    # labelled rows that cross_validation and feature_importance fit on


@query("model_train_evaluate")
def q_model_train_evaluate(spark, sf_dir):
    """ML1 + ML7 + SC13: balanced logistic regression fitted on four folds of
    the train part, its threshold tuned on the fifth, evaluated on train and
    test rows: rows and returns as its confusion cells count them, and whether
    each metric is a share."""
    data = _model_table(spark, sf_dir)
    train, test = data.where(F.col("part") == "train"), data.where(F.col("part") == "test")
    folds = SP.assign_folds(train, ["order_id", "line_no"], 5)
    model = ML.fit(folds.where("fold > 0"), _NUM, _CAT, "target", kind="lr", threshold="youden",
                   tune_on=folds.where("fold = 0"), balanced=True, C=1.0)
    report = ML.evaluate_model(model, train, "target", "train").unionByName(ML.evaluate_model(model, test, "target", "test"))
    shares = F.array("accuracy", "precision", "recall", "f1", "auc")
    return report.select("split", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
                         (F.col("fn") + F.col("tp")).alias("returns"),
                         F.forall(shares, lambda x: (x >= 0) & (x <= 1)).cast("int").alias("metrics_are_shares"))


@query("lr_mean_probability")
def q_lr_mean_probability(spark, sf_dir):
    """ML1 + SC13 + AG14: without a penalty, logistic regression's mean
    probability is the mean target of the rows it is fitted on; with balanced
    weights the weighted mean is one half."""
    train = _model_table(spark, sf_dir).where(F.col("part") == "train")
    plain = ML.fit(train, _NUM, _CAT, "target", kind="lr").score(train)
    even = SP.with_class_weight(ML.fit(train, _NUM, _CAT, "target", kind="lr", balanced=True).score(train), "target")
    return (plain.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("p"), 3).alias("mean_probability"))
            .join(even.agg(F.round(F.sum(F.col("p") * F.col("weight")) / F.sum("weight"), 3).alias("balanced_mean"))))


@query("one_hot_sums")
def q_one_hot_sums(spark, sf_dir):
    """TR12 + TR13: an encoder fitted on all lines with some shipping methods,
    applied to all lines: rows in each slot, unknown values in none."""
    from ..session import materialize
    canon, _, _ = _canonical(spark, sf_dir)
    lines = materialize(canon.select("shipping_method", "payment_method"))
    prep, encoder = ML.fit_one_hot(lines.where("shipping_method < '4'"), ["shipping_method", "payment_method"])
    return ML.one_hot_sums(prep, encoder, lines)


@query("model_persistence")
def q_model_persistence(spark, sf_dir):
    """IO3 + IO4: fit, save under the shared checkpoint folder, load: the
    loaded model scores every row of the test part as the fitted one did."""
    from ..session import scratch_path
    data = _model_table(spark, sf_dir)
    model = ML.fit(data.where(F.col("part") == "train"), _NUM, _CAT, "target", kind="lr")
    path = scratch_path(spark, "models")
    ML.save(model, path)
    both = ML.load(path).score(model.score(data.where(F.col("part") == "test"), "p"), "again")
    scored = both.agg(F.count("p").alias("scored_rows"), F.count_if(~F.col("p").eqNullSafe(F.col("again"))).alias("differing_rows"))
    return ML.model_info(path).join(scored)


@query("cross_validation")
def q_cross_validation(spark, sf_dir):
    """ML4 + ML5 + SO4: the whole logistic regression grid (6 candidates) over
    5 folds of the train part, preparation and weights fitted inside each fold,
    on at most ``FIT_ROWS`` labelled rows: fits and shares among the scores."""
    data = ML.bounded(_model_table(spark, sf_dir).where(F.col("part") == "train"), ["order_id", "line_no"], FIT_ROWS)
    scores = ML.cross_validate(SP.assign_folds(data, ["order_id", "line_no"], 5), _NUM, _CAT, "target", kind="lr",
                               grid=ML.GRIDS["lr"], balanced=True)
    return scores.groupBy("fold").agg(F.count_distinct("params").alias("candidates"),
                                      F.count_if(F.col("score").between(0, 1)).alias("scores"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """ML2 + AG22: a random forest (100 trees, depth 10) on at most ``FIT_ROWS``
    labelled rows; its importances are one share for each feature."""
    data = ML.bounded(_model_table(spark, sf_dir).where(F.col("part") == "train"), ["order_id", "line_no"], FIT_ROWS)
    model = ML.fit(data, _NUM, _CAT, "target", kind="rf", balanced=True, numTrees=100, maxDepth=10)
    top = ML.feature_importance(model, 10)
    return top.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 4).alias("total"),
                   F.count_if(F.col("importance") < 0).alias("negative"))


@query("fold_statistics")
def q_fold_statistics(spark, sf_dir):
    """SO4 + TR5-TR9: the preparation that each of 5 folds trains with, of all
    lines, from one table of counts."""
    canon, _, _ = _canonical(spark, sf_dir)
    stats = SE.fold_statistics(SP.assign_folds(canon, ["order_id", "line_no"], 5), _NUM, _CAT)
    return stats.select("fold", "column", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")], "mode")


@query("score_equations")
def q_score_equations(spark, sf_dir):
    """ML1: the score equations of an unpenalised regression, plain and with
    balanced weights, fitted on the train part: all are zero."""
    canon, _, _ = _canonical(spark, sf_dir)
    train = SP.split_train_test(canon, ["order_id", "line_no"]).where(F.col("part") == "train")
    equations = SE.score_equations(train, _NUM, _CAT, "target", (False, True))     # stores what it reads of the train part
    return equations.select("balanced", "feature", "rows", (F.round("residual", 4) + F.lit(0.0)).alias("residual"))


@query("saturated_cross_validation")
def q_saturated_cross_validation(spark, sf_dir):
    """ML5: cross-validated F1 of a balanced regression on one category, whose
    probabilities are the categories' weighted shares: by single fits, and by the
    fits of all folds in one scan."""
    train = SP.assign_folds(_model_table(spark, sf_dir).where(F.col("part") == "train"), ["order_id", "line_no"], 5)
    single = ML.cross_validate(train, [], ["customer_location"], "target", "lr", balanced=True)
    together = SE.cross_validate_regressions(train, [], ["customer_location"], "target", balanced=True)
    return single.withColumn("way", F.lit("single")).unionByName(together.withColumn("way", F.lit("together"))).select(
        "way", F.col("fold").cast("int").alias("fold"), F.round("score", 6).alias("f1"))


@query("saturated_report")
def q_saturated_report(spark, sf_dir):
    """ML7: train and test report, cross-validated accuracy included, of a
    balanced regression on one category."""
    _, report = ML.train_test_report(_model_table(spark, sf_dir), [], ["customer_location"], "target", ["order_id", "line_no"], "lr")
    spread = [F.round(c, 4).alias(c) for c in ("probability_mean", "probability_std", "probability_min", "probability_max", "cv_accuracy", "cv_spread")]
    return report.select("kind", "split", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")], *spread)


@query("model_batch_report")
def q_model_batch_report(spark, sf_dir):
    """SC13 with SC6, SC7, SC10, AG6-AG9 and AG2: a balanced regression on one
    category, fitted on the train lines and tuned on the test lines, over all
    lines: the results by category beside the report on them."""
    data = _model_table(spark, sf_dir)
    model = ML.fit(data.where(F.col("part") == "train"), [], ["customer_location"], "target", "lr", threshold="youden",
                   tune_on=data.where(F.col("part") == "test"), balanced=True)
    results, report = S.model_report(data.select("customer_location", *_NUM, "target"), model, "target")
    per = results.groupBy("customer_location", "Prediction_Label", "Confidence_Level").agg(
        F.count("*").alias("rows"), F.sum("target").cast("bigint").alias("returns"), F.round(F.avg("Return_Probability"), 4).alias("p"))
    inexact = ["threshold", "probability_mean", "probability_std", "probability_min", "probability_max"]
    return per.join(report.drop("leakage_columns").withColumns({c: F.round(c, 4) for c in inexact}))     # one row of report


@query("single_split_trees")
def q_single_split_trees(spark, sf_dir):
    """ML2 + ML3 + AG22 + SC13: a forest of one tree and one round of boosting,
    both of depth 1, fitted on all train lines: the feature with all the importance,
    and the lines and returns of each leaf of all lines, with its probability."""
    data = _model_table(spark, sf_dir)
    train, out = data.where(F.col("part") == "train"), None
    for kind, size in (("rf", {"numTrees": 1, "bootstrap": False}), ("gbt", {"maxIter": 1, "subsamplingRate": 1.0})):
        model = ML.fit(train, ["discount", "delivery_time", "product_rating"], [], "target", kind, maxDepth=1,
                       balanced=kind in ML.BALANCED, **size)
        top = ML.feature_importance(model, 1).select("feature", "importance")
        leaves = model.score(data).groupBy(F.round("p", 6).alias("p")).agg(F.count("*").alias("rows"), F.sum("target").cast("bigint").alias("returns"))
        rows = leaves.join(top).select(F.lit(kind).alias("kind"), "feature", "importance", "p", "rows", "returns")
        out = rows if out is None else out.unionAll(rows)
    return out


GRID_ROWS = 500     # labelled rows that the grid is searched on


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """ML4: the 24 forests and 6 regressions of the grid over 5 folds, ranked by
    mean F1, on at most ``GRID_ROWS`` labelled rows: 10 forests are fitted, whose
    prefixes are the 120, and 30 regressions side by side.  The 12 boosted
    candidates are left to ``search.grid_search`` (README: 6 fits a fold, of 200
    rounds each)."""
    data = ML.bounded(_model_table(spark, sf_dir).where(F.col("part") == "train"), ["order_id", "line_no"], GRID_ROWS)
    grids = {kind: ML.GRIDS[kind] for kind in ("rf", "lr")}
    return SE.grid_search(SP.assign_folds(data, ["order_id", "line_no"], 5), _NUM, _CAT, "target", grids, parallelism=8)


@query("streamed_history")
def q_streamed_history(spark, sf_dir):
    """X1 on a stream: lines arrive in three slices of order dates; one in 97 of
    the first slice comes with the last and is late.  Each customer's history
    before every day, its counted lines and its late ones."""
    from ..streaming import history as SH
    return SH.arriving_history(spark, sf_dir, slices=3)


@query("reloaded_model")
def q_reloaded_model(spark, sf_dir):
    """SC13 on X2: two models of the returns by location, fitted on the lines
    before 1997 and before 1999; the stream scores the lines before 1997 with the
    first and, once the second is published, the others with that."""
    from ..session import materialize
    from ..streaming import serving as SV
    lines = materialize(order_lines_with_dates(spark, sf_dir).select(
        "customer_location", (F.col("return_status") == "Returned").cast("int").alias("target"), "order_date"))
    models = [ML.fit(lines.where(F.col("order_date") < F.lit(day).cast("date")), [], ["customer_location"], "target", "lr") for day in ("1997-01-01", "1999-01-01")]
    early = F.col("order_date") < F.lit("1997-01-01").cast("date")
    out = SV.reloaded_scores(lines, [(lines.where(early), models[0]), (lines.where(~early), models[1])])
    return out.groupBy("version", "customer_location").agg(
        F.count("*").alias("rows"), F.sum("target").cast("bigint").alias("returns"), F.round(F.avg("p"), 4).alias("p"))


@query("selection_ties")
def q_selection_ties(spark, sf_dir):
    """ML6: the choice among score columns of a table by F1 at fixed
    thresholds; two are equal, and the earlier or the preferred one wins."""
    canon, _, _ = _canonical(spark, sf_dir)
    rating, price = F.coalesce("product_rating", F.lit(3.0)), F.coalesce("product_price", F.lit(0.0))
    scored = canon.select("target", (rating / 5).alias("rating"), (1 - rating / 5).alias("low_rating"),
                          (price / 1000).alias("price"), (rating / 5).alias("rating_again"))
    table = ML.compare_scores(scored, ["price", "rating", "low_rating", "rating_again"], "target", 0.5)
    return table.withColumns({"chosen": F.lit(ML.choose(table)), "preferred": F.lit(ML.choose(table, prefer="rating_again"))})


@query("model_selection")
def q_model_selection(spark, sf_dir):
    """ML1-ML3 + ML6 + ML7: boosted trees, random forest and logistic
    regression with their production settings, fitted on four folds of the whole
    train part, where trees may cut told by all its rows; thresholds are tuned on
    the fifth, models compared on the whole test part."""
    data = _model_table(spark, sf_dir)
    folds = SP.assign_folds(data.where(F.col("part") == "train"), ["order_id", "line_no"], 5)
    fitted_on, tuned_on = folds.where("fold > 0"), folds.where("fold = 0")
    ML.check_categories(fitted_on, _CAT)
    prep = ML.fit_prep(fitted_on, _NUM, _CAT)       # once for all three
    models = [(kind, ML.fit(fitted_on, _NUM, _CAT, "target", kind=kind, threshold="youden", tune_on=tuned_on,
                            balanced=kind in ML.BALANCED, prep=prep, whole_cuts=True, **ML.PRODUCTION[kind]))
              for kind in ("rf", "gbt", "lr")]
    best, _, table = ML.select_model(models, data.where(F.col("part") == "test"), "target")
    return table.withColumn("chosen", (F.col("split") == best).cast("int"))
