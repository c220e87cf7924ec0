"""DuckDB SQL for each registered query (same names, same column names).

Written by hand from the operator definitions, independently of the Spark
code path; they share only the ``order_lines`` view text.  Doubles that come
out of sums are rounded to 6 places on both sides.
"""

from __future__ import annotations

from .views import with_order_lines

# Plain rules (SC1) over order_lines: item_price → price family, customer_age
# → age family, product_rating → rating family, folded in column order.
_PLAIN_P = """
GREATEST(0.05::DOUBLE, LEAST(0.95::DOUBLE,
  0.3::DOUBLE
  + CASE WHEN item_price > 100 THEN 0.2::DOUBLE WHEN item_price < 20 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN customer_age < 25 OR customer_age > 65 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN product_rating < 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END))"""

_BANDS6 = """CASE WHEN p > 0.8 THEN 'Very High' WHEN p > 0.7 THEN 'High' WHEN p > 0.6 THEN 'Medium-High'
  WHEN p > 0.4 THEN 'Medium' WHEN p > 0.3 THEN 'Medium-Low' ELSE 'Low' END"""
_BANDS7 = """CASE WHEN p > 0.8 THEN 'Very High' WHEN p > 0.7 THEN 'High' WHEN p > 0.6 THEN 'Medium-High'
  WHEN p > 0.4 THEN 'Medium' WHEN p > 0.3 THEN 'Medium-Low' WHEN p > 0.2 THEN 'Low' ELSE 'Very Low' END"""


def _scored(p_sql: str, bands: str, src: str = "order_lines") -> str:
    return f"""scored AS (
  SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred,
         {bands} AS band
  FROM (SELECT *, {p_sql} AS p FROM {src}) s0
)"""


_PER_SCORE = """
SELECT p AS Return_Probability, pred AS Prediction,
       CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label,
       band AS Confidence_Level, COUNT(*) AS n,
       CAST(SUM(CASE WHEN return_status = 'Returned' THEN 1 ELSE 0 END) AS BIGINT) AS returns
FROM scored GROUP BY 1, 2, 3, 4"""

# Medians of the imputed columns (pandas: mean of the two middle values).
_MEDIANS = """med AS (
  SELECT median(item_price) AS m_price, median(customer_age) AS m_age,
         median(delivery_days) AS m_days, median(product_rating) AS m_rating
  FROM order_lines
)"""

_QUICK_P = """
GREATEST(0.05::DOUBLE, LEAST(0.95::DOUBLE,
  0.3::DOUBLE
  + CASE WHEN coalesce(item_price, m_price) > 100 THEN 0.2::DOUBLE
         WHEN coalesce(item_price, m_price) < 20 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN coalesce(customer_age, m_age) < 25 OR coalesce(customer_age, m_age) > 65
         THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN coalesce(product_rating, m_rating) < 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END))"""

# Production rules (SC3) after batch median fill: price family (item_price),
# rating family (product_rating), discount, delivery/shipping (delivery_days;
# shipping_method is text and adds nothing).
_PROD_P = """
GREATEST(0.05::DOUBLE, LEAST(0.95::DOUBLE,
  0.3::DOUBLE
  + CASE WHEN coalesce(item_price, m_price) > 100 THEN 0.2::DOUBLE
         WHEN coalesce(item_price, m_price) < 20 THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN coalesce(product_rating, m_rating) < 3 THEN 0.3::DOUBLE
         WHEN coalesce(product_rating, m_rating) > 4 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN discount > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN delivery_days > 7 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END))"""

ORACLE: dict[str, str] = {}

ORACLE["score_summary"] = with_order_lines(f"""
WITH {_scored(_PLAIN_P, _BANDS6)}
SELECT COUNT(*) AS total_records,
       CAST(SUM(pred) AS BIGINT) AS predicted_returns,
       CAST(COUNT(*) - SUM(pred) AS BIGINT) AS predicted_non_returns,
       round(avg(pred::DOUBLE), 6) AS return_rate,
       round(avg(p), 6) AS avg_probability,
       COUNT(*) FILTER (WHERE p > 0.7) AS high_risk_count,
       COUNT(*) FILTER (WHERE p > 0.3 AND p <= 0.7) AS medium_risk_count,
       COUNT(*) FILTER (WHERE p <= 0.3) AS low_risk_count
FROM scored""")

ORACLE["rule_score_plain"] = with_order_lines(f"WITH {_scored(_PLAIN_P, _BANDS6)}\n{_PER_SCORE}")

ORACLE["rule_score_plain_rows"] = with_order_lines(f"""
WITH {_scored(_PLAIN_P, _BANDS6)}
SELECT order_id, line_no, pred AS Prediction, p AS Return_Probability,
       CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label,
       band AS Confidence_Level
FROM scored""")

ORACLE["rule_score_imputed"] = with_order_lines(
    f"WITH {_MEDIANS},\n{_scored(_QUICK_P, _BANDS6, 'order_lines, med')}\n{_PER_SCORE}")

ORACLE["rule_score_production"] = with_order_lines(
    f"WITH {_MEDIANS},\n{_scored(_PROD_P, _BANDS7, 'order_lines, med')}\n{_PER_SCORE}")

# ---------------------------------------------------------------------------
# Shared pieces for the production scorer and canonical features
# ---------------------------------------------------------------------------

_ACTUAL = "CASE WHEN return_status = 'Returned' THEN 1 ELSE 0 END"

# Production-scored lines: p, pred, band, actual.
_PROD_CTE = f"""{_MEDIANS},
{_scored(_PROD_P, _BANDS7, 'order_lines, med')},
prod AS (SELECT *, {_ACTUAL} AS actual FROM scored)"""

_ROWS = """
SELECT order_id, line_no, pred AS Prediction, p AS Return_Probability,
       CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label,
       band AS Confidence_Level
FROM scored"""

ORACLE["rule_score_production_rows"] = with_order_lines(f"WITH {_PROD_CTE}\n{_ROWS}")


def _clip(x: str, lo: float, hi: float) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE LEAST(GREATEST(CAST({x} AS DOUBLE), {lo}::DOUBLE), "
            f"{hi}::DOUBLE) END")


# Canonical features of order_lines (TR14): mapped, coerced, clipped,
# defaults for the unmapped ones, target binarised.
_CANON_CTE = f"""canon AS (
  SELECT order_id, line_no,
    COALESCE(CAST(product_category AS VARCHAR), 'Unknown') AS product_category,
    {_clip('item_price', 1, 1000)} AS product_price,
    {_clip('order_quantity', 1, 100)} AS order_quantity,
    {_clip('customer_age', 18, 100)} AS customer_age,
    COALESCE(customer_location, 'Unknown') AS customer_location,
    COALESCE(payment_method, 'Unknown') AS payment_method,
    COALESCE(shipping_method, 'Unknown') AS shipping_method,
    {_clip('discount', 0, 100)} AS discount,
    {_clip('delivery_days', 1, 30)} AS delivery_time,
    5.0::DOUBLE AS purchase_history_count,
    0.1::DOUBLE AS return_history_rate,
    {_clip('product_rating', 1, 5)} AS product_rating,
    CASE WHEN lower(return_status) IN ('returned', 'return', 'yes', 'true', '1') THEN 1 ELSE 0 END AS target
  FROM order_lines
)"""

_PROPENSITY = """
  0.25::DOUBLE
  + product_price / 2000.0::DOUBLE * 0.2::DOUBLE
  + CASE WHEN product_category IN ('Electronics', 'Clothing', 'Shoes') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.15::DOUBLE
  + delivery_time / 20.0::DOUBLE * 0.2::DOUBLE
  + (5.0::DOUBLE - product_rating) / 4.0::DOUBLE * 0.25::DOUBLE
  + return_history_rate * 0.3::DOUBLE
  + discount / 40.0::DOUBLE * 0.15::DOUBLE
  + CASE WHEN order_quantity > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE
  + CASE WHEN customer_age < 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.05::DOUBLE"""

_PROP_CLAMPED = f"""CASE WHEN ({_PROPENSITY}) IS NULL THEN NULL
  ELSE GREATEST(0.05::DOUBLE, LEAST(0.95::DOUBLE, ({_PROPENSITY}))) END"""

_PROPENSITY_ROOT = """
  0.15::DOUBLE
  + product_price / 500.0::DOUBLE * 0.2::DOUBLE
  + CASE WHEN product_category IN ('Electronics', 'Clothing') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE
  + delivery_time / 15.0::DOUBLE * 0.15::DOUBLE
  + (5.0::DOUBLE - product_rating) / 4.0::DOUBLE * 0.2::DOUBLE
  + return_history_rate * 0.25::DOUBLE
  + discount / 30.0::DOUBLE * 0.1::DOUBLE"""

_PROPENSITY_FLEX = """
  0.35::DOUBLE
  + product_price / 2000.0::DOUBLE * 0.25::DOUBLE
  + CASE WHEN product_category IN ('Electronics', 'Clothing') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.15::DOUBLE
  + delivery_time / 20.0::DOUBLE * 0.2::DOUBLE
  + (5.0::DOUBLE - product_rating) / 4.0::DOUBLE * 0.25::DOUBLE
  + discount / 30.0::DOUBLE * 0.15::DOUBLE"""


def _clamped(expr: str) -> str:
    return f"""CASE WHEN ({expr}) IS NULL THEN NULL
  ELSE GREATEST(0.05::DOUBLE, LEAST(0.95::DOUBLE, ({expr}))) END"""


ORACLE["propensity"] = with_order_lines(f"""
WITH {_CANON_CTE}
SELECT order_id, line_no, {_PROP_CLAMPED} AS propensity,
       {_clamped(_PROPENSITY_ROOT)} AS propensity_root,
       {_clamped(_PROPENSITY_FLEX)} AS propensity_flexible
FROM canon""")

ORACLE["labels_and_bands"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT p AS Return_Probability,
  CASE WHEN p > 0.5 THEN 'Return' ELSE 'Not Return' END AS label,
  CASE WHEN p > 0.8 THEN 'Very High' WHEN p > 0.7 THEN 'High' WHEN p > 0.6 THEN 'Medium-High'
       WHEN p > 0.4 THEN 'Medium' WHEN p > 0.3 THEN 'Medium-Low' ELSE 'Low' END AS confidence6,
  {_BANDS7} AS confidence7,
  CASE WHEN abs(p - 0.5) < 0.1 THEN 'Very High' WHEN abs(p - 0.5) < 0.2 THEN 'High'
       WHEN abs(p - 0.5) < 0.3 THEN 'Medium-High' WHEN abs(p - 0.5) < 0.4 THEN 'Medium'
       WHEN abs(p - 0.5) < 0.5 THEN 'Medium-Low' ELSE 'Low' END AS confidence_distance,
  CASE WHEN p > 0.7 OR p < 0.3 THEN 'High' ELSE 'Medium' END AS confidence2,
  CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_band,
  COUNT(*) AS n
FROM prod GROUP BY 1, 2, 3, 4, 5, 6, 7""")

ORACLE["probability_distribution"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT round(avg(p), 6) AS probability_mean, round(stddev_pop(p), 6) AS probability_std,
       min(p) AS probability_min, max(p) AS probability_max,
       round(avg(CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_above,
       round(avg(CASE WHEN p < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_below
FROM prod""")

ORACLE["confusion_metrics"] = with_order_lines(f"""
WITH {_PROD_CTE},
cm AS (
  SELECT COUNT(*) FILTER (WHERE actual = 0 AND pred = 0) AS tn,
         COUNT(*) FILTER (WHERE actual = 0 AND pred = 1) AS fp,
         COUNT(*) FILTER (WHERE actual = 1 AND pred = 0) AS fn,
         COUNT(*) FILTER (WHERE actual = 1 AND pred = 1) AS tp,
         round(avg(actual::DOUBLE), 6) AS actual_rate, round(avg(pred::DOUBLE), 6) AS predicted_rate
  FROM prod)
SELECT tn, fp, fn, tp,
  round(COALESCE((tp + tn)::DOUBLE / NULLIF((tn + fp + fn + tp)::DOUBLE, 0), 0), 6) AS accuracy,
  round(COALESCE(tp::DOUBLE / NULLIF((tp + fp)::DOUBLE, 0), 0), 6) AS precision,
  round(COALESCE(tp::DOUBLE / NULLIF((tp + fn)::DOUBLE, 0), 0), 6) AS recall,
  round(COALESCE(2.0 * tp::DOUBLE / NULLIF(2.0 * tp::DOUBLE + fp + fn, 0), 0), 6) AS f1,
  actual_rate, predicted_rate
FROM cm""")


def _auc_sql(src: str, score: str, label: str) -> str:
    return f"""
c AS (SELECT {score} AS score, CAST(SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
      FROM {src} WHERE {score} IS NOT NULL GROUP BY 1),
r AS (SELECT *, SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
      FROM c),
u AS (SELECT CAST(SUM(pos * (2 * (cum_neg - neg) + neg)) AS BIGINT) AS u2,
             CAST(SUM(pos) AS BIGINT) AS P, CAST(SUM(neg) AS BIGINT) AS N FROM r)
SELECT CASE WHEN P > 0 AND N > 0 THEN CAST(u2 AS DOUBLE) / (2.0::DOUBLE * CAST(P AS DOUBLE) * CAST(N AS DOUBLE))
       END AS auc, P AS positives, N AS negatives
FROM u"""


ORACLE["roc_auc"] = with_order_lines(f"WITH {_PROD_CTE},\n{_auc_sql('prod', 'p', 'actual')}")

ORACLE["roc_auc_propensity"] = with_order_lines(f"""
WITH {_CANON_CTE},
sc AS (SELECT {_PROP_CLAMPED} AS s, target FROM canon),
{_auc_sql('sc', 's', 'target')}""")

_ROC_CTE = """
c AS (SELECT p AS score, CAST(SUM(actual) AS BIGINT) AS pos, CAST(SUM(1 - actual) AS BIGINT) AS neg
      FROM prod GROUP BY 1),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM c),
roc AS (
  SELECT score,
    CAST(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tps,
    CAST(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fps
  FROM c)"""

ORACLE["roc_curve"] = with_order_lines(f"""
WITH {_PROD_CTE},{_ROC_CTE}
SELECT score, tps, fps, round(tps / CAST(P AS DOUBLE), 6) AS tpr, round(fps / CAST(N AS DOUBLE), 6) AS fpr
FROM roc, t""")

ORACLE["youden_threshold"] = with_order_lines(f"""
WITH {_PROD_CTE},{_ROC_CTE},
j AS (SELECT score, tps / CAST(P AS DOUBLE) - fps / CAST(N AS DOUBLE) AS j FROM roc, t)
SELECT CASE WHEN j > 0 THEN score END AS threshold, round(j, 6) AS youden_j
FROM j ORDER BY j DESC, score DESC LIMIT 1""")

ORACLE["youden_continuous"] = with_order_lines(f"""
WITH {_CANON_CTE},
sc AS (SELECT {_PROP_CLAMPED} AS score, target FROM canon),
c AS (SELECT score, CAST(SUM(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(SUM(CASE WHEN target = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
      FROM sc WHERE score IS NOT NULL GROUP BY 1),
t AS (SELECT CAST(SUM(pos) AS BIGINT) AS P, CAST(SUM(neg) AS BIGINT) AS N FROM c),
roc AS (
  SELECT score,
    CAST(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tps,
    CAST(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fps
  FROM c)
SELECT CASE WHEN tps * N > fps * P THEN score END AS threshold, CASE WHEN tps * N > fps * P THEN tps ELSE 0 END AS tps,
       CASE WHEN tps * N > fps * P THEN fps ELSE 0 END AS fps, P AS positives, N AS negatives
FROM roc, t ORDER BY tps * CAST(N AS HUGEINT) - fps * CAST(P AS HUGEINT) DESC, score DESC LIMIT 1""")

ORACLE["class_weights"] = with_order_lines(f"""
WITH c AS (SELECT {_ACTUAL} AS label, COUNT(*) AS n FROM order_lines GROUP BY 1)
SELECT label, n, round(n / CAST(SUM(n) OVER () AS DOUBLE), 6) AS share,
       round(CAST(SUM(n) OVER () AS DOUBLE) / (COUNT(*) OVER () * n), 6) AS weight
FROM c""")

ORACLE["top_categories"] = with_order_lines("""
SELECT product_category AS value, COUNT(*) AS n FROM order_lines
GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 5""")

ORACLE["category_return_rate"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT product_category AS key, round(avg(pred::DOUBLE), 6) AS mean, COUNT(*) AS n
FROM prod GROUP BY 1 ORDER BY mean DESC, key ASC LIMIT 10""")


def _hist_sql(var: str, col: str, bins: int, src: str) -> str:
    return f"""
SELECT bin, round(lo + bin * ((hi - lo) / {bins}.0::DOUBLE), 6) AS lower,
       round(lo + (bin + 1) * ((hi - lo) / {bins}.0::DOUBLE), 6) AS upper, COUNT(*) AS n,
       '{var}' AS variable
FROM (SELECT LEAST(CAST(floor((CAST({col} AS DOUBLE) - lo) / (hi - lo) * {bins}.0::DOUBLE) AS INTEGER), {bins - 1})
             AS bin, lo, hi
      FROM {src}, (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}) b
      WHERE {col} IS NOT NULL) x
GROUP BY bin, lo, hi"""


ORACLE["histograms"] = with_order_lines(f"""
WITH {_PROD_CTE}
{_hist_sql('price', 'item_price', 20, 'prod')}
UNION ALL {_hist_sql('rating', 'product_rating', 10, 'prod')}
UNION ALL {_hist_sql('probability', 'p', 20, 'prod')}""")

ORACLE["risk_distribution"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_band, COUNT(*) AS n
FROM prod GROUP BY 1""")

ORACLE["dataset_summary"] = with_order_lines(f"""
SELECT COUNT(*) AS total_records, round(avg(({_ACTUAL})::DOUBLE), 6) AS return_rate,
       round(avg(item_price), 6) AS avg_price, round(avg(product_rating), 6) AS avg_rating,
       round(avg(delivery_days::DOUBLE), 6) AS avg_delivery_time
FROM order_lines""")

_VIEW_COLS = ["order_id", "line_no", "customer_id", "product_category", "item_price", "order_quantity",
              "customer_age", "customer_location", "payment_method", "shipping_method", "discount",
              "delivery_days", "product_rating", "return_status"]

ORACLE["distinct_counts"] = with_order_lines("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM order_lines" for c in _VIEW_COLS))

ORACLE["missing_report"] = with_order_lines("\nUNION ALL\n".join(
    [f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing FROM order_lines" for c in _VIEW_COLS]
    + ["SELECT '*' AS \"column\", (" + " + ".join(f"(COUNT(*) - COUNT({c}))" for c in _VIEW_COLS)
       + ") AS missing FROM order_lines"]))

ORACLE["quality_report"] = with_order_lines("""
WITH q AS (SELECT item_price, customer_age, item_price - discount AS net_price,
                  customer_age - 30 AS years_past_age_30 FROM order_lines)
SELECT 'negative_values' AS "check", 'item_price' AS "column", COUNT(*) FILTER (WHERE item_price < 0) AS n FROM q
UNION ALL SELECT 'negative_values', 'net_price', COUNT(*) FILTER (WHERE net_price < 0) FROM q
UNION ALL SELECT 'unreasonable_age', 'customer_age',
  COUNT(*) FILTER (WHERE customer_age < 0 OR customer_age > 120) FROM q
UNION ALL SELECT 'unreasonable_age', 'years_past_age_30',
  COUNT(*) FILTER (WHERE years_past_age_30 < 0 OR years_past_age_30 > 120) FROM q""")

ORACLE["table_counts"] = with_order_lines(
    "SELECT COUNT(*) AS rows, 14 AS columns, CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS is_empty FROM order_lines")


def _detect_sql(limit: int) -> str:
    feats = _VIEW_COLS[:-1]  # return_status is leakage and the target
    numeric = {"order_id", "line_no", "customer_id", "item_price", "order_quantity", "customer_age",
               "discount", "delivery_days", "product_rating"}
    parts = []
    for i, c in enumerate(feats):
        num = f"COUNT({c})" if c in numeric else f"COUNT(TRY_CAST(trim({c}) AS DOUBLE))"
        parts.append(f"""SELECT '{c}' AS "column", {num} AS n_numeric, COUNT(DISTINCT {c}) AS n_distinct,
  CASE WHEN {num} > 0 AND COUNT(DISTINCT {c}) <= {limit} THEN 'numeric' ELSE 'categorical' END AS kind,
  {i} AS position, {limit} AS type_limit FROM order_lines""")
    return "\nUNION ALL\n".join(parts)


ORACLE["detect_types"] = with_order_lines(_detect_sql(10) + "\nUNION ALL\n" + _detect_sql(20))

ORACLE["drop_leakage"] = with_order_lines("""
SELECT order_id, line_no, customer_id, product_category, item_price, order_quantity, customer_age,
       customer_location, payment_method, shipping_method, discount, delivery_days, product_rating,
       CASE WHEN lower(return_status) IN ('returned', 'return', 'yes', 'true', '1') THEN 1 ELSE 0 END AS target
FROM order_lines""")

ORACLE["filtered_results"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT order_id, line_no, customer_id, product_category, item_price, order_quantity, customer_age,
       customer_location, payment_method, shipping_method,
       pred AS Prediction, p AS Return_Probability,
       CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label, band AS Confidence_Level
FROM prod WHERE p >= 0.6 AND pred = 1""")

ORACLE["filtered_download"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT order_id, line_no, customer_id, product_category, item_price, order_quantity, customer_age,
       customer_location, payment_method, shipping_method, discount, delivery_days, product_rating, return_status,
       pred AS Prediction, p AS Return_Probability,
       CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label, band AS Confidence_Level
FROM prod WHERE p >= 0.6 AND pred = 1""")

ORACLE["row_validation"] = """
WITH b AS (
  SELECT l_extendedprice - 2000 AS price, 10 + o_custkey % 63 AS age, p_size % 13 / 2.0 AS rating,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d,
         round(l_discount * 100) * 12 / 100.0 AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
e AS (
  SELECT 'Product price must be greater than 0' AS error FROM b WHERE price <= 0
  UNION ALL SELECT 'Product price seems unusually high' FROM b WHERE price > 10000
  UNION ALL SELECT 'Customer age must be between 18 and 100' FROM b WHERE age < 18 OR age > 100
  UNION ALL SELECT 'Product rating must be between 1 and 5' FROM b WHERE rating < 1 OR rating > 5
  UNION ALL SELECT 'Delivery time must be between 1 and 30 days' FROM b WHERE d < 1 OR d > 30
  UNION ALL SELECT 'Return history rate must be between 0 and 1' FROM b WHERE rate < 0 OR rate > 1
  UNION ALL SELECT NULL FROM b WHERE price > 0 AND price <= 10000 AND age BETWEEN 18 AND 100
    AND rating BETWEEN 1 AND 5 AND d BETWEEN 1 AND 30 AND rate BETWEEN 0 AND 1
)
SELECT error, COUNT(*) AS n FROM e GROUP BY 1"""

ORACLE["coerce_cells"] = with_order_lines("""
WITH t AS (
  SELECT CAST(order_quantity AS VARCHAR) AS quantity_text,
         ' ' || CAST(discount AS VARCHAR) || ' ' AS discount_text,
         item_price, shipping_method, CAST(discount AS VARCHAR) || '%' AS discount_pct
  FROM order_lines)
SELECT 'quantity_text' AS "column", COUNT(TRY_CAST(trim(quantity_text) AS DOUBLE)) AS n_numeric,
       round(SUM(TRY_CAST(trim(quantity_text) AS DOUBLE)), 6) AS total,
       CASE WHEN COUNT(quantity_text) = COUNT(TRY_CAST(trim(quantity_text) AS DOUBLE)) THEN 1 ELSE 0 END AS converts
FROM t
UNION ALL SELECT 'discount_text', COUNT(TRY_CAST(trim(discount_text) AS DOUBLE)),
       round(SUM(TRY_CAST(trim(discount_text) AS DOUBLE)), 6),
       CASE WHEN COUNT(discount_text) = COUNT(TRY_CAST(trim(discount_text) AS DOUBLE)) THEN 1 ELSE 0 END FROM t
UNION ALL SELECT 'price_text', COUNT(item_price), round(SUM(item_price), 6), 1 FROM t
UNION ALL SELECT 'shipping_method', COUNT(TRY_CAST(trim(shipping_method) AS DOUBLE)),
       round(SUM(TRY_CAST(trim(shipping_method) AS DOUBLE)), 6),
       CASE WHEN COUNT(shipping_method) = COUNT(TRY_CAST(trim(shipping_method) AS DOUBLE)) THEN 1 ELSE 0 END FROM t
UNION ALL SELECT 'discount_pct', COUNT(TRY_CAST(trim(discount_pct) AS DOUBLE)),
       round(SUM(TRY_CAST(trim(discount_pct) AS DOUBLE)), 6),
       CASE WHEN COUNT(discount_pct) = COUNT(TRY_CAST(trim(discount_pct) AS DOUBLE)) THEN 1 ELSE 0 END FROM t""")

_CANON_NUM = ["product_price", "order_quantity", "customer_age", "discount", "delivery_time",
              "purchase_history_count", "return_history_rate", "product_rating"]
_CANON_CAT = ["product_category", "customer_location", "payment_method", "shipping_method"]

ORACLE["canonical_orders"] = with_order_lines(
    f"WITH {_CANON_CTE}\n" + "\nUNION ALL\n".join(
        [f"""SELECT '{c}' AS feature, COUNT({c}) AS n, round(min({c}), 6) AS min_value,
  round(max({c}), 6) AS max_value, round(avg({c}), 6) AS mean_value, CAST(NULL AS BIGINT) AS n_distinct
FROM canon""" for c in _CANON_NUM]
        + [f"""SELECT '{c}', COUNT({c}), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  COUNT(DISTINCT {c}) FROM canon""" for c in _CANON_CAT]
        + ["""SELECT 'target', CAST(SUM(target) AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  round(avg(target), 6), CAST(NULL AS BIGINT) FROM canon"""]))

_NUM_COLS = ["item_price", "order_quantity", "customer_age", "discount", "delivery_days", "product_rating"]


def _median_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column",
  (MAX(CASE WHEN r = (n - 1) // 2 THEN v END) + MAX(CASE WHEN r = n // 2 THEN v END)) / 2.0::DOUBLE AS median
FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, COUNT(*) OVER () AS n
      FROM (SELECT CAST({c} AS DOUBLE) AS v FROM order_lines WHERE {c} IS NOT NULL) s) x"""


ORACLE["impute_median"] = with_order_lines("\nUNION ALL\n".join(_median_sql(c) for c in _NUM_COLS))

ORACLE["impute_mode"] = with_order_lines("\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS mode, COUNT(*) AS n
  FROM order_lines WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, mode ASC LIMIT 1)"""
    for c in ["product_category", "customer_location", "payment_method", "shipping_method"]))

ORACLE["impute_apply"] = with_order_lines(
    "WITH " + ",\n".join(f"m_{c} AS ({_median_sql(c)})" for c in _NUM_COLS) + "\n" +
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(0 AS BIGINT) AS nulls,
  round(SUM(COALESCE(CAST({c} AS DOUBLE), (SELECT median FROM m_{c}))), 6) AS total FROM order_lines"""
        for c in _NUM_COLS))

ORACLE["standard_scale"] = with_order_lines("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(avg({c}::DOUBLE), 6) AS mean, round(stddev_pop({c}::DOUBLE), 6) AS std,
  round((min({c}::DOUBLE) - avg({c}::DOUBLE)) / stddev_pop({c}::DOUBLE), 6) AS scaled_min,
  round((max({c}::DOUBLE) - avg({c}::DOUBLE)) / stddev_pop({c}::DOUBLE), 6) AS scaled_max
FROM order_lines""" for c in _NUM_COLS))

ORACLE["label_encode"] = with_order_lines("""
WITH d AS (""" + "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM order_lines WHERE {c} IS NOT NULL"
    for c in ["product_category", "customer_location", "payment_method", "shipping_method"]) + """)
SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
FROM d""")

ORACLE["label_encode_unseen"] = with_order_lines("""
WITH enc AS (
  SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey) s)
SELECT COALESCE(enc.code, 0) AS code, o.customer_location AS value, COUNT(*) AS n
FROM order_lines o LEFT JOIN enc ON o.customer_location = enc.value GROUP BY 1, 2""")

_HASH = "('0x' || substr(md5('42:' || order_id || ':' || line_no), 1, 8))::BIGINT"

ORACLE["split_80_20"] = with_order_lines(f"""
SELECT {_ACTUAL} AS label, CASE WHEN {_HASH} % 100 < 20 THEN 'test' ELSE 'train' END AS part, COUNT(*) AS n
FROM order_lines GROUP BY 1, 2""")

ORACLE["folds_5"] = with_order_lines(f"""
SELECT CAST({_HASH} % 5 AS INTEGER) AS fold, {_ACTUAL} AS label, COUNT(*) AS n
FROM order_lines GROUP BY 1, 2""")

ORACLE["format_rates"] = with_order_lines(f"""
WITH {_PROD_CTE},
g AS (SELECT shipping_method, avg(pred::DOUBLE) AS rate, avg(p) AS mean_p FROM prod GROUP BY 1)
SELECT shipping_method, printf('%.2f%%', rate * 100) AS return_rate, printf('%.3f', mean_p) AS avg_probability,
       round(rate, 6) AS rate, round(mean_p, 6) AS mean_p
FROM g""")

ORACLE["customer_history"] = with_order_lines(f"""
WITH ol AS (SELECT order_id, line_no, customer_id, order_date, {_ACTUAL} AS actual FROM order_lines),
daily AS (SELECT customer_id, order_date, COUNT(DISTINCT order_id) AS d_orders, COUNT(*) AS d_lines,
                 SUM(actual) AS d_returns FROM ol GROUP BY 1, 2),
hist AS (
  SELECT customer_id, order_date,
    COALESCE(SUM(d_orders) OVER w, 0) AS prior_orders,
    COALESCE(SUM(d_lines) OVER w, 0) AS prior_lines,
    COALESCE(SUM(d_returns) OVER w, 0) AS prior_returns
  FROM daily
  WINDOW w AS (PARTITION BY customer_id ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ol.order_id, ol.line_no, CAST(prior_orders AS BIGINT) AS prior_orders,
       CAST(prior_lines AS BIGINT) AS prior_lines,
       round(CASE WHEN prior_lines > 0 THEN prior_returns::DOUBLE / prior_lines::DOUBLE END, 6) AS prior_return_rate
FROM ol JOIN hist USING (customer_id, order_date)""")

ORACLE["streamed_history"] = with_order_lines(f"""
WITH span AS (SELECT MIN(order_date) AS lo, date_diff('day', MIN(order_date), MAX(order_date)) + 1 AS days FROM order_lines),
ol AS (SELECT order_id, customer_id, order_date, {_ACTUAL} AS actual,
              date_diff('day', lo, order_date) * 3 // days = 0 AND (order_id + line_no) % 97 = 0 AS late
       FROM order_lines, span),
daily AS (SELECT customer_id, order_date, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS lines, SUM(actual) AS returns
          FROM ol WHERE NOT late GROUP BY 1, 2),
hist AS (
  SELECT customer_id, order_date, lines, COALESCE(SUM(orders) OVER w, 0) AS prior_orders,
    COALESCE(SUM(lines) OVER w, 0) AS prior_lines, COALESCE(SUM(returns) OVER w, 0) AS prior_returns
  FROM daily
  WINDOW w AS (PARTITION BY customer_id ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
arrived AS (SELECT customer_id, order_date, COUNT(*) AS n FROM ol GROUP BY 1, 2)
SELECT customer_id, CAST(date_diff('day', DATE '1970-01-01', order_date) AS BIGINT) AS day,
       CAST(prior_orders AS BIGINT) AS prior_orders, CAST(prior_lines AS BIGINT) AS prior_lines,
       CAST(prior_returns AS BIGINT) AS prior_returns, CAST(COALESCE(lines, 0) AS BIGINT) AS lines,
       CAST(n - COALESCE(lines, 0) AS BIGINT) AS late_lines
FROM arrived LEFT JOIN hist USING (customer_id, order_date)""")

ORACLE["stream_window_rates"] = with_order_lines(f"""
WITH {_MEDIANS},
{_scored(_QUICK_P, _BANDS6, 'order_lines, med')}
SELECT CAST((date_diff('day', DATE '1970-01-01', order_date) // 30) * 30 AS BIGINT) AS window_start_day,
       COUNT(*) AS lines, CAST(SUM(pred) AS BIGINT) AS predicted_returns,
       CAST(SUM({_ACTUAL}) AS BIGINT) AS actual_returns
FROM scored GROUP BY 1""")

def _validation_sql(limit: int) -> str:
    """AG5 over order_lines: only return_status is leakage and target under
    both name rules; no quality issue fires on this view."""
    numeric_cols = ["line_no", "order_quantity", "customer_age", "discount", "delivery_days",
                    "product_rating", "item_price", "order_id", "customer_id"]
    k = " + ".join(f"CASE WHEN COUNT(DISTINCT {c}) <= {limit} THEN 1 ELSE 0 END" for c in numeric_cols)
    missing = " - ".join(f"COUNT({c})" for c in _VIEW_COLS)
    return with_order_lines(f"""
SELECT 'rows' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(COUNT(*) AS VARCHAR) AS value, 'info' AS severity
FROM order_lines
UNION ALL SELECT 'columns', NULL, '14', 'info'
UNION ALL SELECT 'missing_values', NULL, CAST(COUNT(*) * 14 - {missing} AS VARCHAR), 'warning' FROM order_lines
UNION ALL SELECT 'leakage_column', 'return_status', 'removed before scoring', 'warning'
UNION ALL SELECT 'target_column', 'return_status', 'compared with predictions', 'warning'
UNION ALL SELECT 'numeric_features', NULL, CAST({k} AS VARCHAR), 'info' FROM order_lines
UNION ALL SELECT 'categorical_features', NULL, CAST(13 - ({k}) AS VARCHAR), 'info' FROM order_lines""")


ORACLE["validation_report"] = _validation_sql(10)
ORACLE["ultra_validation"] = _validation_sql(20)

ORACLE["csv_round_trip"] = with_order_lines(f"""
WITH {_scored(_PLAIN_P, _BANDS6)}
SELECT band AS Confidence_Level, COUNT(*) AS n, COUNT(item_price) AS priced,
       CAST(SUM(pred) AS BIGINT) AS predicted_returns, round(SUM(p), 6) AS probability_sum
FROM scored GROUP BY 1""")

ORACLE["round_half_even"] = with_order_lines("""
SELECT product_rating AS rating, round_even(product_rating, 0) AS rounded, COUNT(*) AS n
FROM order_lines GROUP BY 1, 2""")

ORACLE["relevant_columns"] = with_order_lines(
    "SELECT item_price, customer_age, delivery_days, product_rating FROM order_lines")

ORACLE["tuned_decisions"] = with_order_lines(f"""
WITH {_CANON_CTE},
sc AS (SELECT {_PROP_CLAMPED} AS p, target FROM canon),
c AS (SELECT p AS score, CAST(SUM(target) AS BIGINT) AS pos, CAST(SUM(1 - target) AS BIGINT) AS neg
      FROM sc WHERE p IS NOT NULL GROUP BY 1),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM c),
roc AS (
  SELECT score,
    SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
    SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps
  FROM c),
j AS (SELECT score, tps / CAST(P AS DOUBLE) - fps / CAST(N AS DOUBLE) AS j FROM roc, t),
best AS (SELECT CASE WHEN j > 0 THEN score END AS thr FROM j ORDER BY j DESC, score DESC LIMIT 1),
d AS (
  SELECT sc.*, thr, CASE WHEN thr IS NOT NULL AND p >= thr THEN 1 ELSE 0 END AS pred,
         abs(p - COALESCE(thr, 0.5)) AS dist
  FROM sc, best)
SELECT pred AS Prediction, CASE WHEN pred = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label,
  CASE WHEN dist < 0.1 THEN 'Very High' WHEN dist < 0.2 THEN 'High' WHEN dist < 0.3 THEN 'Medium-High'
       WHEN dist < 0.4 THEN 'Medium' WHEN dist < 0.5 THEN 'Medium-Low' ELSE 'Low' END AS Confidence_Level,
  COUNT(*) AS n, COUNT(p) AS scored, CAST(SUM(target) AS BIGINT) AS returns, MAX(thr) AS threshold
FROM d GROUP BY 1, 2, 3""")

ORACLE["csv_quoted_round_trip"] = """
WITH t AS (SELECT *, CASE WHEN c_custkey % 5 > 0 THEN
  ' "' || c_name || '", ' || c_mktsegment || chr(10) || 'line 2, ' || chr(92) || ' end'
  || CASE WHEN c_custkey % 3 = 0 THEN '"' ELSE ' ' END END AS note FROM customer)
SELECT c_custkey, c_mktsegment, note, length(note) AS note_length, c_acctbal FROM t"""

ORACLE["drop_identifiers"] = with_order_lines("SELECT line_no, discount, shipping_method FROM order_lines")

ORACLE["replace_stale_results"] = ORACLE["rule_score_plain_rows"]

ORACLE["canonical_partial_names"] = with_order_lines("""
SELECT product_category, item_price AS product_price, customer_age, product_rating,
       0.1::DOUBLE AS return_history_rate, 5.0::DOUBLE AS purchase_history_count FROM order_lines""")

ORACLE["scoring_columns_fallback"] = with_order_lines("SELECT order_quantity, discount, line_no FROM order_lines")

_OUT = {"product_price": "item_price * 20 - 200", "customer_age": "customer_age * 2 - 30", "order_quantity": "order_quantity * 4 - 20",
        "discount": "discount * 15 - 10", "delivery_time": "delivery_days * 2 - 5", "product_rating": "product_rating * 1.5 - 1"}
_LIMITS = {"product_price": (1, 1000), "customer_age": (18, 100), "order_quantity": (1, 100), "discount": (0, 100),
           "delivery_time": (1, 30), "product_rating": (1, 5)}
ORACLE["clip_ranges"] = with_order_lines("SELECT order_id, line_no, " + ", ".join(
    f"CASE WHEN {x} IS NULL THEN NULL ELSE LEAST(GREATEST({x}, {_LIMITS[c][0]}), {_LIMITS[c][1]}) END AS {c}"
    for c, x in _OUT.items()) + " FROM order_lines")


def _gaps(c: str, nan: bool) -> str:
    mark = f"(order_id + length({c})) % 7"
    return f"CASE WHEN {mark} = 0 THEN NULL" + (f" WHEN {mark} = 1 THEN 'nan'" if nan else "") + f" ELSE {c} END AS {c}"


ORACLE["clean_categories"] = with_order_lines(f"""
WITH g AS (SELECT {_gaps('shipping_method', True)}, {_gaps('payment_method', True)} FROM order_lines)
SELECT CASE WHEN shipping_method IS NULL OR shipping_method = 'nan' THEN 'Unknown' ELSE shipping_method END AS shipping_method,
       CASE WHEN payment_method IS NULL OR payment_method = 'nan' THEN 'Unknown' ELSE payment_method END AS payment_method, COUNT(*) AS n
FROM g GROUP BY 1, 2""")


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM g WHERE order_id % 2 = 0 AND {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


ORACLE["impute_mode_apply"] = with_order_lines(f"""
WITH g AS (SELECT order_id, {_gaps('shipping_method', False)}, {_gaps('payment_method', False)} FROM order_lines)
SELECT coalesce(shipping_method, {_mode('shipping_method')}) AS shipping_method,
       coalesce(payment_method, {_mode('payment_method')}) AS payment_method, COUNT(*) AS n
FROM g GROUP BY 1, 2""")

_PART = f"CASE WHEN {_HASH} % 100 < 20 THEN 'test' ELSE 'train' END"

ORACLE["split_stratified"] = with_order_lines(f"""
WITH h AS (SELECT {_ACTUAL} AS label, {_HASH} AS h FROM order_lines),
n AS (SELECT label, COUNT(*) * 20 // 100 AS k FROM h GROUP BY 1),
r AS (SELECT label, h, row_number() OVER (PARTITION BY label ORDER BY h) AS i FROM h),
cut AS (SELECT r.label, h AS cut FROM r JOIN n ON r.label = n.label AND i = k)
SELECT h.label, CASE WHEN h.h <= cut THEN 'test' ELSE 'train' END AS part, COUNT(*) AS n
FROM h LEFT JOIN cut ON h.label = cut.label GROUP BY 1, 2""")

ORACLE["format_summary"] = with_order_lines(f"""
SELECT format('{{:,}}', COUNT(*)) AS total_records, printf('%.2f%%', avg(({_ACTUAL})::DOUBLE) * 100) AS return_rate,
       '$' || printf('%.2f', avg(item_price)) AS avg_price,
       '$' || format('{{:,}}', CAST(floor(round(SUM(item_price), 2)) AS BIGINT))
           || substr(printf('%.2f', round(SUM(item_price), 2) - floor(round(SUM(item_price), 2))), 2) AS total_price,
       printf('%.1f', avg(product_rating)) AS avg_rating, printf('%.1f', avg(delivery_days)) || ' days' AS avg_delivery_time
FROM order_lines""")

# What fitted models must satisfy, whatever their coefficients.
ORACLE["model_train_evaluate"] = with_order_lines(f"""
WITH {_CANON_CTE}
SELECT {_PART} AS split, COUNT(*) AS rows, CAST(SUM(target) AS BIGINT) AS returns, 1 AS metrics_are_shares FROM canon GROUP BY 1""")

ORACLE["lr_mean_probability"] = with_order_lines(f"""
WITH {_CANON_CTE}
SELECT COUNT(*) AS rows, round(avg(target), 3) AS mean_probability, 0.5::DOUBLE AS balanced_mean FROM canon WHERE {_PART} = 'train'""")

ORACLE["one_hot_sums"] = with_order_lines("""
SELECT 'shipping_method' AS "column", CASE WHEN shipping_method < '4' THEN shipping_method END AS value, COUNT(*) AS n
FROM order_lines GROUP BY 1, 2
UNION ALL
SELECT 'payment_method', CASE WHEN payment_method IN (SELECT payment_method FROM order_lines WHERE shipping_method < '4')
       THEN payment_method END, COUNT(*) FROM order_lines GROUP BY 1, 2""")

ORACLE["model_persistence"] = with_order_lines(f"""
SELECT 'lr' AS model_type, 0.5::DOUBLE AS threshold, 6 AS numeric_features, 4 AS categorical_features, 'target' AS target,
       COUNT(*) AS scored_rows, 0 AS differing_rows FROM order_lines WHERE {_PART} = 'test'""")

ORACLE["cross_validation"] = with_order_lines(f"SELECT {_HASH} % 5 AS fold, 6 AS candidates, 6 AS scores FROM order_lines GROUP BY 1")

ORACLE["feature_importance"] = with_order_lines(
    "SELECT 10 AS features, 1.0::DOUBLE AS total, 0 AS negative FROM order_lines LIMIT 1")

_NUMERIC = ["product_price", "order_quantity", "customer_age", "discount", "delivery_time", "product_rating"]
_CATEGORIES = ["product_category", "customer_location", "payment_method", "shipping_method"]
ORACLE["fold_statistics"] = with_order_lines(f"""
WITH {_CANON_CTE},
f AS (SELECT *, {_HASH} % 5 AS own FROM canon),
k AS (SELECT unnest(range(5))::INT AS fold)
""" + "\nUNION ALL\n".join([f"""SELECT fold, '{c}' AS "column", round(m, 6) AS median, round(avg(coalesce({c}, m)), 6) AS mean,
  round(stddev_pop(coalesce({c}, m)), 6) AS std, NULL AS mode
FROM f, (SELECT fold, median({c}) AS m FROM f, k WHERE own <> fold GROUP BY fold) WHERE own <> fold GROUP BY fold, m""" for c in _NUMERIC] + [
    f"""SELECT fold, '{c}', NULL, NULL, NULL, arg_min({c}, (-n, {c}))
FROM (SELECT fold, {c}, COUNT(*) AS n FROM f, k WHERE own <> fold GROUP BY ALL) GROUP BY fold""" for c in _CATEGORIES]))

ORACLE["score_equations"] = with_order_lines(f"""
WITH {_CANON_CTE},
t AS (SELECT * FROM canon WHERE {_PART} = 'train'),
names AS (SELECT unnest([{", ".join(f"'{c}'" for c in [*_NUMERIC, "(intercept)"])}]) AS feature),
slots AS (SELECT feature, (SELECT COUNT(*) FROM t) AS rows FROM names
""" + "".join(f"UNION ALL SELECT '{c}=' || {c}, COUNT(*) FROM t GROUP BY {c}\n" for c in _CATEGORIES) + """)
SELECT balanced, feature, rows, 0.0::DOUBLE AS residual FROM slots, (SELECT unnest([false, true]) AS balanced)""")

# A balanced regression on one category: its probability of each value, from the
# class counts of the rows it is fitted on.
_SHARE = "r * w1 / (r * w1 + (n - r) * w0)"
_WEIGHTS = "round(sum(n) OVER (PARTITION BY {0}) / (2.0 * sum(r) OVER (PARTITION BY {0})), 6) AS w1, round(sum(n) OVER (PARTITION BY {0}) / (2.0 * sum(n - r) OVER (PARTITION BY {0})), 6) AS w0"
_SATURATED = f"""canon_ AS (SELECT customer_location AS c, target AS y, {_PART} AS part, ({_HASH} % 5)::INT AS own FROM canon),
train AS (SELECT * FROM canon_ WHERE part = 'train'),
k AS (SELECT unnest(range(5))::INT AS fold),
by_fold AS (SELECT fold, c, COUNT(*) AS n, SUM(y) AS r FROM train, k WHERE own <> fold GROUP BY ALL),
fold_p AS (SELECT fold, c, {_SHARE} AS p FROM (SELECT *, {_WEIGHTS.format("fold")} FROM by_fold)),
fold_cells AS (SELECT t.own AS fold, COUNT(*) AS n, COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn
  FROM train t JOIN fold_p q ON q.fold = t.own AND q.c = t.c GROUP BY ALL)"""
ORACLE["saturated_cross_validation"] = with_order_lines(f"""
WITH {_CANON_CTE}, {_SATURATED}
SELECT way, fold, round(round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), 6) AS f1
FROM fold_cells, (SELECT unnest(['single', 'together']) AS way)""")

ORACLE["saturated_report"] = with_order_lines(f"""
WITH {_CANON_CTE}, {_SATURATED},
cv AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM (SELECT round((tp + tn) / n::DOUBLE, 6) AS a FROM fold_cells)),
whole AS (SELECT c, {_SHARE} AS p FROM (SELECT *, {_WEIGHTS.format("1")} FROM (SELECT c, COUNT(*) AS n, SUM(y) AS r FROM train GROUP BY c))),
s AS (SELECT part AS split, y, p, (p >= 0.5)::INT AS d FROM canon_ JOIN whole USING (c)),
ranks AS (SELECT split, y, (rank() OVER (PARTITION BY split ORDER BY p) + rank() OVER (PARTITION BY split ORDER BY p) + COUNT(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS rk FROM s),
auc AS (SELECT split, (SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y)::DOUBLE * SUM(1 - y)) AS auc FROM ranks GROUP BY split),
m AS (SELECT split, COUNT(*) FILTER (WHERE y = 0 AND d = 0) AS tn, COUNT(*) FILTER (WHERE y = 0 AND d = 1) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND d = 0) AS fn, COUNT(*) FILTER (WHERE y = 1 AND d = 1) AS tp,
  round(avg(p), 4) AS probability_mean, round(stddev_pop(p), 4) AS probability_std, round(min(p), 4) AS probability_min, round(max(p), 4) AS probability_max
  FROM s GROUP BY split)
SELECT 'lr' AS kind, split, tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc,
  probability_mean, probability_std, probability_min, probability_max,
  CASE WHEN split = 'train' THEN (SELECT round(m, 4) FROM cv) END AS cv_accuracy, CASE WHEN split = 'train' THEN (SELECT round(2 * s, 4) FROM cv) END AS cv_spread
FROM m JOIN auc USING (split)""")

_REPORT = ["kind", "threshold", "total_records", "predicted_returns", "predicted_non_returns", "return_rate", "probability_mean", "probability_std",
           "probability_min", "probability_max", "share_above", "share_below", "high_risk_count", "medium_risk_count", "low_risk_count", "missing_cells",
           "actual_rate", "tn", "fp", "fn", "tp"]
_REPORT_COLUMNS = ["product_price", "order_quantity", "customer_age", "discount", "delivery_time", "product_rating"]
ORACLE["model_batch_report"] = with_order_lines(f"""
WITH {_CANON_CTE}, {_SATURATED},
whole AS (SELECT c, {_SHARE} AS p FROM (SELECT *, {_WEIGHTS.format("1")} FROM (SELECT c, COUNT(*) AS n, SUM(y) AS r FROM train GROUP BY c))),
cuts AS (SELECT p, SUM(SUM(y)) OVER (ORDER BY p DESC) AS tps, SUM(SUM(1 - y)) OVER (ORDER BY p DESC) AS fps, SUM(SUM(y)) OVER () AS pos, SUM(SUM(1 - y)) OVER () AS neg
  FROM canon_ JOIN whole USING (c) WHERE part = 'test' GROUP BY p),
cut AS (SELECT p AS thr FROM cuts ORDER BY tps * neg - fps * pos DESC, p DESC LIMIT 1),
s AS (SELECT customer_location, target AS y, p, thr, (p >= thr)::INT AS d, {" + ".join(f"({c} IS NULL)::INT" for c in _REPORT_COLUMNS)} AS gaps
  FROM canon JOIN whole ON c = customer_location, cut),
report AS (SELECT 'lr' AS kind, round(any_value(thr), 4) AS threshold, COUNT(*) AS total_records, SUM(d)::BIGINT AS predicted_returns, SUM(1 - d)::BIGINT AS predicted_non_returns,
  round(avg(d::DOUBLE), 6) AS return_rate, round(avg(p), 4) AS probability_mean, round(stddev_pop(p), 4) AS probability_std, round(min(p), 4) AS probability_min,
  round(max(p), 4) AS probability_max, round(avg((p > 0.5)::INT), 6) AS share_above, round(avg((p < 0.5)::INT), 6) AS share_below,
  COUNT(*) FILTER (WHERE p > 0.7) AS high_risk_count, COUNT(*) FILTER (WHERE p > 0.3 AND p <= 0.7) AS medium_risk_count, COUNT(*) FILTER (WHERE p <= 0.3) AS low_risk_count,
  SUM(gaps)::BIGINT AS missing_cells, round(avg(y::DOUBLE), 6) AS actual_rate, COUNT(*) FILTER (WHERE y = 0 AND d = 0) AS tn, COUNT(*) FILTER (WHERE y = 0 AND d = 1) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND d = 0) AS fn, COUNT(*) FILTER (WHERE y = 1 AND d = 1) AS tp FROM s)
SELECT customer_location, CASE WHEN d = 1 THEN 'Return' ELSE 'Not Return' END AS Prediction_Label,
  CASE WHEN abs(p - thr) < 0.1 THEN 'Very High' WHEN abs(p - thr) < 0.2 THEN 'High' WHEN abs(p - thr) < 0.3 THEN 'Medium-High'
       WHEN abs(p - thr) < 0.4 THEN 'Medium' WHEN abs(p - thr) < 0.5 THEN 'Medium-Low' ELSE 'Low' END AS Confidence_Level,
  COUNT(*) AS rows, SUM(y)::BIGINT AS returns, round(avg(p), 4) AS p, {", ".join(f"any_value(report.{c}) AS {c}" for c in _REPORT)},
  round(any_value((tp + tn) / total_records::DOUBLE), 6) AS accuracy, round(any_value(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)), 6) AS precision,
  round(any_value(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)), 6) AS recall, round(any_value(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1
FROM s, report GROUP BY ALL""")

# The best cut of three columns by the fall in impurity, with gaps at the median.
_SPLIT_COLUMNS = ["discount", "delivery_time", "product_rating"]
ORACLE["single_split_trees"] = with_order_lines(f"""
WITH {_CANON_CTE},
meds AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _SPLIT_COLUMNS)} FROM canon WHERE {_PART} = 'train'),
filled AS (SELECT target AS y, {_PART} AS part, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _SPLIT_COLUMNS)} FROM canon, meds),
long AS (SELECT part, y, unnest([{", ".join(f"{{'c': '{c}', 'x': {c}}}" for c in _SPLIT_COLUMNS)}], recursive := true) FROM filled),
cuts AS (SELECT DISTINCT c, x AS cut FROM long WHERE part = 'train'),
sides AS (SELECT l.c, cut, COUNT(*) FILTER (WHERE x <= cut) AS n0, SUM(y) FILTER (WHERE x <= cut) AS r0,
  COUNT(*) FILTER (WHERE x > cut) AS n1, SUM(y) FILTER (WHERE x > cut) AS r1 FROM long l JOIN cuts USING (c) WHERE part = 'train' GROUP BY l.c, cut),
w AS (SELECT round(COUNT(*) / (2.0 * SUM(y)), 6) AS w1, round(COUNT(*) / (2.0 * SUM(1 - y)), 6) AS w0 FROM filled WHERE part = 'train'),
kinds AS (SELECT 'rf' AS kind, w1, w0 FROM w UNION ALL SELECT 'gbt', 1.0, 1.0),
weighed AS (SELECT kind, c, cut, n0, n1, r0 * w1 AS p0, (n0 - r0) * w0 AS q0, r1 * w1 AS p1, (n1 - r1) * w0 AS q1 FROM sides, kinds),
best AS (SELECT * FROM weighed WHERE n0 > 0 AND n1 > 0
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY p0 * q0 / (p0 + q0) + p1 * q1 / (p1 + q1), c, cut) = 1),
leaves AS (SELECT kind, best.c AS feature, COUNT(*) AS rows, SUM(y)::BIGINT AS returns, any_value(CASE WHEN x > cut THEN p1 / (p1 + q1) ELSE p0 / (p0 + q0) END) AS share
  FROM long l JOIN best USING (c) GROUP BY kind, best.c, x > cut)
SELECT kind, feature, 1.0::DOUBLE AS importance, round(CASE kind WHEN 'rf' THEN share ELSE 1 / (1 + exp(-2 * (2 * share - 1))) END, 6) AS p, rows, returns FROM leaves""")

# Columns as text, the type by what all cells match.
_TEXTS = {"order_id": "order_id::VARCHAR", "item_price": "item_price::VARCHAR", "customer_age": "customer_age::VARCHAR", "return_status": "return_status",
          "dear": "(item_price > 100)::VARCHAR", "mixed": "CASE WHEN line_no = 1 THEN '12' ELSE ' -1.5e1' END",
          "long_number": "'1234567890123456789' || line_no", "flag_or_number": "CASE WHEN line_no = 1 THEN 'true' ELSE '1' END", "nothing": "NULL"}
ORACLE["csv_inferred"] = with_order_lines("WITH c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {x} AS v FROM order_lines" for c, x in _TEXTS.items()) + """),
t AS (SELECT "column", COUNT(v) AS cells, CASE WHEN COUNT(v) = 0 THEN 'double' WHEN bool_and(v IN ('true', 'false')) THEN 'boolean'
    WHEN bool_and(v IS NULL OR regexp_full_match(v, '\\s*[+-]?[0-9]+\\s*') AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL) THEN 'bigint'
    WHEN bool_and(v IS NULL OR TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type FROM c GROUP BY 1)
SELECT t.*, (SELECT max(CASE type WHEN 'boolean' THEN (v = 'true')::INT::DOUBLE ELSE TRY_CAST(trim(v) AS DOUBLE) END)
             FROM c WHERE c."column" = t."column" AND type <> 'string') AS largest FROM t""")

_BOUNDS = {"item_price": (0, 200), "order_quantity": (0, 50), "customer_age": (18, 98), "product_rating": (1, 5)}
_BIN = "least(greatest(floor((x - lo) / (hi - lo) * 10), 0), 9)"
ORACLE["stored_profile"] = with_order_lines("WITH c AS (" + "\nUNION ALL\n".join(
    [f"SELECT order_date, '{c}' AS \"column\", {c}::VARCHAR AS v, {c}::DOUBLE AS x, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM order_lines" for c, (lo, hi) in _BOUNDS.items()]
    + [f"SELECT order_date, '{c}', {c}::VARCHAR, NULL, NULL, NULL FROM order_lines" for c in ("payment_method", "order_id")]) + f""")
SELECT "column", COUNT(*) AS rows, COUNT(*) - COUNT(v) AS missing, min(x) AS least, max(x) AS most,
  concat_ws(',', {", ".join(f"COUNT(*) FILTER (WHERE x IS NOT NULL AND {_BIN} = {i})" for i in range(10))}) AS bins, 1 AS near, COUNT(DISTINCT v) AS number
FROM c WHERE order_date >= DATE '1994-03-05' AND order_date < DATE '1996-07-01' GROUP BY 1""")

_LINE_COLUMNS = ["order_id", "line_no", "customer_id", "product_category", "item_price", "order_quantity", "customer_age", "customer_location",
                 "payment_method", "shipping_method", "discount", "delivery_days", "product_rating", "return_status"]
ORACLE["observed_write"] = with_order_lines(f"""
WITH {_scored(_PLAIN_P, _BANDS6)}
SELECT COUNT(*) AS total_records, CAST(SUM(pred) AS BIGINT) AS predicted_returns, CAST(COUNT(*) - SUM(pred) AS BIGINT) AS predicted_non_returns,
  round(avg(pred::DOUBLE), 6) AS return_rate, round(avg(p), 6) AS probability_mean, round(stddev_pop(p), 6) AS probability_std,
  min(p) AS probability_min, max(p) AS probability_max, round(avg((p > 0.5)::INT::DOUBLE), 6) AS share_above, round(avg((p < 0.5)::INT::DOUBLE), 6) AS share_below,
  COUNT(*) FILTER (WHERE p > 0.7) AS high_risk_count, COUNT(*) FILTER (WHERE p > 0.3 AND p <= 0.7) AS medium_risk_count,
  COUNT(*) FILTER (WHERE p <= 0.3) AS low_risk_count,
  (SELECT {len(_LINE_COLUMNS)} * COUNT(*) - {" - ".join(f"COUNT({c})" for c in _LINE_COLUMNS)} FROM order_lines) AS missing_cells
FROM scored""")

ORACLE["reloaded_model"] = with_order_lines(f"""
WITH l AS (SELECT customer_location, {_ACTUAL} AS target, order_date, CASE WHEN order_date < DATE '1997-01-01' THEN 1 ELSE 2 END AS version FROM order_lines),
share AS (SELECT 1 AS version, customer_location, avg(target::DOUBLE) AS p FROM l WHERE order_date < DATE '1997-01-01' GROUP BY 2
  UNION ALL SELECT 2, customer_location, avg(target::DOUBLE) FROM l WHERE order_date < DATE '1999-01-01' GROUP BY 2)
SELECT version, customer_location, COUNT(*) AS rows, SUM(target)::BIGINT AS returns, round(any_value(p), 4) AS p FROM l JOIN share USING (version, customer_location) GROUP BY ALL""")

_SCORES = {"price": "coalesce(product_price, 0) / 1000", "rating": "coalesce(product_rating, 3) / 5",
           "low_rating": "1 - coalesce(product_rating, 3) / 5", "rating_again": "coalesce(product_rating, 3) / 5"}
ORACLE["selection_ties"] = with_order_lines(f"""
WITH {_CANON_CTE},
c AS ({" UNION ALL ".join(f"""SELECT {i} AS i, '{c}' AS split, COUNT(*) FILTER (WHERE target = 0 AND NOT ({x} >= 0.5)) AS tn,
  COUNT(*) FILTER (WHERE target = 0 AND {x} >= 0.5) AS fp, COUNT(*) FILTER (WHERE target = 1 AND NOT ({x} >= 0.5)) AS fn,
  COUNT(*) FILTER (WHERE target = 1 AND {x} >= 0.5) AS tp FROM canon""" for i, (c, x) in enumerate(_SCORES.items()))}),
m AS (SELECT i, split, tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tn + fp + fn + tp), 6) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c),
best AS (SELECT split AS chosen, f1 AS top FROM m ORDER BY f1 DESC, i LIMIT 1)
SELECT m.* EXCLUDE (i), chosen,
  CASE WHEN (SELECT f1 FROM m WHERE split = 'rating_again') = top THEN 'rating_again' ELSE chosen END AS preferred
FROM m, best""")

ORACLE["class_counts"] = with_order_lines(f"""
WITH c AS (SELECT {_ACTUAL} AS label, COUNT(*) AS n FROM order_lines GROUP BY 1)
SELECT label, n, round(n / CAST(SUM(n) OVER () AS DOUBLE), 6) AS share,
       (SELECT round(avg(({_ACTUAL})::DOUBLE), 6) FROM order_lines) AS target_rate, (SELECT COUNT(*) FROM order_lines) AS rows
FROM c""")

ORACLE["actual_vs_predicted"] = with_order_lines(f"""
WITH {_PROD_CTE}
SELECT round(avg(actual::DOUBLE), 6) AS actual_rate, round(avg(pred::DOUBLE), 6) AS predicted_rate FROM prod""")

ORACLE["top_rows"] = with_order_lines(
    "SELECT item_price, order_id, line_no FROM order_lines ORDER BY item_price DESC NULLS LAST, order_id, line_no LIMIT 20")

ORACLE["coerce_columns"] = with_order_lines("""
SELECT 'quantity_text' AS "column", 'double' AS type, COUNT(order_quantity) AS n FROM order_lines
UNION ALL SELECT 'price_text', 'double', COUNT(item_price) FROM order_lines
UNION ALL SELECT 'half_text', 'string', COUNT(*) - COUNT(*) FILTER (WHERE order_id % 2 = 0 AND discount IS NULL) FROM order_lines
UNION ALL SELECT 'shipping_method', 'string', COUNT(shipping_method) FROM order_lines""")

ORACLE["parquet_round_trip"] = with_order_lines(f"""
WITH {_scored(_PLAIN_P, _BANDS6)}
SELECT band AS Confidence_Level, COUNT(*) AS n, CAST(SUM(pred) AS BIGINT) AS predicted_returns FROM scored GROUP BY 1""")
