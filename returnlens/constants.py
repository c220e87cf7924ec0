"""Fixed values that results depend on.

FIXED VALUES: the word lists, alias table, defaults, ranges, rule weights and
band cut-offs below must stay exactly as written; scores, labels and column
choices are only comparable with the original product when they do.  They are
kept together, in their natural order, and nothing else in the package
restates them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — column-name lists
# ---------------------------------------------------------------------------

# Identifier columns dropped before fitting (PR1).
ID_COLUMNS = ["Order_ID", "Customer_ID"]

# Leakage, substring list (PR2): a column is leakage when its lower-cased
# name contains any of these.
LEAKAGE_SUBSTRINGS = [
    "return_status", "return_reason", "return_date", "returned", "return",
    "prediction", "prediction_label", "return_probability", "days_to_return",
    "return_flag", "is_returned", "has_returned",
]

# Leakage, broad keyword list (PR3).
LEAKAGE_KEYWORDS = [
    "return", "returned", "status", "prediction", "probability", "label",
    "target", "outcome", "result", "flag",
]

# Target names, exact match on lower(strip(name)) (PR4).
TARGET_NAMES = [
    "return_status", "returned", "return", "is_returned", "has_returned",
    "return_flag", "return_indicator",
]
# Shorter variant used by the production validator (no strip).
TARGET_NAMES_SHORT = ["return_status", "returned", "return", "is_returned"]

# Target by keyword (PR5) and the exclusions applied at fit time.
TARGET_KEYWORDS = ["return", "returned", "status", "outcome", "result", "flag", "target"]
TARGET_EXCLUSIONS = ["history", "rate", "prediction", "probability", "label"]

# Values that make the binarised target 1 (PR6), compared on lower(str(x)).
POSITIVE_TARGET_VALUES = ["returned", "return", "yes", "true", "1"]

# Words that mark a column as relevant for display / rule scoring (PR9, PR10).
RELEVANT_WORDS = ["price", "cost", "amount", "age", "rating", "score", "time", "day"]

# The four result columns written by every scorer (PR12).
RESULT_COLUMNS = ["Prediction", "Return_Probability", "Prediction_Label", "Confidence_Level"]

# ---------------------------------------------------------------------------
# FIXED VALUES — canonical schema (TR14)
# ---------------------------------------------------------------------------

CANONICAL_NUMERIC = [
    "product_price", "order_quantity", "customer_age", "discount", "delivery_time",
    "purchase_history_count", "return_history_rate", "product_rating",
]
CANONICAL_CATEGORICAL = [
    "product_category", "customer_location", "payment_method", "shipping_method",
]

# Alias map (PR7), in the order the canonical features are resolved.
CANONICAL_ALIASES: dict[str, list[str]] = {
    "product_category": [
        "product_category", "category", "product_type", "item_category", "category_name",
        "productcategory", "product_cat", "prod_category", "item_type", "type",
        "product_line", "department", "section", "class",
    ],
    "product_price": [
        "product_price", "price", "amount", "cost", "unit_price", "selling_price",
        "retail_price", "price_usd", "productprice", "item_price", "order_amount",
        "total_price", "sale_price", "list_price",
    ],
    "order_quantity": [
        "order_quantity", "quantity", "qty", "product_quantity", "item_quantity",
        "order_qty", "product_qty", "items_ordered",
    ],
    "customer_age": [
        "customer_age", "age", "user_age", "customerage", "userage", "cust_age",
        "client_age", "buyer_age", "person_age", "age_years",
    ],
    "customer_location": [
        "customer_location", "location", "state", "city", "region", "country",
        "customerlocation", "user_location", "cust_location", "address", "geo_location",
        "shipping_location", "billing_location",
    ],
    "payment_method": [
        "payment_method", "payment_type", "payment", "payment_option", "paymentmode",
        "payment_method_type", "transaction_method", "billing_method", "payment_channel",
        "payment_source",
    ],
    "shipping_method": [
        "shipping_method", "delivery_method", "shipping_type", "delivery_type", "shipping",
        "delivery", "shipping_option", "delivery_option", "courier", "shipping_carrier",
    ],
    "discount": [
        "discount", "discount_applied", "discount_percentage", "discount_rate",
        "discount_amount", "discount_percent", "rebate", "price_reduction", "discount_value",
        "savings",
    ],
    "delivery_time": [
        "delivery_time", "delivery_days", "shipping_time", "shipping_days", "delivery_period",
        "delivery", "shipping", "days_to_deliver", "delivery_duration", "estimated_delivery",
    ],
    "purchase_history_count": [
        "purchase_history_count", "purchase_count", "order_count", "total_orders",
        "previous_orders", "order_history", "customer_orders", "user_orders",
        "lifetime_orders", "total_purchases", "order_frequency", "past_orders",
    ],
    "return_history_rate": [
        "return_history_rate", "return_rate", "return_frequency", "previous_returns",
        "customer_return_rate", "return_ratio", "return_percentage", "return_history",
        "historical_return_rate",
    ],
    "product_rating": [
        "product_rating", "rating", "stars", "review_rating", "customer_rating",
        "user_rating", "item_rating", "product_score", "rating_value", "avg_rating",
        "customer_satisfaction", "quality_rating",
    ],
}

# Defaults for canonical features no column maps to (PR8).
CANONICAL_DEFAULTS: dict[str, object] = {
    "product_category": "Unknown",
    "product_price": 50.0,
    "order_quantity": 1,
    "customer_age": 35.0,
    "customer_location": "Unknown",
    "payment_method": "Unknown",
    "shipping_method": "Standard",
    "discount": 0.0,
    "delivery_time": 3.0,
    "purchase_history_count": 5.0,
    "return_history_rate": 0.1,
    "product_rating": 4.0,
}

# Clip ranges (TR3); other numeric canonical features are not clipped.
CLIP_RANGES: dict[str, tuple[float, float]] = {
    "product_price": (1, 1000),
    "customer_age": (18, 100),
    "order_quantity": (1, 100),
    "discount": (0, 100),
    "delivery_time": (1, 30),
    "product_rating": (1, 5),
}

# ---------------------------------------------------------------------------
# FIXED VALUES — scoring rules
# ---------------------------------------------------------------------------

RULE_BASE = 0.3
PROBABILITY_FLOOR = 0.05
PROBABILITY_CEILING = 0.95
DECISION_CUTOFF = 0.5

# Plain rules (SC1/SC2): families tried in this order, first match only.
# (family words, [(comparison, bound, delta), ...])
PLAIN_RULES = [
    (["price", "cost"], [(">", 100, 0.2), ("<", 20, -0.1)]),
    (["age"], [("outside", (25, 65), 0.1)]),
    (["rating", "score"], [("<", 2, 0.3)]),
]

# Production rules (SC3): independent families, applied in this order.
PRODUCTION_RULES = [
    (["price", "cost"], [(">", 100, 0.2), ("<", 20, -0.1)]),
    (["rating"], [("<", 3, 0.3), (">", 4, -0.2)]),
    (["discount"], [(">", 0, 0.1)]),
    (["delivery", "shipping"], [(">", 7, 0.15)]),
]

# Propensity formulas (SC4): base, then additive terms.  Each term is
# (kind, feature, parameters, weight):
#   ratio:   feature / parameter * weight
#   invert:  (parameter - feature) / 4 * weight  (rating)
#   linear:  feature * weight
#   member:  (feature in parameter) * weight
#   greater: (feature > parameter) * weight
#   less:    (feature < parameter) * weight
PROPENSITY_FORMULAS: dict[str, tuple[float, list[tuple[str, str, object, float]]]] = {
    "root": (0.15, [
        ("ratio", "price", 500, 0.20),
        ("member", "category", ["Electronics", "Clothing"], 0.10),
        ("ratio", "delivery", 15, 0.15),
        ("invert", "rating", 5, 0.20),
        ("linear", "return_rate", None, 0.25),
        ("ratio", "discount", 30, 0.10),
    ]),
    "flexible": (0.35, [
        ("ratio", "price", 2000, 0.25),
        ("member", "category", ["Electronics", "Clothing"], 0.15),
        ("ratio", "delivery", 20, 0.20),
        ("invert", "rating", 5, 0.25),
        ("ratio", "discount", 30, 0.15),
    ]),
    "production": (0.25, [
        ("ratio", "price", 2000, 0.20),
        ("member", "category", ["Electronics", "Clothing", "Shoes"], 0.15),
        ("ratio", "delivery", 20, 0.20),
        ("invert", "rating", 5, 0.25),
        ("linear", "return_rate", None, 0.30),
        ("ratio", "discount", 40, 0.15),
        ("greater", "quantity", 3, 0.10),
        ("less", "age", 25, 0.05),
    ]),
}

# ---------------------------------------------------------------------------
# FIXED VALUES — labels and bands
# ---------------------------------------------------------------------------

LABELS = {0: "Not Return", 1: "Return"}

# Confidence ladders: (exclusive lower bound, band), checked top-down; the
# last entry is the fallback.
CONFIDENCE_6 = [(0.8, "Very High"), (0.7, "High"), (0.6, "Medium-High"),
                (0.4, "Medium"), (0.3, "Medium-Low"), (None, "Low")]
CONFIDENCE_7 = [(0.8, "Very High"), (0.7, "High"), (0.6, "Medium-High"),
                (0.4, "Medium"), (0.3, "Medium-Low"), (0.2, "Low"), (None, "Very Low")]
# Distance from the threshold: (exclusive upper bound, band).
CONFIDENCE_DISTANCE = [(0.1, "Very High"), (0.2, "High"), (0.3, "Medium-High"),
                       (0.4, "Medium"), (0.5, "Medium-Low"), (None, "Low")]
# Two bands: High outside [low, high], else Medium.
CONFIDENCE_2 = (0.3, 0.7)

# Risk bands: High > 0.7, Medium in (0.3, 0.7], Low <= 0.3.
RISK_HIGH = 0.7
RISK_LOW = 0.3

# Row validation (FI4): (feature, lowest valid, highest valid, message); a
# bound of None is open.  The price floor is exclusive (price must be > 0),
# every other bound is inclusive.  A missing feature counts as 0.
ROW_CHECKS = [
    ("Product_Price", 0, None, "Product price must be greater than 0"),
    ("Product_Price", None, 10000, "Product price seems unusually high"),
    ("Customer_Age", 18, 100, "Customer age must be between 18 and 100"),
    ("Product_Rating", 1, 5, "Product rating must be between 1 and 5"),
    ("Delivery_Time", 1, 30, "Delivery time must be between 1 and 30 days"),
    ("Return_History_Rate", 0, 1, "Return history rate must be between 0 and 1"),
]
ROW_CHECK_EXCLUSIVE_FLOOR = {"Product_Price"}

# Type detection cardinality limits (PR13).
TYPE_LIMIT_FLEXIBLE = 10
TYPE_LIMIT_ULTRA = 20

# Data-quality checks (AG3, AG4).
AGE_VALID_RANGE = (0, 120)

# Histogram bin counts (AG17).
HIST_BINS = {"price": 20, "rating": 10, "probability": 20}

# Split and fold defaults (SO3, SO4).
SPLIT_SEED = 42
TEST_PERCENT = 20
