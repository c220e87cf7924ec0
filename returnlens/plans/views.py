"""``order_lines``: the driver's order tables in the shape the scorers expect.

One row per line item, with an order, a customer, a nation and a part joined
on.  Missing cells are placed by a fixed modulus so every engine blanks the
same cells; age, rating and delivery are stand-ins derived from keys.

Join strategy (for a 100 TB lineitem): lineitem ⋈ orders is the one
large-large join and is a shuffle (sort-merge) join on the order key;
the dimension joins (customer, nation, part) are left to the planner, which
broadcasts a side only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles (AQE
re-plans at run time and splits skewed keys).  Lines are shuffled at most twice,
narrowed before the first (flags in a byte, dates in days): by part first, then by order, where the customer is joined
to the orders already; the few nations come last, so their names are in no shuffle.
Each scan keeps only the columns used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

ORDER_LINES_COLUMNS = [
    "order_id", "line_no", "customer_id", "product_category", "item_price", "order_quantity",
    "customer_age", "customer_location", "payment_method", "shipping_method", "discount",
    "delivery_days", "product_rating", "return_status",
]


def _blank_every(n: int) -> F.Column:
    return ((F.col("l_orderkey") + F.col("l_linenumber")) % n) == 0


def scans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five pruned scans the view needs (lineitem last, as the fact)."""
    return {
        "orders": table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]),
        "customer": table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
        "nation": table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]),
        "part": table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"]),
        "lineitem": table(spark, sf_dir, "lineitem", LINEITEM_COLUMNS),
    }


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_returnflag", "l_shipdate"]


#: Bits of a line's flags.
NO_AGE, NO_RATING, RETURNED = 1, 2, 4


def order_lines_from(li: DataFrame, od: DataFrame, cu: DataFrame, na: DataFrame,
                     pa: DataFrame) -> DataFrame:
    """The view over given inputs (``li`` may be a stream: stream-static
    joins).  Adds ``order_date`` (DATE) and ``order_ts`` (event time)."""
    # Lines and orders are narrowed before they are shuffled: what one row tells by
    # itself is worked out there, flags share a byte, dates are days.
    lines = li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        F.when(_blank_every(25), F.lit(None).cast("double")).otherwise(F.col("l_extendedprice")).alias("price"),
        F.round(F.col("l_discount") * 100).alias("percent"),
        sum([F.when(flag, bit).otherwise(0) for flag, bit in (
            (_blank_every(27), NO_AGE), (_blank_every(29), NO_RATING),
            (F.col("l_returnflag") == "R", RETURNED))], F.lit(0)).cast("tinyint").alias("marks"),
        F.to_date("l_shipdate").alias("ship_date"))
    placed = od.withColumn("o_orderdate", F.to_date("o_orderdate")).join(cu, F.col("o_custkey") == F.col("c_custkey"))

    def marked(bit: int) -> F.Column:
        return F.col("marks").bitwiseAND(F.lit(bit)) != 0

    j = (lines.join(pa, F.col("l_partkey") == F.col("p_partkey"))
         .select("l_orderkey", "l_linenumber", "l_quantity", "price", "percent", "marks", "ship_date", "p_type",
                 (F.col("p_size") % 9).alias("size"))
         .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(na, F.col("c_nationkey") == F.col("n_nationkey")))

    null_d = F.lit(None).cast("double")
    null_i = F.lit(None).cast("int")
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_custkey").alias("customer_id"),
        F.col("p_type").alias("product_category"),
        (F.col("price") / F.lit(500.0)).alias("item_price"),
        F.col("l_quantity").cast("int").alias("order_quantity"),
        F.when(marked(NO_AGE), null_i)
         .otherwise((F.lit(18) + F.col("c_custkey") % 63).cast("int")).alias("customer_age"),
        F.col("n_name").alias("customer_location"),
        F.col("c_mktsegment").alias("payment_method"),
        F.col("o_orderpriority").alias("shipping_method"),
        F.col("percent").cast("int").alias("discount"),
        (F.lit(1) + F.abs(F.datediff(F.col("ship_date"), F.col("o_orderdate"))) % 30)
        .cast("int").alias("delivery_days"),
        F.when(marked(NO_RATING), null_d)
         .otherwise(F.lit(1.0) + F.col("size") / F.lit(2.0)).alias("product_rating"),
        F.when(marked(RETURNED), F.lit("Returned"))
         .otherwise(F.lit("Not Returned")).alias("return_status"),
        F.col("o_orderdate").alias("order_date"),
        # event time at UTC midnight of the order date, whatever the session zone
        F.timestamp_seconds(F.unix_date(F.col("o_orderdate")).cast("long") * 86400)
        .alias("order_ts"),
    )


def order_lines_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_lines`` plus ``order_date`` and ``order_ts``."""
    s = scans(spark, sf_dir)
    return order_lines_from(s["lineitem"], s["orders"], s["customer"], s["nation"], s["part"])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines_with_dates(spark, sf_dir).select(*ORDER_LINES_COLUMNS)


# The same view for DuckDB (oracle side).  DOUBLE literals keep the float
# arithmetic identical to Spark's.
ORDER_LINES_SQL = """
order_lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id,
    p_type AS product_category,
    CASE WHEN (l_orderkey + l_linenumber) % 25 = 0 THEN NULL
         ELSE l_extendedprice / 500.0::DOUBLE END AS item_price,
    CAST(l_quantity AS INTEGER) AS order_quantity,
    CASE WHEN (l_orderkey + l_linenumber) % 27 = 0 THEN NULL
         ELSE CAST(18 + c_custkey % 63 AS INTEGER) END AS customer_age,
    n_name AS customer_location, c_mktsegment AS payment_method,
    o_orderpriority AS shipping_method,
    CAST(round(l_discount * 100) AS INTEGER) AS discount,
    CAST(1 + abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 30
         AS INTEGER) AS delivery_days,
    CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN NULL
         ELSE 1.0::DOUBLE + (p_size % 9) / 2.0::DOUBLE END AS product_rating,
    CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Not Returned' END AS return_status,
    CAST(o_orderdate AS DATE) AS order_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
)"""


def with_order_lines(sql: str) -> str:
    """Prefix an oracle query with the ``order_lines`` CTE."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ORDER_LINES_SQL.strip() + ",\n" + body[5:]
    return "WITH " + ORDER_LINES_SQL.strip() + "\n" + body
