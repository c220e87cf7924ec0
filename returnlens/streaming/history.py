"""X1 on a stream: each customer's history before every day, as lines arrive.

Two jobs, each exactly-once from its own checkpoint, joined by a table:

* ``closed_days`` counts a day's orders, lines and returns of each customer and
  appends them when the watermark has passed the day.  It groups by order first,
  then by customer, so a customer with a third of all lines is spread over tasks;
  state is a row for each order of a day that is still open.
* ``keep_histories`` holds four numbers for each customer, in a table that every
  micro-batch of closed days replaces, and turns those days, of which a customer has at
  most one a day, into totals before them.  A closed day never comes again and days
  close in order, so no timer is needed.  It is a window over the batch, not a call
  for each customer, whose number grows with the table.

A line later than the watermark is counted in no day.  ``with_late_lines`` finds how
many there were from what has arrived and what was counted.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.views import order_lines_with_dates
from ..session import ensure_checkpoint_dir, materialize, scratch_path
from .stream import land, lines_stream, run_to_parquet

CLOSED = "customer_id bigint, day bigint, orders bigint, lines bigint, returns bigint"
HISTORY = "customer_id bigint, day bigint, prior_orders bigint, prior_lines bigint, prior_returns bigint, lines bigint"
TOTALS = "customer_id bigint, orders bigint, lines bigint, returns bigint, day bigint"
_COUNTS = ("orders", "lines", "returns")
_NUMBERS = ("customer_id", "day", *_COUNTS)


def closed_days(stream: DataFrame, delay: str, ts: str = "order_ts") -> DataFrame:
    """``CLOSED`` rows from lines (customer_id, order_id, ``ts``, actual): one for
    each customer and day, once ``delay`` has passed after it."""
    orders = (stream.withWatermark(ts, delay)
              .groupBy("customer_id", F.window(ts, "1 day").alias("w"), "order_id")
              .agg(F.count(F.lit(1)).alias("lines"), F.sum("actual").alias("returns")))
    days = (orders.groupBy("customer_id", F.window(F.window_time("w"), "1 day").alias("d"))
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"), F.sum("returns").alias("returns")))
    return days.select(F.col("customer_id").cast("bigint").alias("customer_id"),
                       F.floor(F.unix_seconds("d.start") / 86400).cast("bigint").alias("day"), "orders", "lines",
                       F.coalesce("returns", F.lit(0)).cast("bigint").alias("returns"))


def histories(held: DataFrame | None, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``HISTORY`` rows of newly ``CLOSED`` rows, and the customers' totals after
    them, from the totals ``held`` before (None: there are none).

    A customer's totals stand as one more row before the new days, so the totals before a
    day are a running sum: one shuffle by customer, of at most a row a day for each."""
    new = closed.select(*_NUMBERS, F.lit(True).alias("new"))
    both = new if held is None else new.unionByName(held.select(*_NUMBERS, F.lit(False).alias("new")))
    own = Window.partitionBy("customer_id")
    last = F.max(F.when(~F.col("new"), F.col("day"))).over(own)
    before = own.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    again = F.raise_error(F.concat(F.lit("day "), F.col("day").cast("string"), F.lit(" of customer "),
                                   F.coalesce(F.col("customer_id").cast("string"), F.lit("NULL")), F.lit(" was closed before")))
    summed = both.select("customer_id", F.when(F.col("new") & (F.col("day") <= last), again.cast("bigint")).otherwise(F.col("day")).alias("day"),
                         *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(f"prior_{c}") for c in _COUNTS], "lines", "new")
    totals = both.groupBy("customer_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in _COUNTS], F.max("day").alias("day"))
    return summed.where("new").drop("new"), totals


def keep_histories(closed: DataFrame, out: str, totals: str, checkpoint: str) -> None:
    """Adds the histories of what has arrived on ``closed`` to the table ``out`` and goes
    on from ``checkpoint`` when called again.  Each micro-batch has folders of its own for
    its rows and for the totals after it, which a batch that is run again replaces; the totals
    of the one before stay until its next has been written."""

    def extend(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(TOTALS).parquet(os.path.join(totals, f"batch-{number - 1}")) if number else None
        rows, after = histories(held, batch)
        rows.write.mode("overwrite").parquet(os.path.join(out, f"batch-{number}"))
        after.write.mode("overwrite").parquet(os.path.join(totals, f"batch-{number}"))
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(totals, f"batch-{number - 2}"))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    closed.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_late_lines(arrived: DataFrame, history: DataFrame, ts: str = "order_ts") -> DataFrame:
    """``history`` with ``late_lines``, the lines of ``arrived`` that no closed day
    has counted.  A day of late lines only has no history (NULL)."""
    day = F.floor(F.unix_seconds(ts) / 86400).cast("bigint")
    seen = arrived.groupBy("customer_id", day.alias("day")).agg(F.count(F.lit(1)).alias("arrived"))
    counted = F.coalesce("lines", F.lit(0)).cast("bigint")
    return seen.join(history, ["customer_id", "day"], "left").select(
        "customer_id", "day", "prior_orders", "prior_lines", "prior_returns", counted.alias("lines"),
        (F.col("arrived") - counted).alias("late_lines"))


def advance(spark: SparkSession, home: str, schema, delay: str) -> DataFrame:
    """Runs both jobs over what has landed in ``home``/landing since the last call;
    returns all histories so far."""
    days, out = os.path.join(home, "days"), os.path.join(home, "history")
    name = os.path.basename(home)
    run_to_parquet(closed_days(lines_stream(spark, os.path.join(home, "landing"), schema), delay), days, f"{name}-days")
    spark.createDataFrame([], HISTORY).write.mode("ignore").parquet(os.path.join(out, "none"))     # no day has closed yet
    keep_histories(lines_stream(spark, days, CLOSED), out, os.path.join(home, "totals"),
                   os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-history"))
    return spark.read.schema(HISTORY).parquet(os.path.join(out, "*"))


def arriving_history(spark: SparkSession, sf_dir: str, slices: int = 3, delay: str = "60 days", late_every: int = 97) -> DataFrame:
    """X1 over lines that arrive in ``slices`` slices of order dates, one of
    ``late_every`` of the first with the last.  A last line far ahead, of no
    customer, closes the days that remain."""
    lines = materialize(order_lines_with_dates(spark, sf_dir).select(
        F.col("customer_id").cast("bigint").alias("customer_id"), "order_id", "line_no", "order_date", "order_ts",
        (F.col("return_status") == "Returned").cast("int").alias("actual")))
    lo, hi = lines.agg(F.min("order_date"), F.max("order_date")).first()
    if lo is None:
        return spark.createDataFrame([], f"{HISTORY}, late_lines bigint")
    place = F.floor(F.datediff("order_date", F.lit(lo)) * slices / ((hi - lo).days + 1))
    late = (place == 0) & ((F.col("order_id") + F.col("line_no")) % late_every == 0)
    arrives = F.when(late, F.lit(slices - 1)).otherwise(place)
    end = (hi - date(1970, 1, 1)).days + 3650
    far = spark.range(1).select(*[(F.timestamp_seconds(F.lit(end * 86400)) if c == "order_ts" else F.lit(None).cast(t)).alias(c) for c, t in lines.dtypes])
    home = scratch_path(spark, "streams")
    for part in [lines.where(arrives == i) for i in range(slices)] + [far]:
        land(part, os.path.join(home, "landing"))
        history = advance(spark, home, lines.schema, delay)
    return with_late_lines(lines, history)
