"""X2: score order lines as they arrive, with frozen statistics.

Scoring is row-local once the batch statistics are frozen (medians from a
fitted table), so the same projection the batch scorers use runs on a
stream.  Statistics that need the whole batch (TR5, TR6) are refused on a
stream — they must be fitted first and passed in.

Event-time aggregation (predicted and actual returns per window) uses
``withWatermark`` + ``window``: state is one row per open window, bounded
by the watermark, never by the number of rows.
"""

from __future__ import annotations

import os
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.coerce import column_to_double
from ..operators.projections import scoring_columns
from ..operators.transforms import fit_medians
from ..plans.scoring import decorate
from ..plans.views import ORDER_LINES_COLUMNS, order_lines_with_dates
from ..session import ensure_checkpoint_dir, materialize, scratch_path


def lines_stream(spark: SparkSession, folder: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of joined order lines from a landing folder of Parquet files:
    the tables are joined once, where lines land, not in every micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def land(lines: DataFrame, folder: str) -> None:
    """Append joined lines to a landing folder."""
    lines.write.mode("append").parquet(folder)


def frozen_quick_probability(df: DataFrame, medians: dict[str, float]) -> Column:
    """SC2 with frozen medians (fitted on a batch, e.g. with
    ``transforms.fit_medians``): row-local, so stream-safe."""
    cols = [(c, F.coalesce(column_to_double(df, c), F.lit(float(v)))) for c, v in medians.items()]
    return R.clamp(R.plain_rule_score(cols))


def score_stream(stream: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Decorate a stream with the four result columns (SC2 + SC5/SC7/SC8)."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame")
    missing = [c for c in medians if c not in stream.columns]
    if missing:
        raise ValueError(f"frozen statistics for absent columns: {missing}")
    return decorate(stream, frozen_quick_probability(stream, medians), "six")


def windowed_rates(scored: DataFrame, ts: str = "order_ts", window: str = "30 days",
                   watermark: str | None = "60 days") -> DataFrame:
    """Per event-time window: lines, predicted returns, actual returns."""
    src = scored.withWatermark(ts, watermark) if watermark else scored
    actual = F.when(F.col("return_status") == "Returned", 1).otherwise(0)
    return (src.groupBy(F.window(F.col(ts), window).alias("w"))
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum("Prediction").cast("bigint").alias("predicted_returns"),
                 F.sum(actual).cast("bigint").alias("actual_returns"))
            .select(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("bigint").alias("window_start_day"),
                    "lines", "predicted_returns", "actual_returns"))


def run_to_parquet(df: DataFrame, path: str, name: str | None = None,
                   available_now: bool = True):
    """Append a streaming frame to a Parquet table.  Exactly-once through the checkpoint folder under
    ``spark.checkpoint.dir``.  Returns the query (already finished when
    ``available_now``)."""
    spark = df.sparkSession
    name = name or f"rl_{uuid.uuid4().hex[:12]}"
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", ckpt).outputMode("append"))
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return q


def stream_medians(lines: DataFrame) -> dict[str, float]:
    """Fit the SC2 medians on a batch of lines (the frozen statistics)."""
    return fit_medians(lines, scoring_columns(lines.select(*ORDER_LINES_COLUMNS)))


def arriving_window_rates(spark: SparkSession, sf_dir: str, slices: int = 4, watermark: str = "60 days") -> DataFrame:
    """X2 as a job that is started again whenever lines have arrived.

    Lines are joined once and land in ``slices`` slices of order dates.  After
    each the stream runs over what is new and goes on from its checkpoint; state
    is a row for each window that the watermark has not closed yet, and closed
    windows are appended to a Parquet table.  Lines later than the watermark
    would be left out; within a slice order does not matter.  A last row far
    ahead closes the windows that remain."""
    lines = order_lines_with_dates(spark, sf_dir)
    used = scoring_columns(lines.select(*ORDER_LINES_COLUMNS))
    # what is scored and counted is stored and lands, not the whole line
    lines = materialize(lines.select(*used, "return_status", "order_date", "order_ts"))
    medians = fit_medians(lines, used)
    lo, hi = lines.agg(F.min("order_date"), F.max("order_date")).first()
    home = scratch_path(spark, "streams")
    landing, out = os.path.join(home, "landing"), os.path.join(home, "rates")
    if lo is None:
        return spark.createDataFrame([], "window_start_day bigint, lines bigint, predicted_returns bigint, actual_returns bigint")
    days = (hi - lo).days + 1
    place = F.floor(F.datediff("order_date", F.lit(lo)) * slices / days)
    last = (hi - date(1970, 1, 1)).days
    far = spark.range(1).select(*[(F.timestamp_seconds(F.lit((last + 3650) * 86400)) if c == "order_ts" else F.lit(None).cast(t)).alias(c)
                                  for c, t in lines.dtypes])
    for part in [lines.where(place == i) for i in range(slices)] + [far, far]:
        land(part, landing)
        rates = windowed_rates(score_stream(lines_stream(spark, landing, lines.schema), medians), watermark=watermark)
        run_to_parquet(rates, out, os.path.basename(home))
    closed = spark.read.schema(rates.schema).parquet(out)
    return closed.where(F.col("window_start_day") <= last)
