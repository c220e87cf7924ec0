"""Reports that need no pass of their own (IO2 with AG1-AG7; AG2, AG17, AG20).

* ``write_observed`` writes a table once and returns aggregates of the rows that it
  wrote, collected by the tasks that wrote them.
* A stored profile has a row for each (part, column), for example a day's: counts,
  bins and a sketch of the distinct values.  All of them merge, so the profile of
  any range of parts is a merge of rows, without the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.coerce import column_to_double, qcol


def _in_own_session(df: DataFrame) -> DataFrame:
    """``df`` in a session with the same settings and tables.  A session that has
    observed something can't be sent to tasks any more, as the summaries of fitted
    tree models are that hold it; so none of the caller's observes anything."""
    spark = df.sparkSession
    twin = spark._jsparkSession.cloneSession()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(twin, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, SparkSession(spark.sparkContext, twin))


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column]) -> DataFrame:
    """IO2: ``df`` written as Parquet; one row with the aggregates ``metrics``
    of its rows, from the same job."""
    seen = Observation()
    _in_own_session(df).observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.mode("overwrite").parquet(path)
    got = seen.get                                                       # one number for each metric
    # Their types are those of the aggregates, whatever the values.
    types = dict(df.limit(0).agg(*[c.alias(name) for name, c in metrics.items()]).dtypes)
    return df.sparkSession.createDataFrame([tuple(got.get(n) for n in metrics)], ", ".join(f"`{n}` {types[n]}" for n in metrics))


def score_metrics(p: Column, d: Column, columns: Sequence[str], cut: float = 0.5) -> dict[str, Column]:
    """AG6, AG7 and AG2 of scored rows as aggregates: summary, distribution of
    the score ``p``, decisions ``d``, and missing cells of ``columns``."""
    n = F.count(F.lit(1))
    returns = F.coalesce(F.sum(d), F.lit(0)).cast("bigint")
    return {
        "total_records": n, "predicted_returns": returns, "predicted_non_returns": n - returns, "return_rate": F.round(F.avg(d.cast("double")), 6),
        "probability_mean": F.round(F.avg(p), 6), "probability_std": F.round(F.stddev_pop(p), 6), "probability_min": F.min(p), "probability_max": F.max(p),
        "share_above": F.round(F.avg((p > cut).cast("double")), 6), "share_below": F.round(F.avg((p < cut).cast("double")), 6),
        "high_risk_count": F.count_if(p > K.RISK_HIGH), "medium_risk_count": F.count_if((p > K.RISK_LOW) & (p <= K.RISK_HIGH)),
        "low_risk_count": F.count_if(p <= K.RISK_LOW), "missing_cells": F.coalesce(F.sum(sum((qcol(c).isNull().cast("int") for c in columns), F.lit(0))), F.lit(0)).cast("bigint"),
    }


def profile_parts(df: DataFrame, part: Column, bounds: dict[str, tuple[float, float]], others: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(part, column, rows, missing, least, most, bins, sketch): the profile of
    each part of ``df``.  Columns of ``bounds`` are numbers with ``bins`` of equal
    width (values beyond the bounds are in the outer ones), ``others`` are text."""
    cells = [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("text"), column_to_double(df, c).alias("x"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
             for c, (lo, hi) in bounds.items()]
    cells += [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("text"), *[F.lit(None).cast("double").alias(n) for n in ("x", "lo", "hi")]) for c in others]
    long = df.select(part.alias("part"), F.explode(F.array(*cells)).alias("kv")).select("part", "kv.*")
    bin_ = F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1))
    return long.groupBy("part", "column").agg(
        F.count("*").alias("rows"), F.count_if(F.isnull("text")).alias("missing"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.array(*[F.count_if(F.col("x").isNotNull() & (bin_ == i)) for i in range(bins)]).alias("bins"), F.hll_sketch_agg("text", 14).alias("sketch"))


def merged_profile(parts: DataFrame, bins: int = 10) -> DataFrame:
    """(column, rows, missing, least, most, bins, distinct): the profile of all
    rows behind ``parts``, any selection of a stored profile's rows.  ``distinct``
    is the sketch's estimate, within about 1 %."""
    return parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.array(*[F.sum(F.col("bins")[i]) for i in range(bins)]).alias("bins"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
