"""Keyed splits, folds and class weights (SO3, SO4, AG14).

The split is a pure function of the row key: ``md5(seed:key)`` read as a
number, mod 100.  No shuffle, no sampling state, identical on every rerun
and after executor loss, and the same rows land in the same part in any
engine.  Rows with equal keys always stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.coerce import qcol
from ..session import materialize


def key_hash(keys: Sequence[str], seed: int = K.SPLIT_SEED) -> Column:
    """First 32 bits of md5('<seed>:k1:k2...') as a non-negative BIGINT."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts.append(qcol(k).cast("string"))
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def split_train_test(df: DataFrame, keys: Sequence[str], seed: int = K.SPLIT_SEED,
                     test_percent: int = K.TEST_PERCENT) -> DataFrame:
    """SO3: add ``part`` = 'test' for ``test_percent`` % of keys, else 'train'.

    Class-blind, so each class gets the test share in expectation; the
    per-class shares are reported by ``split_report``."""
    h = key_hash(keys, seed) % 100
    return df.withColumn("part", F.when(h < test_percent, F.lit("test")).otherwise(F.lit("train")))


def split_stratified(df: DataFrame, keys: Sequence[str], label: str, seed: int = K.SPLIT_SEED,
                     test_percent: int = K.TEST_PERCENT) -> DataFrame:
    """SO3 with exact shares: of each class the ``test_percent`` % of rows with
    the smallest key hashes are 'test' (rows with equal keys stay together).

    The cut of each class is an order statistic of its hashes, exact from a
    sketch's bracket (``quantiles``), so hashes are neither shuffled nor ranked as a
    whole.  Classes are few: one literal each."""
    from .quantiles import order_statistics
    marked = materialize(df.select(qcol(label).cast("string").alias("label"), key_hash(keys, seed).cast("double").alias("hash")))
    classes = [r["label"] for r in marked.select("label").distinct().collect() if r["label"] is not None]
    cuts = order_statistics(marked, {c: F.when(F.col("label") == c, F.col("hash")) for c in classes}, test_percent / 100,
                            lambda n: [n * test_percent // 100 - 1] if n * test_percent >= 100 else [])
    test = F.lit(False)
    for (c, _), cut in sorted(cuts.items()):
        test = test | ((qcol(label).cast("string") == c) & (key_hash(keys, seed) <= int(cut)))
    return df.withColumn("part", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def assign_folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = K.SPLIT_SEED) -> DataFrame:
    """SO4: add ``fold`` in 0..k-1 (usable as a CrossValidator ``foldCol``)."""
    return df.withColumn("fold", (key_hash(keys, seed) % k).cast("int"))


def split_report(df: DataFrame, label: str = "actual", part: str = "part") -> DataFrame:
    """Rows per (class, part) — the check that the split is stratified."""
    return df.groupBy(qcol(label).alias("label"), qcol(part).alias("part")).agg(
        F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "actual", with_share: bool = False) -> DataFrame:
    """AG14 (+AG13): balanced weight n / (k * n_c) per class, as (label, n,
    [share,] weight)."""
    counts = materialize(df.groupBy(qcol(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__classes"))     # one row
    weight = F.round(F.col("__total") / (F.col("__classes") * F.col("n")), 6).alias("weight")
    share = [F.round(F.col("n") / F.col("__total"), 6).alias("share")] if with_share else []
    return counts.join(total).select("label", "n", *share, weight)


def with_class_weight(df: DataFrame, label: str = "actual", weight_col: str = "weight") -> DataFrame:
    """Attach the AG14 weight to every row (a ``weightCol`` for Spark ML)."""
    w = class_weights(df, label).select(F.col("label").alias("__label"), F.col("weight").alias(weight_col))
    return (df.join(w, qcol(label) == F.col("__label"), "left").drop("__label"))
