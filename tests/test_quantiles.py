"""Exact medians and running sums over ranges against brute force, including
a hot value holding a third of the rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from returnlens.operators import quantiles as Q
from returnlens.operators import transforms as TR
from returnlens.operators.prefix import running_sums


def _data(n=3000, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = 42.0 if i % 3 == 0 else rnd.uniform(-50, 500)      # a third of rows share one value
        b = float(rnd.randint(1, 9)) if i % 11 else None
        out.append((a, b))
    return out


def test_medians_match_python(spark):
    data = _data()
    df = spark.createDataFrame(data, "a double, b double")
    got = TR.fit_medians(df, ["a", "b"])
    assert got["a"] == statistics.median([a for a, _ in data])
    assert got["b"] == statistics.median([b for _, b in data if b is not None])


def test_rank_values_every_rank(spark):
    vals = [float(v) for v in [5, 1, 1, 1, 9, 3, 3, 7, 2, 8, 8, 8, 8]]
    long = spark.createDataFrame([("x", v) for v in vals], "column string, value double")
    counts = Q.value_counts(long)
    got = Q.rank_values(counts, {"x": list(range(len(vals)))})
    assert [got[("x", k)] for k in range(len(vals))] == sorted(vals)


def test_running_sums_equal_plain_window(spark):
    rnd = random.Random(1)
    rows = [(float(s), rnd.randint(0, 5), rnd.randint(0, 5)) for s in rnd.sample(range(100000), 2000)]
    df = spark.createDataFrame(rows, "score double, pos int, neg int")
    got = running_sums(df, [], "score", ["pos", "neg"], descending=True)
    w = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("score", F.sum("pos").over(w).alias("cum_pos"), F.sum("neg").over(w).alias("cum_neg"))
    assert sorted(got.select("score", "cum_pos", "cum_neg").collect()) == sorted(want.collect())


def test_label_codes_with_long_common_prefixes(spark):
    rnd = random.Random(4)
    words = ["Customer#%012d" % rnd.randint(0, 4000) for _ in range(3000)]
    nums = [str(rnd.randint(0, 50)) for _ in range(3000)]
    df = spark.createDataFrame(list(zip(words, nums)), "a string, b string")
    enc = TR.fit_label_encoder(df, ["a", "b"])
    got = {(r["column"], r["value"]): r["code"] for r in enc.collect()}
    for col, vals in (("a", words), ("b", nums)):
        for code, v in enumerate(sorted(set(vals))):
            assert got[(col, v)] == code


def test_ranges_split_values_that_share_a_prefix(spark):
    from returnlens.operators.prefix import RANGE, ranged
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([("c", "Customer#%09d" % i, 1) for i in range(2000)], "column string, value string, n int")
        sizes = [r["count"] for r in ranged(df, ["column"], "value").groupBy(RANGE).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) >= 3 and max(sizes) < 1500


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_order_statistics_at_any_share(spark, share):
    """Ranks far from the sketch's bracket are found too: it is opened."""
    rnd = random.Random(int(share * 10))
    vals = [rnd.choice([None, 7.0, 7.0, float("inf"), float("-inf"), rnd.uniform(-9, 9)]) for _ in range(700)]
    df = spark.createDataFrame([(v, None) for v in vals], "x double, y double")
    known = sorted(v for v in vals if v is not None)
    ranks = [0, len(known) // 5, len(known) // 2, len(known) - 1]
    got = Q.order_statistics(df, {"x": F.col("x"), "y": F.col("y")}, share, lambda n: ranks)
    assert got == {("x", k): known[k] for k in ranks}


def test_values_outside_the_bracket_are_not_shuffled(spark, monkeypatch):
    kept = []
    inner = Q._bracketed
    monkeypatch.setattr(Q, "_bracketed", lambda *a: kept.append(inner(*a)) or kept[-1])
    df = spark.range(200_000).select(F.rand(5).alias("x"), (F.col("id") % 5).cast("double").alias("z"))
    got = Q.medians(df, {"x": F.col("x"), "z": F.col("z")})
    want = df.agg(F.percentile("x", 0.5), F.percentile("z", 0.5)).first()
    assert got == {"x": want[0], "z": want[1]}
    assert len(kept) == 1 and kept[0].count() < 200_000 * 10 / Q.SKETCH


def test_a_rank_beyond_the_values_is_an_error(spark):
    with pytest.raises(ValueError):
        Q.order_statistics(spark.range(3).select(F.col("id").cast("double").alias("x")), {"x": F.col("x")}, 0.5, lambda n: [3])
