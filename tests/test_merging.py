"""Observed writes and profiles that merge."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from returnlens.operators import merging as ME


def test_observed_metrics_are_those_of_the_written_rows(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 10 = 0, NULL, id / 1000) AS p", "CAST(id % 3 = 0 AS INT) AS d", "IF(id % 4 = 0, NULL, 'x') AS t")
    path = os.path.join(tempfile.mkdtemp(prefix="rl-observed-"), "out")
    metrics = ME.score_metrics(F.col("p"), F.col("d"), df.columns)
    got = ME.write_observed(df.repartition(7), path, metrics)
    want = spark.read.parquet(path).agg(*[c.alias(n) for n, c in metrics.items()])
    assert got.schema.simpleString() == want.schema.simpleString() and got.collect() == want.collect()
    assert spark.read.parquet(path).count() == 1000


def test_models_still_score_in_a_session_that_has_observed(spark):
    from returnlens.operators import models as ML
    df = spark.range(200).selectExpr("CAST(id % 13 AS DOUBLE) AS p", "CAST(id % 13 > 5 AS INT) AS d")
    path = os.path.join(tempfile.mkdtemp(prefix="rl-observed-"), "out")
    assert ME.write_observed(df, path, {"n": F.count("*")}).first().n == 200
    assert ML.fit(df, ["p"], [], "d", "rf", numTrees=1, maxDepth=1).score(df).count() == 200


def test_observed_write_of_an_empty_table(spark):
    df = spark.range(0).selectExpr("CAST(id AS DOUBLE) AS p", "CAST(id AS INT) AS d")
    path = os.path.join(tempfile.mkdtemp(prefix="rl-observed-"), "out")
    row = ME.write_observed(df, path, ME.score_metrics(F.col("p"), F.col("d"), df.columns)).first()
    assert row.total_records == 0 and row.probability_mean is None and row.missing_cells == 0


def test_merged_parts_equal_the_profile_of_all_rows(spark):
    df = spark.range(20_000).selectExpr("id % 37 AS day", "IF(id % 9 = 0, NULL, CAST(id * 7919 % 5003 AS DOUBLE)) AS x", "CAST(id % 41 AS STRING) AS c", "CAST(NULL AS DOUBLE) AS none")
    parts = ME.profile_parts(df, F.col("day"), {"x": (0.0, 5000.0), "none": (0.0, 1.0)}, ["c"])
    some = {r["column"]: r for r in ME.merged_profile(parts.where("part < 20")).collect()}
    whole = {r["column"]: r for r in ME.merged_profile(ME.profile_parts(df.where("day < 20"), F.lit(0), {"x": (0.0, 5000.0), "none": (0.0, 1.0)}, ["c"])).collect()}
    for c, got in some.items():
        for field in ("rows", "missing", "least", "most", "bins"):
            assert got[field] == whole[c][field]
    exact = df.where("day < 20").select("x").distinct().where("x IS NOT NULL").count()
    assert abs(some["x"]["distinct"] - exact) <= 0.03 * exact and some["c"]["distinct"] == 41 and some["none"]["distinct"] == 0
    assert sum(some["x"]["bins"]) + some["x"]["missing"] == some["x"]["rows"] and some["none"]["least"] is None
