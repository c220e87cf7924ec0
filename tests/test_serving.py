"""Models reloaded on a stream."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from returnlens.operators import models as ML
from returnlens.streaming import serving as SV
from returnlens.streaming.stream import land, lines_stream


def rows_of(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id", "CAST(id % 4 AS STRING) AS c", "CAST((id % 7) < (id % 4) + 2 AS INT) AS y")


def test_rows_are_scored_once_by_the_newest_version(spark):
    home = tempfile.mkdtemp(prefix="rl-serving-")
    store, landing, out, checkpoint = (os.path.join(home, x) for x in ("models", "landing", "out", "checkpoint"))
    models = [ML.fit(rows_of(spark, 0, n), [], ["c"], "y", "lr", maxIter=20) for n in (50, 90)]
    schema = rows_of(spark, 0, 1).schema

    def go():
        SV.serve(lines_stream(spark, landing, schema, max_files_per_trigger=1), store, out, checkpoint)

    land(rows_of(spark, 0, 40).coalesce(2), landing)
    with pytest.raises(Exception, match="no model"):
        go()
    assert SV.newest(spark, store) is None
    assert SV.publish(spark, store, models[0]) == 1
    go()                                                        # the batch that failed is run again
    land(rows_of(spark, 40, 60).coalesce(1), landing)
    go()
    assert SV.publish(spark, store, models[1]) == 2 and SV.newest(spark, store)[0] == 2
    land(rows_of(spark, 60, 100).coalesce(2), landing)
    go()
    go()                                                        # nothing new
    got = SV.served(spark, out)
    assert sorted(r.id for r in got.collect()) == list(range(100))
    assert {(r.version, r.id < 60) for r in got.collect()} == {(1, True), (2, False)}
    for version, model in enumerate(models, 1):
        want = {r.id: r.p for r in model.score(rows_of(spark, 0, 100)).collect()}
        assert all(r.p == want[r.id] for r in got.where(F.col("version") == version).collect())


def test_a_batch_frame_is_refused(spark):
    with pytest.raises(ValueError):
        SV.serve(rows_of(spark, 0, 3), "a", "b", "c")
