"""Keyed split and folds, point-in-time history (X1), stream scoring (X2)."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from returnlens.operators import history as HI
from returnlens.operators import split as SP
from returnlens.plans.views import order_lines_with_dates
from returnlens.streaming import stream as ST

from .conftest import SF_SMALL, rows


def test_split_is_deterministic_and_keyed(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(2000)], "order_id int, line_no int, actual int")
    a = SP.split_train_test(df, ["order_id", "line_no"])
    b = SP.split_train_test(df.repartition(7), ["order_id", "line_no"])
    assert rows(a, "order_id", "part") == rows(b, "order_id", "part")
    share = a.where(F.col("part") == "test").count() / 2000
    assert 0.17 < share < 0.23
    folds = {r[0] for r in SP.assign_folds(df, ["order_id"], 5).select("fold").distinct().collect()}
    assert folds == {0, 1, 2, 3, 4}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "actual int")
    assert rows(SP.class_weights(df), "label", "n", "weight") == [(0, 3, round(4 / 6, 6)), (1, 1, 2.0)]


def test_history_matches_brute_force_with_a_hot_customer(spark):
    rnd = random.Random(11)
    base = dt.date(2020, 1, 1)
    data = []
    for order in range(300):
        cust = 1 if order % 3 == 0 else rnd.randint(2, 30)  # customer 1 holds a third of the lines
        day = base + dt.timedelta(days=rnd.randint(0, 40))
        for line in range(2):
            data.append((order, line, cust, day, rnd.randint(0, 1)))
    df = spark.createDataFrame(data, "order_id int, line_no int, customer_id int, order_date date, actual int")
    got = {(r["order_id"], r["line_no"]): r for r in HI.with_history(df).collect()}
    for oid, ln, cust, day, _ in data:
        earlier = [x for x in data if x[2] == cust and x[3] < day]
        r = got[(oid, ln)]
        assert r["prior_lines"] == len(earlier)
        assert r["prior_orders"] == len({x[0] for x in earlier})
        if earlier:
            assert abs(r["prior_return_rate"] - sum(x[4] for x in earlier) / len(earlier)) < 1e-12
        else:
            assert r["prior_return_rate"] is None


@pytest.fixture
def landed(spark, tmp_path):
    """Joined lines in a landing folder of four files, and the same as a batch."""
    batch = order_lines_with_dates(spark, SF_SMALL)
    for i in range(4):
        ST.land(batch.where(F.col("order_id") % 4 == i).coalesce(1), str(tmp_path / "landing"))
    return ST.lines_stream(spark, str(tmp_path / "landing"), batch.schema, 1), batch, str(tmp_path / "out")


def test_stream_scoring_matches_batch(spark, landed):
    stream, batch, out = landed
    medians = ST.stream_medians(batch)
    ST.run_to_parquet(ST.score_stream(stream, medians).select("order_id", "line_no", "Return_Probability", "Prediction"), out)
    want = batch.select("order_id", "line_no", ST.frozen_quick_probability(batch, medians).alias("p"))
    assert rows(spark.read.parquet(out), "order_id", "line_no", "Return_Probability") == rows(want, "order_id", "line_no", "p")


def test_micro_batches_do_not_read_the_static_tables(spark, landed):
    """Four files, one a micro-batch: the lines were joined before they landed."""
    stream, batch, out = landed
    q = ST.run_to_parquet(ST.score_stream(stream, ST.stream_medians(batch)), out)
    assert sum(p.numInputRows > 0 for p in q.recentProgress) == 4
    assert "orders.parquet" not in q._jsq.explainInternal(True)


def test_windowed_rates_emit_only_closed_windows(spark, landed):
    stream, batch, out = landed
    scored = ST.score_stream(stream, ST.stream_medians(batch))
    ST.run_to_parquet(ST.windowed_rates(scored, window="30 days", watermark="4000 days"), out)
    assert spark.read.parquet(out).count() == 0          # nothing is 4000 days late: no window is closed


def test_arriving_slices_give_all_windows(spark):
    got = ST.arriving_window_rates(spark, SF_SMALL, slices=3)
    batch = order_lines_with_dates(spark, SF_SMALL)
    day = F.floor(F.unix_seconds("order_ts") / 86400)
    want = batch.groupBy((F.floor(day / 30) * 30).alias("d")).count()
    assert rows(got, "window_start_day", "lines") == rows(want, "d", "count")


def test_score_stream_rejects_batch(spark):
    with pytest.raises(ValueError):
        ST.score_stream(spark.createDataFrame([(1.0,)], "item_price double"), {"item_price": 1.0})


def test_stratified_split_has_exact_shares(spark):
    df = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(1000)] + [(5000, 2)], "id int, y int")
    out = SP.split_stratified(df, ["id"], "y")
    got = {(r["label"], r["part"]): r["n"] for r in SP.split_report(out, "y").collect()}
    assert got == {(1, "test"): 28, (1, "train"): 115, (0, "test"): 171, (0, "train"): 686, (2, "train"): 1}
