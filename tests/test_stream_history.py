"""Customer history on a stream."""

from __future__ import annotations

import os
import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest

from returnlens.streaming import history as SH
from returnlens.streaming.stream import land

START = datetime(2020, 1, 1, tzinfo=timezone.utc)
SCHEMA = "customer_id bigint, order_id bigint, order_ts timestamp, actual int"


def brute(lines, late):
    """(customer, day) -> (prior orders, lines, returns, lines, late lines)."""
    day = lambda r: (r[2] - datetime(1970, 1, 1, tzinfo=timezone.utc)).days
    out = {}
    for c, d in {(r[0], day(r)) for r in lines + late}:
        before = [r for r in lines if r[0] == c and day(r) < d]
        now = [r for r in lines if r[0] == c and day(r) == d]
        prior = (len({(day(r), r[1]) for r in before}), len(before), sum(r[3] for r in before)) if now else (None, None, None)
        out[c, d] = (*prior, len(now), sum(r[0] == c and day(r) == d for r in late))
    return out


def test_equals_brute_force_with_late_lines(spark):
    """Lines arrive out of order within a slice, orders are split over two files, a
    third of the lines have one customer, and a call without news changes nothing."""
    rnd = random.Random(2)

    def line(first, days):
        order = rnd.randint(0, 400)
        return (1 if rnd.random() < 0.34 else rnd.randint(2, 9), order, START + timedelta(days=first + order % days, hours=rnd.randint(0, 23)), rnd.randint(0, 1))

    slices = [[line(20 * i, 20) for _ in range(120)] for i in range(3)]
    late = [line(0, 5) for _ in range(9)] + [(77, 1, START, 1)]             # customer 77 has only a late line
    home = tempfile.mkdtemp(prefix="rl-history-")
    landing = os.path.join(home, "landing")
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in slices[:2] + [slices[2] + late, [(None, None, START + timedelta(days=999), None)]]:
        land(spark.createDataFrame(rows, SCHEMA).repartition(2), landing)
        history = SH.advance(spark, home, schema, "2 days")
    n = history.count()
    assert SH.advance(spark, home, schema, "2 days").count() == n
    got = SH.with_late_lines(spark.createDataFrame([r for s in slices for r in s] + late, SCHEMA), history)
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == brute([r for s in slices for r in s], late)


def test_days_wait_for_the_watermark(spark):
    home = tempfile.mkdtemp(prefix="rl-history-")
    schema = spark.createDataFrame([], SCHEMA).schema
    land(spark.createDataFrame([(1, 1, START, 1), (1, 2, START + timedelta(days=3), 0)], SCHEMA), os.path.join(home, "landing"))
    assert SH.advance(spark, home, schema, "30 days").count() == 0
    assert SH.arriving_history(spark, "/root/testdata/sf0.001", slices=2).where("late_lines > 0").count() > 0


def test_totals_run_on_over_batches_without_a_call_for_each_customer(spark):
    closed = "customer_id bigint, day bigint, orders bigint, lines bigint, returns bigint"
    first, totals = SH.histories(None, spark.createDataFrame([(1, 5, 1, 2, 1), (1, 3, 2, 4, 0), (None, 4, 1, 1, 1)], closed))
    assert sorted(map(tuple, first.collect()), key=str) == sorted([(1, 3, 0, 0, 0, 4), (1, 5, 2, 4, 0, 2), (None, 4, 0, 0, 0, 1)], key=str)
    later, after = SH.histories(totals, spark.createDataFrame([(1, 9, 1, 1, 1), (2, 4, 1, 1, 0), (None, 6, 1, 1, 0)], closed))
    assert sorted(map(tuple, later.collect()), key=str) == sorted([(1, 9, 3, 6, 1, 1), (2, 4, 0, 0, 0, 1), (None, 6, 1, 1, 1, 1)], key=str)
    assert sorted(map(tuple, after.collect()), key=str) == sorted([(1, 4, 7, 2, 9), (2, 1, 1, 0, 4), (None, 2, 2, 1, 6)], key=str)
    assert "Pandas" not in later._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="day 5 of customer 1 was closed before"):
        SH.histories(totals, spark.createDataFrame([(1, 5, 1, 1, 0)], closed))[0].collect()
