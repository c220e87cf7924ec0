"""Operator 9 against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.llm import queries, topk

from ..conftest import SF_MID


def slow(rows, k=5):
    """rows: distinct (id, integer vector)."""
    out = set()
    for qi, q in rows:
        if qi % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in rows if ci != qi and len(c) == len(q))
        out |= {(qi, rank, ci, -s) for rank, (s, ci) in enumerate(scored[:k], 1)}
    return out


def run(df, k=5, **more):
    rows = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=k, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op9_equals_brute_force(spark):
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.op9_top_k(spark, SF_MID).collect()]
    assert set(got) == slow(rows) and len(got) == len(set(got))


def test_many_shards_blocks_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "LEAST_SHARD", 40)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 5).tolist()) for i in range(300)] + [(1000 + i, [1, 0, 0, 0, 0]) for i in range(200)]
    df = spark.createDataFrame([(i, [x / 256 for x in v], "clash") for i, v in rows + rows[:60]], "vec_id bigint, embedding array<double>, score string")
    assert run(df) == slow(rows)
    assert run(df, k=1) == slow(rows, 1)


def test_odd_vectors_take_no_part(spark):
    good = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (2, [-1.0, -1.0]), (50, [3.0]), (51, [2.0]), (100, [1.0, 1.0, 1.0])]
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1e300, 1.0]), (None, [1.0, 1.0]), (150, None)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>")
    assert run(df) == slow([(i, [math.floor(256 * x) for x in v]) for i, v in good])
    assert run(df.where("vec_id is null")) == set()


@pytest.mark.parametrize("size", [3, 2**20, 2**28])
def test_bounds_keep_the_best(size):
    rng = np.random.default_rng(size)
    v = rng.integers(-size, size, (900, 64)) // (1 + np.arange(64)) ** 2
    v[300:400] = v[7]
    ids, asks = np.arange(900), np.arange(0, 900, 50)
    for at, got, scores in topk.Shard(ids, v).best(ids[asks], v[asks], 5):
        s = v.astype(object) @ v[asks[at]].astype(object)
        want = [i for i in sorted(range(900), key=lambda i: (-s[i], i)) if i != asks[at]][:5]
        assert got.tolist() == want and scores.tolist() == [s[i] for i in want]


def heavy(rng, dims, n=400):
    """Heavy common dimensions, small whole numbers elsewhere: scores of 2^53 and
    more whose order is settled by the last few units.  Row 0 asks."""
    v = np.full((n, dims), 2**27, np.int64)
    v[:, :4] = rng.integers(0, 100, (n, 4))
    v[:, 40:] = rng.integers(-3, 4, (n, dims - 40))
    v[0, :4] = 1
    return v


def test_bounds_of_large_sums_are_not_rounded(spark):
    rng = np.random.default_rng(9)
    for dims in range(64, 124):
        v = heavy(rng, dims)
        s = v.astype(object) @ v[0].astype(object)
        want = [i for i in sorted(range(len(v)), key=lambda i: (-s[i], i)) if i][:5]
        (_, got, scores), = topk.Shard(np.arange(len(v)), v).best(np.array([0]), v[:1], 5)
        assert got.tolist() == want and scores.tolist() == [s[i] for i in want]
    rows = [(i + 1000 * dims, v.tolist()) for dims in (70, 99) for i, v in enumerate(heavy(rng, dims))]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    assert run(df) == slow(rows)


def test_few_copies_are_sent_at_a_million_vectors():
    """Rows of the shuffle over rows of the table, by the sizes alone."""
    n, q, partitions = 10**6, 20_000, 200
    shards = max(-(-n // topk.SHARD), min(partitions, -(-n // topk.LEAST_SHARD)))
    assert (n * -(-q // topk.BLOCK) + q * shards) / n < 4


def test_large_values_are_exact(spark):
    rows = [(i, [float((i * 7919) % 1000 * 2**20), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert run(df, scale=1) == slow([(i, [int(x) for x in v]) for i, v in rows])


def test_large_vectors_take_part_where_their_scores_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-128, 129, 64).tolist()) for i in range(120)]
    for i, x in ((7, 2_560_000_000), (50, 2_560_000_000), (51, -2**50), (52, 2**62), (100, 2**40), (101, 2**62), (102, -2**63 + 1024)):
        rows[i][1][i % 3] = x
    rows[60][1][:3] = rows[61][1][:3] = [0, 0, 0]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    want = set()
    for qi, q in rows[::50]:
        scores = [(-s, ci) for ci, c in rows if ci != qi and -2**63 <= (s := sum(a * b for a, b in zip(q, c))) < 2**63]
        want |= {(qi, rank, ci, -s) for rank, (s, ci) in enumerate(sorted(scores)[:5], 1)}
    assert run(df) == want
    assert {ci for _, _, ci, _ in want} & {7, 50, 51, 52, 100, 101, 102}
