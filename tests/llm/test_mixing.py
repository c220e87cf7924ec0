"""Operator 6 against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from returnlens.llm import mixing as M
from returnlens.llm import queries

from ..conftest import SF_MID, SF_SMALL
from .helpers import docs_of


def slow_targets(size, weights, cap):
    """size: source to words."""
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(cap * size[s] for s in capped)
        free = sum(w[s] for s in size if s not in capped)
        t = {s: cap * size[s] if s in capped else rest * w[s] / free for s in size}
        over = {s for s in t if s not in capped and t[s] > cap * size[s]}
        if not over:
            return t
        capped |= over
        if len(capped) == len(size):
            return {s: cap * size[s] for s in size}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_op6_sizes_targets_and_taken(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {d: len(re.findall(M.WORDS, r.text or "")) for d, r in docs.items()}
    by_source = Counter()
    for d, r in docs.items():
        by_source[r.source] += size[d]
    want = slow_targets(by_source, [5, 2, 1], 3.0)
    rows = queries.op6_mixing(spark, sf).collect()
    assert len(rows) == len(docs)
    taken, largest = Counter(), Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s]) and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in by_source:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], min(largest[s], 60)), (s, taken[s], want[s])
    again = queries.op6_mixing(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_rates_solve_the_dual(spark):
    rows = [(i, "a" if i % 3 else "b", " ".join(["w"] * (1 + i * 7 % 40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sizes = M.sized(df)
    goals = M.targets(sizes, [5, 1], 1.0, 3.0)
    for r in M.duals(sizes, goals).collect():
        own = [1 + i * 7 % 40 for i in range(400) if ("a" if i % 3 else "b") == r.key[1:]]
        got = sum(s * min(3.0, math.exp(min(r.lam * s / r["mean"], math.log(3)))) for s in own)
        assert math.isclose(got, r.target, rel_tol=2e-6)


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "x", "a b"), (3, "x", "a b"), (None, None, "one two three"), (4, "é", "w " * 50), (5, "Z", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS size", "2 AS rate")
    out = M.mix(df, [5, 2, 1]).collect()
    assert len(out) == len(rows) and sum(r.size for r in out) == 58
    want = slow_targets({None: 3, "x": 4, "é": 50, "Z": 1}, [5, 2, 1], 3.0)
    assert sorted({round(r.target, 6) for r in out}) == sorted({round(v, 6) for v in want.values()})
    mixed = M.mixed(df, [5, 2, 1])
    assert mixed.columns == df.columns
    assert mixed.where("size(filter(split(text, ' '), w -> w <> '')) > 0").count() == sum(r.copies for r in out if r["size"])
    assert M.mix(docs_of(spark, []), [1]).count() == 0 and M.mixed(docs_of(spark, []), [1]).count() == 0
    assert M.mix(docs_of(spark, ["", None]), [1]).agg({"copies": "sum"}).first()[0] == 2


def test_columns_of_any_name_survive(spark):
    names = ["__id", "__hash", "__copies", "__rows", "__place", "__times", "__copy", "___copy", "copies", "key", "rate"]
    df = docs_of(spark, ["a b c", "d e", "a b c d"]).selectExpr("*", *[f"doc_id + {i} AS {n}" for i, n in enumerate(names)])
    out = M.mixed(df, [1])
    assert out.columns == df.columns
    assert all(r[n] == r.doc_id + i for r in out.collect() for i, n in enumerate(names)) and out.count() > 0
