"""Operator 7 against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from returnlens.llm import simhash as S

from .helpers import AWKWARD, docs_of


def slow_fingerprint(text: str | None, k: int = 3) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def slow_components(fps: list[int], bits: int) -> list[int]:
    """Smallest position reachable."""
    a = np.array(fps, np.uint64)
    root = list(range(len(fps)))
    for i in range(len(fps)):
        todo = [i] if root[i] == i else []
        while todo:
            j = todo.pop()
            for m in np.nonzero(np.bitwise_count(a ^ a[j]) <= bits)[0]:
                if root[m] > i:
                    root[m] = i
                    todo.append(int(m))
    return root


def test_fingerprints(spark):
    texts = [*AWKWARD, "One two", "one TWO three four " * 9, "Éa b c d", None]
    got = {r.doc_id: r.fp % 2**64 for r in S.fingerprints(docs_of(spark, texts)).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def clustered(rng, n, spread):
    """Random fingerprints, and chains and clouds of near ones around some."""
    base = rng.integers(0, 2**64, n, dtype=np.uint64).tolist()
    out = list(base)
    for b in base[: n // 3]:
        for _ in range(int(rng.integers(1, spread))):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                b ^= 1 << int(bit)
            out.append(b)
    return out + [0, 1, 2**64 - 1, 0b111, 0b1111]


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_components_equal_brute_force(spark, bits):
    fps = clustered(np.random.default_rng(bits), 300, 8)
    rows = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    classes = {r.fp: r.component_id for r in S.near_duplicates(rows, bits).collect()}
    assert [classes[r.fp] for r in rows.orderBy("doc_id").collect()] == slow_components(fps, bits)


@pytest.mark.parametrize("count", [100, 10**6, 10**8, 10**11])
def test_every_depth_of_tree_finds_all_pairs(count):
    rng = np.random.default_rng(1)
    fps = np.unique(np.array(clustered(rng, 200, 6), np.uint64))
    found = set()
    for t, tree in enumerate(S.trees(count, 3)):
        shards = {}
        for own, (rows, keys) in enumerate(tree.keys(fps)):
            for r, k in zip(rows, keys):
                shards.setdefault(int(k), ([], []))[own > 0].append(int(r))
        for here, queries in shards.values():
            found |= {frozenset((a, b)) for a in here for b in here + queries
                      if a != b and np.bitwise_count(fps[a] ^ fps[b]) <= 3}
    want = {frozenset((a, b)) for a in range(len(fps)) for b in range(a) if np.bitwise_count(fps[a] ^ fps[b]) <= 3}
    assert found == want


def test_dense_shard_equals_brute_force():
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 2**63))
    fps = {center}
    while len(fps) < 900:
        x = center
        for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array([*fps, *rng.integers(0, 2**64, 300, dtype=np.uint64)], np.uint64)
    root = S.shard_links(fps, np.ones(len(fps), bool), 3)
    assert list(root) == slow_components(fps.tolist(), 3)


def test_deduplicated_keeps_one_of_each_component(spark):
    long = " ".join(f"word{i}" for i in range(400))
    texts = [long, "other text here now", long, long.replace("word399", "changed"), None, "", "  ", "other text here now"]
    df = docs_of(spark, texts)
    out = S.deduplicated(df)
    assert out.columns == df.columns
    fps = [slow_fingerprint(t) for t in texts]
    comp = slow_components(fps, 3)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp))
    again = df.unionAll(df).unionAll(df.selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "source", "ids"))
    assert sorted(r.doc_id for r in S.deduplicated(again).collect()) == sorted(set(comp))
    nulls = df.selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "source", "ids")
    assert S.deduplicated(nulls).count() == len(set(comp))
    assert S.deduplicated(docs_of(spark, [])).count() == 0


def test_columns_of_any_name_survive(spark):
    names = ["__id", "__hash", "___id", "fp", "root", "first", "component_id"]
    df = docs_of(spark, ["a b c d", "e f g h", "a b c d"]).selectExpr("*", *[f"doc_id + {i} AS {n}" for i, n in enumerate(names)])
    out = S.deduplicated(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 1]
    assert all(r[n] == r.doc_id + i for r in out.collect() for i, n in enumerate(names))
