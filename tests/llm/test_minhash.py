"""Operator 12 against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from returnlens.llm import minhash as M

from .helpers import AWKWARD, docs_of


def slow_set(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < k:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def slow(rows, percent=85, k=5):
    """rows: (doc_id, text)."""
    sets = [slow_set(t, k) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    near = [set() for _ in rows]
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        near[i] = {j for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    component = [None] * len(rows)
    for i in range(len(rows)):
        if component[i] is not None:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        for j in group:
            component[j] = group
    least = [min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in component]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, least)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus(seed):
    """Clouds around a base (copies near it, not near each other), chains, copies
    of copies, short texts, shared passages."""
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 200]))]
        texts.append(base)
        for _ in range(rng.randrange(25)):
            texts.append(edited(rng, base, rng.randrange(1, max(2, len(base) // 45) + 1)))
        chain = base
        for _ in range(rng.randrange(8)):
            texts.append(chain := edited(rng, chain, 1))
        texts.append(base + passage)
        texts += [base[:n] for n in (1, 4, 5, 6, 12, 13)]
    texts = [" ".join(t) for t in texts] + AWKWARD
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,group", [(0, 256), (1, 3), (2, 2)])
def test_equals_brute_force(spark, seed, group):
    df = docs_of(spark, corpus(seed))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(M.near_duplicates(df, group=group)) == slow(rows)


def test_other_thresholds_and_shingles(spark):
    df = docs_of(spark, corpus(3))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(M.near_duplicates(df, shingle=3, percent=92)) == slow(rows, 92, 3)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    df = docs_of(spark, corpus(4)[:60]).selectExpr("*", "1 AS key", "2 AS sig", "3 AS root", "4 AS hash", "5 AS text_hash")
    df = df.unionAll(df).unionAll(df.drop("doc_id").selectExpr("CAST(NULL AS BIGINT) doc_id", "*")).unionAll(
        df.drop("doc_id").selectExpr("CAST(7 AS BIGINT) doc_id", "*"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(M.near_duplicates(df)) == slow(rows)
    nulls = df.drop("doc_id").selectExpr("CAST(NULL AS BIGINT) doc_id", "*")
    assert got(M.near_duplicates(nulls)) == slow([(r.doc_id, r.text) for r in nulls.collect()])
    assert got(M.near_duplicates(docs_of(spark, []))) == []


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        a, b, both = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (30, 40, 300))
        same = (M.signature(np.concatenate([a, both])) == M.signature(np.concatenate([b, both]))).mean()
        errors.append(same - 300 / 370)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert M.floor_of(85) < 85 / 100 * M.HASHES - 15


def test_long_text_has_the_signature_of_its_whole_set():
    hashes = np.random.default_rng(1).integers(0, 2**64, 3 * M.BLOCK + 5, dtype=np.uint64)
    parts = [M.signature(hashes[lo:lo + 100]) for lo in range(0, len(hashes), 100)]
    assert (M.signature(hashes) == np.min(parts, axis=0)).all()


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E
    from ..conftest import SF_MID
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    assert got(E.queries()["op12_minhash"](spark, SF_MID)) == slow(rows)
