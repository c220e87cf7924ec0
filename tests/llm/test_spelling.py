"""Operator 13 against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from returnlens.llm import spelling as S

from .helpers import AWKWARD, docs_of


def slow_words(rows, least_length=5, least_count=3, every=97):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= least_count and len(w) >= least_length}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(words: dict[str, int], ratio=2):
    all_near = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in all_near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(all_near[w]), form[w] and words[form[w]]) for w, n in words.items())


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def words_of(spark, words):
    return spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n bigint")


@pytest.mark.parametrize("seed,letters,sizes", [(0, "ab", (1, 6)), (1, "aab", (4, 8)), (2, "abcé", (3, 5)), (3, "xyzÿÀ", (62, 67))])
def test_equals_brute_force(spark, seed, letters, sizes):
    rng = random.Random(seed)
    words = {}
    while len(words) < 150:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))
        for _ in range(rng.randint(0, 4)):                      # and words close to it, around the length of text keys
            words[w] = rng.choice([1, 2, 3, 5, 8, 40, 40, 41])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:] or w, w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
    assert got(S.spelling_variants(words_of(spark, words))) == slow_variants(words)


def test_counts_equal_brute_force(spark):
    texts = [*AWKWARD, "Éléphant éléphant ÉLÉPHANT", "a×b÷c naïve NAÏVE " * 3] * 40
    df = docs_of(spark, texts)
    df = df.unionAll(df.selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "source", "ids"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for every in (3, 97, None):
        out = {r.word: r.n for r in S.word_counts(df, damage_every=every).collect()}
        assert out == slow_words(rows, every=every)


def test_long_runs_chains_and_ties(spark):
    long = "ab" * 5_000
    words = {long: 9, long + "a": 3, long[1:]: 4, "chain": 1, "chains": 2, "chainss": 4, "chainsss": 8, "chainssss": 16,
             "tieaa": 1, "tieab": 2, "tieac": 2, "aaaaa": 5, "aaaa": 5, "aaaaaa": 11}
    assert got(S.spelling_variants(words_of(spark, words))) == slow_variants(words)


def test_keys_grow_with_the_length_only():
    word = "abcde" * 40_000
    keys, kinds = zip(*S.rotation_keys(word))
    assert sum(map(len, keys)) == 2 * len(word) + 1 == sum(map(len, kinds))
    assert max(len(k) for some in keys for k in some) < 64


def test_empty_and_extra_columns(spark):
    assert S.spelling_variants(S.word_counts(docs_of(spark, []))).count() == 0
    df = docs_of(spark, ["hello hello hello hellos"] * 3).selectExpr("*", "1 AS n", "'x' AS word", "2 AS id", "'k' AS key")
    assert got(S.spelling_variants(S.word_counts(df))) == [("hello", None, "hello", 9, 1, None), ("hellos", "hello", "hello", 3, 1, 9)]


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E
    from ..conftest import SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(E.queries()["op13_spelling"](spark, SF_SMALL)) == slow_variants(slow_words(rows))
