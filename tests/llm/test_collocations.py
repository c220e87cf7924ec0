"""Operator 11 against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from returnlens.llm import collocations as C
from returnlens.llm import rolling

from .helpers import AWKWARD


def slow(rows, max_words=3, min_count=10, percent=50, top=2000):
    f = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for size in range(1, max_words + 1):
                f.update((lang or "und", tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    total = Counter()
    for (lang, w), n in f.items():
        total[lang] += n * (len(w) == 1)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in cand.items():
        if any(100 * b >= percent * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
               for (other, v), b in cand.items() if other == lang and len(v) > len(w)):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "C", "d", "Éé", "é", "x-y", "the", "of", "q\x00r"]
    marks = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", " ; "]
    return [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 120)))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(None, a, b, 1, "clash") for a, b in rows], "doc_id bigint, lang string, text string, n int, phrase string")


#: Plain; every text is cut and tasks send often; nine bits, so most fingerprints collide.
SETTINGS = {"plain": C.Settings(), "small windows": C.Settings(window=20, held=50), "collisions": C.Settings(kept=0x1FF << 50)}


@pytest.mark.parametrize("setting", SETTINGS)
@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_equals_brute_force(spark, setting, max_words):
    rows = rows_of(max_words, 60) + [("en", t) for t in AWKWARD if t is None or "ab " not in t] + [("en", "one two three four. " * 12)] * 2
    assert got(C.collocations(docs(spark, rows), max_words=max_words, top=50, how=SETTINGS[setting])) == slow(rows, max_words, top=50)


def test_window_inside_a_long_text(spark):
    rows = [("en", "ab " * 30_000 + "cd ef gh " * 50 + "w" * 5000)] * 2
    assert got(C.collocations(docs(spark, rows), how=C.Settings(window=1000))) == slow(rows)


def test_empty(spark):
    assert got(C.collocations(docs(spark, []))) == []
    assert got(C.collocations(docs(spark, [(None, None), ("en", ""), ("en", " .,")]))) == []


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, n bigint")
    assert C.scored(phrases).first().score == 10**6 * (big - 1) ** 2 // big**2


def test_prefix_polynomials_hash_equal_slices_alike():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    p = rolling.Prefixes(data)
    starts = rng.integers(0, 2990, 4000)
    ends = starts + rng.integers(1, 7, 4000)
    texts = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for hashes in (p.fingerprints(starts, ends), p.checks(starts, ends)):
        seen = {}
        for t, h in zip(texts, hashes.tolist()):
            assert seen.setdefault(t, h) == h
        assert len(set(seen.values())) == len(seen)


def test_sieve_lets_all_members_pass(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(-2**63, 2**63, 3000)
    sieve = C.Sieve(C.sieve_of(spark.createDataFrame([(int(f),) for f in fps], "fp bigint")))
    assert sieve.passes(fps.view(np.uint64)).all()
    assert sieve.passes(rng.integers(0, 2**64, 10_000, dtype=np.uint64)).mean() < 0.01


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E
    from ..conftest import SF_SMALL
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(E.queries()["op11_collocations"](spark, SF_SMALL)) == slow(rows)
