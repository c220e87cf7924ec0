"""The pipeline, stage by stage against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from returnlens.llm import bpe, mixing, toxicity

from ..conftest import SF_SMALL
from .test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, SF_SMALL), "test")
        out.append(docs.collect())
    return out


def test_toxicity_removes_rejected_only(spark, stages):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("rejected").collect()}
    assert sorted(map(tuple, stages[1])) == sorted(tuple(r) for r in stages[0] if r.doc_id not in bad) and bad


def test_near_duplicates_leave_one_of_each_group(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    roots = slow_components([slow_fingerprint(r.text) for r in rows], 3)
    assert sorted(map(tuple, stages[2])) == sorted(tuple(rows[i]) for i in set(roots))
    assert len(stages[2]) < len(rows)


def test_mixing_repeats_rows_as_planned(spark, stages):
    before = spark.createDataFrame(stages[2], spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema)
    plan = Counter({r.doc_id: r.copies for r in mixing.mix(before, [5, 2, 1]).collect()})
    assert Counter(r.doc_id for r in stages[3]) == +plan
    assert set(map(tuple, stages[3])) <= set(map(tuple, stages[2]))


def test_encoding_covers_all_rows(stages):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def digest(r):
        ids = enc.encode_ordinary(r.text)
        return r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()

    assert sorted(map(tuple, stages[4])) == sorted(map(digest, stages[3]))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, C.run(spark, SF_SMALL).collect())) == sorted(map(tuple, stages[4]))


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, size string"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 2, "x"), (3, "one two three four", "en", "a", 18, 3, "x"),
            (3, "one two three four", "en", "a", 18, 3, "x"), (None, "w " * 5000, "en", "b", 10000, 4, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            docs = stage(spark, docs, SF_SMALL)
            if name != C.STAGES[-1][0]:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "size"]
        assert docs.count() >= (2 if data else 0)
