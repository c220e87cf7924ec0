"""Operator 2: held-out accuracy, and a fit against a known model."""

from __future__ import annotations

import numpy as np
import pytest

from returnlens.llm import toxicity as X

from ..conftest import SF_MID
from .helpers import AWKWARD, docs_of


def test_fit_recovers_a_known_ordinal_model():
    rng = np.random.default_rng(0)
    w, theta = np.array([2.0, -1.0, 0.0, 1.0]), np.array([-0.5, 1.5])
    x = rng.integers(0, 2, (20_000, 4)).astype(float)
    u = rng.random(20_000)
    below = 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None])))
    grade = (u[:, None] > below).sum(1)
    got_w, got_theta = X.fit_ordinal(x, grade, np.ones(20_000))
    assert np.allclose(got_w, w, atol=0.1) and np.allclose(got_theta, theta, atol=0.1)
    model = X.Ordinal(list("abcd"), got_w, got_theta)
    p = model.probabilities(x @ got_w)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and np.all(np.diff(got_theta) > 0)
    assert abs(model.severity(x @ got_w).mean() - grade.mean()) < 0.02


def test_weights_count_as_copies():
    rng = np.random.default_rng(1)
    x, grade = rng.integers(0, 2, (300, 3)).astype(float), rng.integers(0, 3, 300)
    weight = rng.integers(1, 4, 300)
    a = X.fit_ordinal(x, grade, weight.astype(float))
    b = X.fit_ordinal(np.repeat(x, weight, 0), np.repeat(grade, weight), np.ones(weight.sum()))
    assert np.allclose(a[0], b[0], atol=1e-4) and np.allclose(a[1], b[1], atol=1e-4)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{SF_MID}/labels.parquet")


def test_held_out_documents(spark, tables):
    docs, labels = tables
    model = X.fit(docs, labels.where("doc_id % 2 = 0"))
    got = X.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    # Some toxic labels are noise: their documents hold no telling word.
    assert not [r.doc_id for r in got if r.rejected and r.toxic == 0]
    assert sum(r.rejected for r in got) >= 0.5 * sum(r.toxic for r in got) > 0


def test_severity_rises_with_evidence(spark, tables):
    model = X.fit(*tables)
    some = model.words[:6]
    out = X.score(docs_of(spark, [None, "", "plain words", some[0], " ".join(some), " ".join(some).upper() + "!"]), model)
    s = {r.doc_id: r.expected_severity for r in out.collect()}
    assert s[0] == s[1] == s[2] < X.REJECT <= s[3] < s[4] == s[5] <= 2


def test_no_labels_awkward_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    df = docs_of(spark, AWKWARD)
    model = X.fit(df, none)
    assert {(r.expected_severity, r.grade, r.rejected) for r in X.score(df, model).collect()} == {(0.0, 0, False)}
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (99999, 0)], "doc_id bigint, toxic int")
    assert X.fit(df, one).words == []
    assert X.score(docs_of(spark, []), model).count() == 0


def test_keep_clean_keeps_columns_and_clean_rows(spark, tables):
    docs, labels = tables
    model = X.fit(docs, labels)
    full = spark.read.parquet(f"{SF_MID}/documents.parquet").selectExpr("*", "1 AS grade", "'x' AS rejected")
    kept = X.keep_clean(full, model)
    assert kept.columns == full.columns
    bad = {r.doc_id for r in X.score(docs, model).where("rejected").collect()}
    assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
