"""Toxicity grades by cumulative-link ordinal regression.

Features are the words of a document that set toxic labelled documents apart
(sparse, 0 or 1 each).  All severity thresholds share one weight vector:
P(grade <= k) = sigmoid(threshold_k - weights . features), thresholds in
ascending order.  The output is the expected grade.

The model is fitted on a bounded sample: ``sample_each`` labelled documents of
each class (those with the smallest hashes of their ids), weighted back to the
classes' counts over all labels; words and documents are counted as Spark jobs
and at most ``sample_each`` x 2 rows of ``max_words`` features reach the driver.
Labels say toxic or not; severity among toxic documents is graded by how many
of the telling words they hold.  Scoring is row-local and covers whole texts.

Edge cases: a null or empty text has no features; repeated rows are scored
each; labels that are null or without a document are not used, of several
labels for a document the highest counts; without labels of both classes every
document has severity 0; extra columns pass through ``keep_clean`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD = re.compile(r"[^\W\d_]+")
GRADES = 3
#: A telling word is this much more frequent in toxic documents, by that many
#: standard errors, and in so many of them.
LIFT, ERRORS, LEAST = 10.0, 5.0, 3
RIDGE = 0.02
REJECT = 0.4


def words(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) <= 64}


@dataclass
class Ordinal:
    """A fitted cumulative-link model; no words and thresholds: grade 0."""

    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), P(grade = 1), ..."""
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))
        edges = np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))])
        return np.diff(edges, axis=1)

    def severity(self, scores: np.ndarray) -> np.ndarray:
        p = self.probabilities(scores)
        return p @ np.arange(p.shape[1])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Fisher scoring with step halving."""
    n, v = x.shape
    k = int(grade.max())
    shares = np.cumsum(np.bincount(grade, weight, k + 1))[:-1] / weight.sum()
    theta = np.log(shares / (1 - shares))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(k))
    w = np.zeros(v)

    def parts(w, theta):
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - (x @ w)[:, None], -30, 30)))
        edge = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        return np.maximum(np.diff(edge, axis=1), 1e-12), edge * (1 - edge)

    def loss(w, theta):
        p, _ = parts(w, theta)
        return -(weight * np.log(p[np.arange(n), grade])).sum() + ridge / 2 * w @ w

    now = loss(w, theta)
    for _ in range(rounds):
        p, f = parts(w, theta)
        d_eta = -np.diff(f, axis=1)                                     # of each p by the score
        d_theta = np.zeros((n, k + 1, k))                               # of each p by each threshold
        for j in range(k):
            d_theta[:, j, j], d_theta[:, j + 1, j] = f[:, j + 1], -f[:, j + 1]
        at = np.arange(n)
        g_eta = weight * d_eta[at, grade] / p[at, grade]
        g = np.concatenate([x.T @ g_eta - ridge * w, ((weight / p[at, grade])[:, None] * d_theta[at, grade]).sum(0)])
        i_ee = weight * (d_eta**2 / p).sum(1)
        i_et = weight[:, None] * np.einsum("nk,nkj->nj", d_eta / p, d_theta)
        i_tt = np.einsum("n,nki,nkj->ij", weight, d_theta / p[:, :, None], d_theta)
        cross = x.T @ i_et
        info = np.block([[x.T @ (x * i_ee[:, None]) + ridge * np.eye(v), cross], [cross.T, i_tt]])
        step, size = np.linalg.solve(info + 1e-9 * np.eye(v + k), g), 1.0
        while size > 1e-6:
            w2, t2 = w + size * step[:v], theta + size * step[v:]
            if np.all(np.diff(t2) > 0) and (after := loss(w2, t2)) <= now:
                break
            size /= 2
        else:
            break
        w, theta, gain, now = w2, t2, now - after, after
        if gain < 1e-7 * max(1.0, abs(now)):
            break
    return w, theta


def with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, grade, words) of sampled rows (doc_id, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words(t.as_py() or "")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.string()))],
                                             names=["doc_id", "toxic", "words"])

    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, sample_each: int = 4_000, max_words: int = 512) -> Ordinal:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    labels = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
              .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    total = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    parts = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_each) for t in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))                   # at most 2 x sample_each short rows
    sample = stored(with_words(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").join(chosen, "doc_id")), "toxic-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Ordinal()
    seen = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    p1, p0 = (F.col("t") + 0.5) / (n[1] + 1), (F.col("c") + 0.5) / (n[0] + 1)
    pool = (F.col("t") + F.col("c") + 1.0) / (n[1] + n[0] + 2)
    z = (p1 - p0) / F.sqrt(pool * (1 - pool) * (1 / n[1] + 1 / n[0]))
    telling = [r.word for r in seen.withColumn("z", z).where((F.col("z") >= ERRORS) & (p1 >= LIFT * p0) & (F.col("t") >= LEAST))
               .orderBy(F.desc("z"), "word").limit(max_words).collect()]
    if not telling:
        return Ordinal()
    rows = sample.select("toxic", F.array_intersect("words", F.lit(telling)).alias("words")).collect()
    place = {w: i for i, w in enumerate(telling)}
    x = np.zeros((len(rows), len(telling)))
    for i, r in enumerate(rows):
        x[i, [place[w] for w in r.words or ()]] = 1
    toxic, evidence = np.array([r.toxic for r in rows]), x.sum(1)
    severe = max(2.0, float(np.median(evidence[(toxic == 1) & (evidence > 0)])) if (evidence[toxic == 1] > 0).any() else 2.0)
    grade = np.where(toxic == 1, np.where(evidence >= severe, 2, 1), 0)
    if not (grade == 1).any():
        grade = np.minimum(grade, 1)
    weight = np.where(toxic == 1, total[1] / n[1], total[0] / n[0])
    weight *= len(rows) / weight.sum()
    w, theta = fit_ordinal(x, grade, weight)
    return Ordinal(telling, w, theta)


class Scorer:
    """A model as the workers use it."""

    def __init__(self, model: Ordinal) -> None:
        self.model, self.weight = model, dict(zip(model.words, model.weights.tolist()))

    def scores(self, texts: pa.Array) -> np.ndarray:
        weight = self.weight
        known = weight.keys()
        return np.array([sum(weight[w] for w in sorted(known & words(t.as_py() or ""))) for t in texts], float)

    def rejected(self, scores: np.ndarray, reject: float) -> np.ndarray:
        return self.model.severity(scores) >= reject


def score(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """(doc_id, expected_severity, grade, rejected) of each row (doc_id, text);
    the grade is the likeliest one."""
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scorer.scores(batch.column(1))
            severity = scorer.model.severity(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(scorer.model.probabilities(s).argmax(1).astype(np.int32)),
                 pa.array(severity >= reject)], names=["doc_id", "expected_severity", "grade", "rejected"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(
        run, "doc_id bigint, expected_severity double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns."""
    scorer, text = Scorer(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~scorer.rejected(scorer.scores(batch.column(text)), reject)))

    return docs.mapInArrow(run, docs.schema)
