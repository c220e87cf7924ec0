"""Summaries and evaluation against actual returns (AG6-AG12, AG21).

Each summary is one aggregate (partial aggregation on every task, one small
final merge).  The ROC curve and area work on the table of distinct scores with
positive/negative counts, and take their running sums from
``prefix.running_sums`` — exact, and never one task for all scores.  The best
threshold needs no such table: bins of scores are cut where it may lie.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize
from .prefix import running_sums

#: Bins of the first round of ``youden_cut``, and at most about as many in a later one.
FIRST_BINS, SPLITS = 1_024, 4_096


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _round6(c: Column) -> Column:
    return F.round(c, 6)


def score_summary(df: DataFrame, p="Return_Probability", d="Prediction") -> DataFrame:
    """AG6: total, predicted returns / non-returns, predicted rate, mean
    probability, and the three risk counts.  Doubles rounded to 6 places."""
    p, d = _c(p), _c(d)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum(d), F.lit(0)).cast("bigint").alias("predicted_returns"),
        (F.count(F.lit(1)) - F.coalesce(F.sum(d), F.lit(0))).cast("bigint").alias("predicted_non_returns"),
        _round6(F.avg(d.cast("double"))).alias("return_rate"),
        _round6(F.avg(p)).alias("avg_probability"),
        F.count_if(p > K.RISK_HIGH).alias("high_risk_count"),
        F.count_if((p > K.RISK_LOW) & (p <= K.RISK_HIGH)).alias("medium_risk_count"),
        F.count_if(p <= K.RISK_LOW).alias("low_risk_count"),
    )


def probability_distribution(df: DataFrame, p="Return_Probability", cut: float = 0.5,
                             variant: str = "strict") -> DataFrame:
    """AG7: mean, population std, min, max and the shares above / below the
    cut.  ``strict``: p > cut and p < cut; ``quick``: p > cut and p <= cut;
    ``tuned``: p >= cut and p < cut."""
    p = _c(p)
    above = p >= cut if variant == "tuned" else p > cut
    below = p <= cut if variant == "quick" else p < cut
    return df.agg(
        _round6(F.avg(p)).alias("probability_mean"),
        _round6(F.stddev_pop(p)).alias("probability_std"),
        F.min(p).alias("probability_min"),
        F.max(p).alias("probability_max"),
        _round6(F.avg(above.cast("double"))).alias("share_above"),
        _round6(F.avg(below.cast("double"))).alias("share_below"),
    )


def confusion(df: DataFrame, actual="actual", predicted="Prediction") -> DataFrame:
    """AG8: always the four cells tn, fp, fn, tp (zero when a class is absent)."""
    a, p = _c(actual), _c(predicted)
    return df.agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"),
    )


def metrics_from_confusion(cm: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """AG9 from AG8: accuracy, precision, recall, F1; a zero division gives 0.
    ``extra`` columns of ``cm`` are carried along."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0))
    return cm.select(
        "tn", "fp", "fn", "tp",
        _round6(F.coalesce(F.try_divide(tp + tn, total), F.lit(0.0))).alias("accuracy"),
        _round6(precision).alias("precision"),
        _round6(recall).alias("recall"),
        _round6(f1).alias("f1"),
        *extra,
    )


def classification_metrics(df: DataFrame, actual="actual", predicted="Prediction") -> DataFrame:
    """AG8 + AG9 in one aggregate."""
    return metrics_from_confusion(confusion(df, actual, predicted))


def classification_report(df: DataFrame, actual="actual", predicted="Prediction") -> DataFrame:
    """AG8 + AG9 + AG21 from one aggregate."""
    a, p = _c(actual), _c(predicted)
    agg = df.agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        _round6(F.avg(a.cast("double"))).alias("actual_rate"),
        _round6(F.avg(p.cast("double"))).alias("predicted_rate"))
    return metrics_from_confusion(agg, ("actual_rate", "predicted_rate"))


def actual_vs_predicted(df: DataFrame, actual="actual", predicted="Prediction") -> DataFrame:
    """AG21: mean actual return rate beside the mean predicted rate."""
    return df.agg(_round6(F.avg(_c(actual).cast("double"))).alias("actual_rate"),
                  _round6(F.avg(_c(predicted).cast("double"))).alias("predicted_rate"))


# ---------------------------------------------------------------------------
# ROC family
# ---------------------------------------------------------------------------


def score_counts(df: DataFrame, score="score", label="label") -> DataFrame:
    """(score, pos, neg) per distinct non-null score (partial aggregation
    collapses hot scores before the shuffle).

    NULL scores are counted out inside the aggregate and their group dropped
    by a condition on the counts.  A row filter on the score would be pushed
    down into the scoring joins as a join condition, where the whole score
    expression is evaluated a second time per joined row (5x slower at
    sf0.1); a condition on aggregate results stays above the aggregate."""
    s, y = _c(score), _c(label)
    known = F.col("score").isNotNull()
    positive = F.coalesce(F.col("y") == 1, F.lit(False))
    return (df.select(s.cast("double").alias("score"), y.cast("int").alias("y"))
            .groupBy("score")
            .agg(F.count_if(known & positive).alias("pos"),
                 F.count_if(known & ~positive).alias("neg"))
            .where((F.col("pos") + F.col("neg")) > 0))


def _class_totals(counts: DataFrame) -> tuple[int, int]:
    r = counts.agg(F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total")).collect()[0]
    return int(r["pos_total"] or 0), int(r["neg_total"] or 0)


def roc_curve(df: DataFrame, score="score", label="label") -> DataFrame:
    """AG11: one row per distinct score, descending: true and false positive
    counts and rates at threshold = score (score >= threshold is positive).
    The distinct-score table is checkpointed: every later job reads it
    instead of re-running the plan that scored the rows."""
    counts = materialize(score_counts(df, score, label))
    P, N = _class_totals(counts)
    cum = running_sums(counts, [], "score", ["pos", "neg"], descending=True)
    return cum.select(
        "score",
        F.col("cum_pos").alias("tps"),
        F.col("cum_neg").alias("fps"),
        (F.col("cum_pos") / F.lit(float(P)) if P else F.lit(None).cast("double")).alias("tpr"),
        (F.col("cum_neg") / F.lit(float(N)) if N else F.lit(None).cast("double")).alias("fpr"),
    )


def roc_auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """AG10: exact area under the ROC curve with tied scores counted half
    (the Mann-Whitney form); NULL when only one class occurs."""
    counts = materialize(score_counts(df, score, label))
    cum = running_sums(counts, [], "score", ["neg"], descending=False)
    # negatives strictly below this score = cum_neg - neg; the sum reaches twice
    # positives x negatives, beyond BIGINT from about five billion rows on
    pos = F.col("pos").cast("decimal(18,0)")
    twice_below = (F.lit(2) * F.col("cum_neg") - F.col("neg")).cast("decimal(19,0)")
    twice_u = F.sum((pos * twice_below).cast("decimal(38,0)"))
    agg = cum.agg(twice_u.alias("u2"), F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"))
    P, N = F.col("pos_total"), F.col("neg_total")
    return agg.select(
        F.when((P > 0) & (N > 0),
               F.col("u2").cast("double") / (F.lit(2.0) * P.cast("double") * N.cast("double")))
        .alias("auc"),
        P.cast("bigint").alias("positives"),
        N.cast("bigint").alias("negatives"))


def _edges(lo: float, hi: float, parts: int) -> set[float]:
    """Cuts of [lo, hi] that leave both ends in bins of their own, about ``parts``."""
    step = hi / parts - lo / parts
    return {e for e in (lo + step * i for i in range(1, parts)) if lo < e <= hi} or {hi}


def _bins(rows: DataFrame, edges: Sequence[float]) -> list[Row]:
    """(bin, pos, neg, lo, hi) of the scores between neighbours of ``edges``, from
    the highest; infinite scores and NaN, the highest of all, have their own."""
    cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="score", outputCol="at", handleInvalid="keep")
    s, top = F.col("score"), float(len(edges) + 2)
    place = (F.when(F.isnan(s), F.lit(top + 1)).when(s == float("inf"), F.lit(top))
             .when(s == float("-inf"), F.lit(-1.0)).otherwise(F.col("at")))
    found = (cut.transform(rows).groupBy(place.alias("bin"))
             .agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"), F.min("score").alias("lo"), F.max("score").alias("hi")))
    return sorted(found.collect(), key=lambda b: -b["bin"])


def youden_cut(df: DataFrame, score="score", label="label") -> dict[str, float | int | None]:
    """AG12 by branch and bound over bins of scores: threshold, tps, fps at it, and
    the positives and negatives.  Exact: J is compared in whole numbers.

    A bin's counts bound J for every cut inside it: all its positives and none of
    its negatives above the cut.  Bins whose bound stays below the best J at a
    bin's edge are done, and so are bins of one score or of one class; the others,
    highest bounds first, are cut again.  Scores are stored once and no round
    shuffles or collects more than a row for each of ``SPLITS`` bins and task,
    however many distinct scores there are."""
    narrow = df.select(_c(score).cast("double").alias("score"), F.coalesce(_c(label).cast("int") == 1, F.lit(False)).alias("y"))
    rows = materialize(narrow).where(F.col("score").isNotNull())
    shares = F.array(*[F.lit(i / FIRST_BINS) for i in range(1, FIRST_BINS)])
    seen = rows.agg(F.percentile_approx("score", shares, 10 * FIRST_BINS)).first()[0] or []
    bins = _bins(rows, sorted({e for e in seen if math.isfinite(e)}) or [0.0])
    P, N = sum(b["pos"] for b in bins), sum(b["neg"] for b in bins)
    best, at = 0, {"threshold": None, "tps": 0, "fps": 0}
    if not P or not N:
        return at | {"positives": P, "negatives": N}
    waiting: list[tuple[int, float, float, int, int]] = []          # (-bound, lo, hi, tps above, fps above)

    def visit(children: Sequence[Row], tps: int, fps: int) -> None:
        nonlocal best, at
        for b in children:
            if b["pos"] and b["neg"] and b["lo"] < b["hi"]:
                heapq.heappush(waiting, (fps * P - (tps + b["pos"]) * N, b["lo"], b["hi"], tps, fps))
            tps, fps = tps + b["pos"], fps + b["neg"]
            j = tps * N - fps * P
            if j > best or (j == best > 0 and b["lo"] > at["threshold"]):
                best, at = j, {"threshold": b["lo"], "tps": tps, "fps": fps}

    visit(bins, 0, 0)
    while waiting:
        parents = []
        while waiting and len(parents) < SPLITS // 16:
            bound, lo, hi, tps, fps = heapq.heappop(waiting)
            if -bound > best or (-bound == best > 0 and hi > at["threshold"]):
                parents.append((lo, hi, tps, fps))
        if not parents:
            break
        edges: set[float] = set()
        for lo, hi, _, _ in parents:
            edges |= {lo, math.nextafter(hi, math.inf)} | _edges(lo, hi, max(2, SPLITS // len(parents)))
        inside = rows.where(F.col("score").between(min(p[0] for p in parents), max(p[1] for p in parents)))
        bins = _bins(inside, sorted(e for e in edges if math.isfinite(e)))
        parents.sort()
        starts = [p[0] for p in parents]
        children: dict[int, list[Row]] = {}
        for b in bins:
            k = bisect.bisect_right(starts, b["lo"]) - 1
            if k >= 0 and b["hi"] <= parents[k][1]:
                children.setdefault(k, []).append(b)
        for k in sorted(children, reverse=True):
            visit(children[k], *parents[k][2:])
    return at | {"positives": P, "negatives": N}


def youden_threshold(df: DataFrame, score="score", label="label") -> DataFrame:
    """AG12: the score maximising TPR - FPR, the highest such score on ties.
    One class only → 0.5.  When no score beats J = 0 the best cut is above
    every score: NULL (nothing is positive)."""
    cut = youden_cut(df, score, label)
    P, N = cut["positives"], cut["negatives"]
    row = (cut["threshold"], cut["tps"] / P - cut["fps"] / N) if P and N else (0.5, None)
    return df.sparkSession.createDataFrame([row], "threshold double, youden_j double").select("threshold", _round6(F.col("youden_j")).alias("youden_j"))


def best_threshold(df: DataFrame, score="score", label="label") -> float | None:
    """AG12 as a driver value (one number) for use in SC6."""
    return youden_threshold(df, score, label).collect()[0]["threshold"]
