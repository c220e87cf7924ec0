"""Model fitting, scoring, search and persistence (ML1-ML7, SC13, TR12,
TR13, AG22, IO3, IO4) on Spark ML.

Preparation uses the library's exact, frozen statistics (median / mode
imputation, population-std scaling) as one projection in front of a Spark ML
``Pipeline`` of ``StringIndexer`` → ``OneHotEncoder`` → ``VectorAssembler`` →
classifier.  It is fitted on the rows a model is fitted on, inside every
cross-validation fold too.  Fitting is distributed by Spark ML; only bounded
statistics and the fitted trees / coefficients live on the driver, and a
categorical column with more than ``MAX_CATEGORIES`` values is refused.

Unknown categories: ``StringIndexer(handleInvalid='keep')`` gives them the
last index and ``OneHotEncoder(dropLast=True)`` drops exactly that slot, so
an unseen or missing category encodes as all zeros (TR12).
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.coerce import qcol
from ..session import materialize
from . import evaluate as EV
from . import split as SP
from . import transforms as TR
from .distinct import sketched_counts
from .quantiles import SKETCH

#: Distinct values a categorical feature may have: each is a slot of the feature vector.
MAX_CATEGORIES = 10_000

#: Bins of a numeric column of ``cut_values``, as many as Spark ML's trees make.
CUTS = 32

# FIXED VALUES - the grids that are searched (ML4): 24 + 12 + 6 candidates.
# A missing depth limit is Spark's deepest, 30; C is the inverse strength.
GRIDS: dict[str, dict[str, list]] = {
    "rf": {"numTrees": [100, 200], "maxDepth": [10, 15, 30], "minSplit": [2, 5], "minInstancesPerNode": [1, 2]},
    "gbt": {"maxIter": [100, 200], "stepSize": [0.01, 0.1], "maxDepth": [3, 6, 30]},
    "lr": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
}
# FIXED VALUES - settings of the three production models (ML1-ML3).
PRODUCTION: dict[str, dict] = {
    "gbt": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 6, "minSplit": 5, "minInstancesPerNode": 2, "subsamplingRate": 0.8},
    "rf": {"numTrees": 200, "maxDepth": 10, "minSplit": 5, "minInstancesPerNode": 2},
    "lr": {"maxIter": 1000, "C": 1.0},
}
BALANCED = {"rf", "lr"}     # the kinds that are fitted with balanced class weights


@dataclass
class Prep:
    """Frozen preparation statistics (TR7, TR8, TR9)."""
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(s: str) -> "Prep":
        d = json.loads(s)
        d["scaler"] = {k: tuple(v) for k, v in d["scaler"].items()}
        return Prep(**d)


def fit_prep(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
             scale: bool = True) -> Prep:
    """Fit imputation and scaling statistics on the training table."""
    prep = Prep(list(numeric), list(categorical))
    prep.medians = TR.fit_medians(df, prep.numeric) if prep.numeric else {}
    prep.modes = TR.fit_modes(df, prep.categorical) if prep.categorical else {}
    if scale and prep.numeric:
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(prep.medians[c])).alias(c)
                             for c in prep.numeric])
        prep.scaler = TR.fit_scaler(filled, prep.numeric)
    return prep


def apply_prep(df: DataFrame, prep: Prep) -> DataFrame:
    """One projection: fill, scale, and text-cast the categorical columns.
    Row-local, so it runs on streams too."""
    out = []
    for c in df.columns:
        if c in prep.numeric:
            x = F.coalesce(F.col(c).cast("double"), F.lit(float(prep.medians.get(c, 0.0))))
            if c in prep.scaler:
                mean, std = prep.scaler[c]
                x = (x - F.lit(float(mean or 0.0))) / F.lit(float(std) if std else 1.0)
            out.append(x.alias(c))
        elif c in prep.categorical:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit(prep.modes.get(c, "Unknown"))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# Parameters of each kind and their defaults.  ``minSplit``, the fewest rows a
# node needs to be cut, is met through Spark's fewest rows of a child: a cut of
# m rows leaves a child of at most m / 2.
DEFAULTS: dict[str, dict] = {
    "lr": {"maxIter": 1000, "regParam": 0.0, "elasticNetParam": 0.0, "C": None, "penalty": "l2", "tol": 1e-6},
    "rf": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 1, "minSplit": 2, "bootstrap": True, "seed": K.SPLIT_SEED},
    "gbt": {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 1, "minSplit": 2,
            "seed": K.SPLIT_SEED},
}


def classifier(kind: str, label: str = "label", weight: str | None = None, n_rows: int | None = None,
               whole_cuts: bool = False, **params):
    """ML1-ML3 with the reference's settings as defaults; unknown parameters
    are refused.  ``C`` needs ``n_rows``, the rows fitted on, and so does
    ``whole_cuts`` of a tree: Spark ML looks for cuts in a sample of
    max(10,000, maxBins^2) rows, so as many bins as the root of the rows leave
    none out (its product holds 31 bits: beyond 2.1 billion rows it takes a
    sample of so many).  A column has a bin for each of its values at most."""
    if kind not in DEFAULTS:
        raise ValueError(kind)
    unknown = set(params) - set(DEFAULTS[kind])
    if unknown:
        raise ValueError(f"{kind} has no parameter {sorted(unknown)}")
    p = DEFAULTS[kind] | params
    common = dict(featuresCol="features", labelCol=label)
    if kind == "lr":
        reg, net = p["regParam"], p["elasticNetParam"]
        if p["C"] is not None:
            if n_rows is None:
                raise ValueError("C needs the number of rows")
            reg, net = lr_reg_param(p["C"], n_rows), {"l1": 1.0, "l2": 0.0}[p["penalty"]]
        model = LogisticRegression(maxIter=p["maxIter"], regParam=reg, elasticNetParam=net, tol=p["tol"],
                                   standardization=False, **common)
    else:
        trees = dict(maxDepth=p["maxDepth"], minInstancesPerNode=least_leaf(p), seed=p["seed"], **common)
        if whole_cuts:
            trees["maxBins"] = min(max(CUTS, math.isqrt(n_rows) + 1), math.isqrt(2 ** 31 - 1))
        model = RandomForestClassifier(numTrees=p["numTrees"], bootstrap=p["bootstrap"], **trees) if kind == "rf" else \
            GBTClassifier(maxIter=p["maxIter"], stepSize=p["stepSize"], subsamplingRate=p["subsamplingRate"], **trees)
    return model.setWeightCol(weight) if weight else model


def least_leaf(p: dict) -> int:
    """Fewest rows of a leaf that meet both of a tree's bounds."""
    return max(p["minInstancesPerNode"], 1 if p["minSplit"] <= 3 else p["minSplit"] // 2)


def lr_reg_param(C: float, n_rows: int) -> float:
    """ML1: Spark's ``regParam`` for an L2 penalty that weighs like
    scikit-learn's inverse strength ``C`` on ``n_rows`` training rows
    (Spark averages the loss and weights the penalty; the other weighs the
    summed loss by C): regParam = 1 / (C · n)."""
    return 1.0 / (C * n_rows)


def choose(table: DataFrame, prefer: str | None = None) -> str:
    """ML6: of the rows (split, f1) in their order, the name with the best F1.
    Ties keep the earlier one, unless ``prefer`` ties for best (the
    fixed-schema trainer lets the random forest win ties)."""
    best_name, best_f1 = None, None
    for r in table.select("split", "f1").collect():     # one row per candidate
        if best_f1 is None or r["f1"] > best_f1 or (r["split"] == prefer and r["f1"] == best_f1):
            best_name, best_f1 = r["split"], r["f1"]
    return best_name


def compare_scores(df: DataFrame, scores: Sequence[str], label: str, threshold: float) -> DataFrame:
    """(split, tn, fp, fn, tp, ..., f1) of each score column of ``df`` at a
    fixed threshold, in the order given, from one aggregate."""
    cells = []
    for i, c in enumerate(scores):
        got, real = F.col(c) >= threshold, F.col(label) == 1
        cells += [F.count_if(~real & ~got).alias(f"tn{i}"), F.count_if(~real & got).alias(f"fp{i}"),
                  F.count_if(real & ~got).alias(f"fn{i}"), F.count_if(real & got).alias(f"tp{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("split"), *[F.col(f"{k}{i}").alias(k) for k in ("tn", "fp", "fn", "tp")])
                     for i, c in enumerate(scores)])
    return EV.metrics_from_confusion(df.agg(*cells).select(F.explode(rows).alias("r")).select("r.*"), ("split",))


def select_model(candidates: list[tuple[str, "FittedModel"]], df: DataFrame, label: str,
                 prefer: str | None = None) -> tuple[str, "FittedModel", DataFrame]:
    """ML6: the candidate with the best F1 on ``df`` at its own threshold.
    Returns (name, model, per-candidate metrics)."""
    table = None
    for name, m in candidates:
        report = evaluate_model(m, df, label, name)
        table = report if table is None else table.unionByName(report)
    table = materialize(table.coalesce(1))      # one row per candidate, in order
    best = choose(table, prefer)
    return best, dict(candidates)[best], table


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], clf, cuts: dict[str, list[float]] | None = None) -> Pipeline:
    """TR12 + TR13: one-hot categorical branch + numeric branch → vector.  Numeric
    columns become the number of their bin between ``cuts``, where given."""
    stages = one_hot_stages(categorical) if categorical else []
    slots = list(numeric)
    if cuts:
        slots = [f"{c}__bin" for c in numeric]
        stages.append(Bucketizer(inputCols=list(numeric), outputCols=slots, handleInvalid="keep",
                                 splitsArray=[[-math.inf, *cuts[c], math.inf] for c in numeric]))
    stages.append(VectorAssembler(inputCols=slots + [f"{c}__ohe" for c in categorical], outputCol="features",
                                  handleInvalid="keep"))
    stages.append(clf)
    return Pipeline(stages=stages)


def cut_values(df: DataFrame, numeric: Sequence[str], most: int = CUTS) -> dict[str, list[float]]:
    """Where a tree may cut each of ``numeric`` (DOUBLE), ascending: below any but
    the least value of a column of at most ``most``, else at ``most`` - 1 quantiles,
    and above a value that is two of them.  All rows count: values are told apart,
    and quantiles found, by sketches that merge."""
    if not numeric:
        return {}
    x = {c: F.when(F.abs(F.col(c)) < math.inf, F.col(c) + F.lit(0.0)) for c in numeric}     # finite
    counts, _ = sketched_counts(df, x)
    few = {c: counts[c] is not None and counts[c] <= most for c in numeric}
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    seen = df.agg(*[(F.collect_set(x[c]) if few[c] else F.percentile_approx(x[c], shares, SKETCH)).alias(f"v{i}")
                    for i, c in enumerate(numeric)]).first()
    cuts = {}
    for i, c in enumerate(numeric):
        v = sorted(seen[f"v{i}"] or [0.0])
        heavy = [math.nextafter(a, math.inf) for a, b in zip(v, v[1:]) if a == b]
        cuts[c] = (v[1:] or v) if few[c] else sorted({*v, *heavy})
    return cuts


def one_hot_stages(categorical: Sequence[str]) -> list:
    """TR12: indexer and encoder of the categorical columns."""
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    return [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True)]


def probability_column(scored: DataFrame, name: str = "p") -> DataFrame:
    """SC13: the positive-class probability as a DOUBLE column."""
    return scored.withColumn(name, vector_to_array(F.col("probability")).getItem(1))


@dataclass
class FittedModel:
    prep: Prep
    pipeline: PipelineModel
    kind: str
    threshold: float | None
    label: str

    def prepared(self, df: DataFrame) -> DataFrame:
        """Adds the filled and scaled columns that the pipeline reads."""
        feats = self.prep.numeric + self.prep.categorical
        return apply_prep(df.select("*", *[F.col(c).alias(f"m__{c}") for c in feats]), _rename(self.prep, "m__"))

    def features(self, df: DataFrame) -> DataFrame:
        """Adds the vector ``features`` that the model reads."""
        return PipelineModel(self.pipeline.stages[:-1]).transform(self.prepared(df))

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Score every row; the input columns are kept, ``name`` is added."""
        out = probability_column(self.pipeline.transform(self.prepared(df)), name)
        return out.select(*[F.col(c) for c in df.columns], name)


def _rename(prep: Prep, prefix: str) -> Prep:
    return Prep([prefix + c for c in prep.numeric], [prefix + c for c in prep.categorical],
                {prefix + k: v for k, v in prep.medians.items()},
                {prefix + k: v for k, v in prep.modes.items()},
                {prefix + k: v for k, v in prep.scaler.items()})


def bounded(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows to fit on, those with the smallest
    key hashes (a documented bound: trees cost many passes), stored once."""
    return materialize(df.orderBy(SP.key_hash(keys), *[qcol(k) for k in keys],
                                  *[qcol(c) for c in df.columns if c not in keys])
                       .limit(max_rows))


def check_categories(df: DataFrame, categorical: Sequence[str], limit: int = MAX_CATEGORIES) -> None:
    """Refuse a column whose values would not fit the driver and the vector."""
    if not categorical:
        return
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), qcol(c).cast("string").alias("v")) for c in categorical]))
    for r in df.select(cells.alias("x")).select("x.*").distinct().groupBy("c").count().where(F.col("count") > limit).collect():     # one row a column
        raise ValueError(f"{r['c']} has more than {limit} categories")


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
        kind: str = "rf", weight: str | None = None, threshold: str | float | None = 0.5,
        tune_on: DataFrame | None = None, balanced: bool = False, prep: Prep | None = None,
        whole_cuts: bool = False, **params) -> FittedModel:
    """Fit preparation (unless ``prep``, fitted on the same rows, is given) and
    pipeline on ``df``.  ``balanced`` weighs classes
    equally (AG14).  ``threshold='youden'`` tunes the cut (AG12) on ``tune_on``,
    a validation table.  With ``whole_cuts`` all rows tell where trees may cut
    (``cut_values``), not Spark ML's sample of 10,000."""
    if threshold == "youden" and tune_on is None:
        raise ValueError("a threshold is tuned on rows the model is not fitted on: give tune_on")
    if prep is None:
        check_categories(df, categorical)
        prep = fit_prep(df, numeric, categorical)
    feats = list(numeric) + list(categorical)
    if balanced:
        df, weight = SP.with_class_weight(df, label, "__weight"), "__weight"
    renamed = df.select(*[F.col(c).alias(f"m__{c}") for c in feats], F.col(label).cast("double").alias("label"),
                        *([F.col(weight).alias("weight")] if weight else []))
    model_prep = _rename(prep, "m__")
    whole_cuts = whole_cuts and kind != "lr"
    n_rows = df.count() if whole_cuts or params.get("C") is not None else None
    rows = apply_prep(renamed, model_prep)
    if kind == "lr" and not numeric:
        # the same loss over each combination of categories once, with its rows' weight
        rows, weight = rows.groupBy(*model_prep.categorical, "label").agg(
            F.sum(F.col("weight") if weight else F.lit(1.0)).alias("weight")), "weight"
    pipe = feature_pipeline(model_prep.numeric, model_prep.categorical,
                            classifier(kind, "label", "weight" if weight else None, n_rows, whole_cuts, **params),
                            cut_values(rows, model_prep.numeric) if whole_cuts else None)
    fitted = pipe.fit(rows)
    model = FittedModel(prep, fitted, kind, None, label)
    model.threshold = EV.best_threshold(model.score(tune_on), "p", label) if threshold == "youden" else threshold
    return model


def evaluate_model(model: FittedModel, df: DataFrame, label: str, name: str = "test", spread: bool = False) -> DataFrame:
    """ML7: metrics of a fitted model on a table at its threshold:
    (split, tn, fp, fn, tp, accuracy, precision, recall, f1, auc, threshold), with
    ``spread`` the probabilities' distribution (AG7) too."""
    scored = model.score(df)
    thr = model.threshold
    pred = (F.col("p") >= F.lit(thr)).cast("int") if thr is not None else F.lit(0)
    # stored: rows are scored once for the area, the metrics and what a caller adds
    s = materialize(scored.select(F.col(label).cast("int").alias("actual"), pred.alias("Prediction"), "p"))
    auc = EV.roc_auc(s, "p", "actual").collect()[0]["auc"]  # one number
    report = EV.classification_metrics(s, "actual", "Prediction").select(
        F.lit(name).alias("split"), "*", F.lit(auc).cast("double").alias("auc"),
        F.lit(thr).cast("double").alias("threshold"))
    return report.join(EV.probability_distribution(s, "p")) if spread else report    # one row each


def feature_importance(model: FittedModel, k: int = 10) -> DataFrame:
    """AG22: importance per input feature (one-hot slots summed back to
    their column), highest first, top ``k``.  Tree models only."""
    spark = SparkSession.getActiveSession()
    last = model.pipeline.stages[-1]
    if not hasattr(last, "featureImportances"):
        raise ValueError("feature importances need a tree model")
    imp = last.featureImportances.toArray().tolist()
    names = _slot_names(model)
    per: dict[str, float] = {}
    for n, v in zip(names, imp):
        per[n] = per.get(n, 0.0) + float(v)
    rows = sorted(per.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    return spark.createDataFrame([(n, round(v, 6)) for n, v in rows], "feature string, importance double")


def _slot_names(model: FittedModel) -> list[str]:
    """Feature name of every vector slot (one-hot slots map to their column)."""
    names = list(model.prep.numeric)
    stages = model.pipeline.stages
    indexer = next((s for s in stages if hasattr(s, "labelsArray")), None)
    if indexer is not None:
        for c, labels in zip(model.prep.categorical, indexer.labelsArray):
            names += [c] * len(labels)  # keep-bucket slot is dropped by dropLast
    return names


def candidates(grid: dict[str, list] | None) -> list[dict]:
    """All parameter combinations of a grid, in the order of its lists."""
    grid = grid or {}
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def cross_validate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
                   kind: str = "rf", grid: dict | None = None, fold_col: str = "fold",
                   metric: str = "f1", parallelism: int = 4, balanced: bool = False, **params) -> DataFrame:
    """ML4 / ML5: k-fold cross-validation over a parameter grid, folds from
    ``fold_col`` (SO4).  Preparation, class weights and model are fitted on the
    other folds only.  (params, fold, score) per candidate and fold; fits run
    side by side, ``parallelism`` at a time."""
    spark = df.sparkSession
    df = materialize(df)
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())      # k values
    check_categories(df, categorical)
    preps = {f: fit_prep(df.where(F.col(fold_col) != f), numeric, categorical) for f in folds}
    tasks = [(c, f) for c in candidates(grid) for f in folds]

    def run(task):
        choice, fold = task
        model = fit(df.where(F.col(fold_col) != fold), numeric, categorical, label, kind, balanced=balanced, prep=preps[fold],
                    **params, **choice)
        score = evaluate_model(model, df.where(F.col(fold_col) == fold), label).collect()[0][metric]
        return json.dumps(choice, sort_keys=True), int(fold), float(score)

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, tasks))
    return spark.createDataFrame(rows, "params string, fold int, score double")


def grid_search(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
                grids: dict[str, dict] | None = None, fold_col: str = "fold", **more) -> DataFrame:
    """ML4 over several kinds of model: (kind, params, mean, std, rank) by mean
    F1; ties keep the earlier candidate.  Defaults to all 42 candidates."""
    grids = GRIDS if grids is None else grids
    parts, order = [], {}
    for kind, grid in grids.items():
        for c in candidates(grid):
            order[kind, json.dumps(c, sort_keys=True)] = len(order)
        parts.append(cross_validate(df, numeric, categorical, label, kind, grid, fold_col, balanced=kind in BALANCED, **more)
                     .withColumn("kind", F.lit(kind)))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    table = scores.groupBy("kind", "params").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).collect()
    ranked = sorted(table, key=lambda r: (-r["mean"], order[r["kind"], r["params"]]))
    return df.sparkSession.createDataFrame(
        [(r["kind"], r["params"], r["mean"], r["std"], i + 1) for i, r in enumerate(ranked)],
        "kind string, params string, mean double, std double, rank int")


def train_test_report(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, keys: Sequence[str],
                      kind: str, folds: int = 5, **params) -> tuple[FittedModel, DataFrame]:
    """ML7: a model fitted on the train part of ``df`` (column ``part``) and its
    report: for each part the metrics, the probabilities' distribution, and for
    the train part the mean and spread of cross-validated accuracy."""
    train, test = df.where(F.col("part") == "train"), df.where(F.col("part") == "test")
    model = fit(train, numeric, categorical, label, kind, balanced=kind in BALANCED, **params)
    cv = cross_validate(SP.assign_folds(train, keys, folds), numeric, categorical, label, kind, metric="accuracy",
                        balanced=kind in BALANCED, **params).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()[0]
    parts = []
    for name, rows in (("train", train), ("test", test)):
        parts.append(evaluate_model(model, rows, label, name, spread=True).select(
            F.lit(kind).alias("kind"), "*", F.lit(cv["m"] if name == "train" else None).cast("double").alias("cv_accuracy"),
            F.lit(2 * cv["s"] if name == "train" else None).cast("double").alias("cv_spread")))
    return model, parts[0].unionByName(parts[1])


def fit_one_hot(df: DataFrame, categorical: Sequence[str]) -> tuple[Prep, PipelineModel]:
    """TR12: filling, indexer and encoder fitted on all rows of ``df``."""
    check_categories(df, categorical)
    prep = fit_prep(df, [], categorical)
    filled = apply_prep(df.select(*[F.col(c).alias(f"m__{c}") for c in categorical]), _rename(prep, "m__"))
    return prep, Pipeline(stages=one_hot_stages([f"m__{c}" for c in categorical])).fit(filled)


def one_hot_sums(prep: Prep, encoder: PipelineModel, df: DataFrame) -> DataFrame:
    """TR12 / TR13: (column, value, n) - rows of ``df`` in each one-hot slot of
    a fitted encoder, and under NULL those without a slot (unknown values)."""
    coded = encoder.transform(apply_prep(df.select(*[F.col(c).alias(f"m__{c}") for c in prep.categorical]), _rename(prep, "m__")))
    labels = encoder.stages[0].labelsArray
    items = []
    for c, values in zip(prep.categorical, labels):
        slots = vector_to_array(F.col(f"m__{c}__ohe"))
        at = F.array_position(slots, 1.0)       # 0 where all slots are zero
        items.append(F.struct(F.lit(c).alias("column"), F.get(F.lit(list(values)), (at - 1).cast("int")).alias("value")))
    return (coded.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# IO3 / IO4 persistence
# ---------------------------------------------------------------------------


def save(model: FittedModel, path: str) -> None:
    """IO3: pipeline directory + a one-row JSON metadata table beside it."""
    spark = SparkSession.getActiveSession()
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    meta = {"kind": model.kind, "threshold": model.threshold, "label": model.label,
            "prep": model.prep.to_json()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/metadata")


def load(path: str) -> FittedModel:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/metadata").collect()[0]["meta"])
    return FittedModel(Prep.from_json(meta["prep"]), PipelineModel.load(f"{path}/pipeline"),
                       meta["kind"], meta["threshold"], meta["label"])


def model_info(path: str) -> DataFrame:
    """IO4: type, threshold and feature counts as one row."""
    spark = SparkSession.getActiveSession()
    m = load(path)
    return spark.createDataFrame(
        [(m.kind, m.threshold, len(m.prep.numeric), len(m.prep.categorical), m.label)],
        "model_type string, threshold double, numeric_features int, categorical_features int, target string")
