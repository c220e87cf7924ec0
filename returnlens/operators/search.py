"""Model search without a pass for each fit (ML1, ML4, ML5, SO4, TR5-TR9).

* **Fold statistics by subtraction.** One table counts the rows of each (column,
  value) by fold.  What a fold trains on is the total less the fold, so medians,
  modes, means and deviations of all folds come from this table, not the data.
* **Many regressions in one scan.** All candidates and folds of a logistic
  regression keep their coefficients on the driver; a step is one pass that adds up
  every fit's loss, gradient and curvature (Newton's method; a penalty on absolute
  values is met by coordinate descent on the same quadratic).  What it reads is stored
  in blocks of rows, as numbers.  Fits that have converged leave the later passes.  A
  step moves fits x D x D numbers a task, D the length of the feature vector, which
  ``max_width`` bounds.
* **Prefixes of ensembles.** A boosted fit of 200 rounds holds the one of 100, a
  forest of 200 trees one of 100, and a tree grown to depth 30 those cut at 10 and
  15.  Only the largest of a family is fitted (Spark ML); one pass over the rows
  that the fold leaves out scores all its members.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import column_to_double, qcol
from ..session import materialize, scratch_path
from . import evaluate as EV
from . import models as ML
from .prefix import running_sums

# ---------------------------------------------------------------------------
# Fold statistics
# ---------------------------------------------------------------------------


def fold_counts(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: Sequence[int], fold_col: str) -> DataFrame:
    """(column, number, text, n, t0, t1, ...), stored: rows of each value (NULL
    too), and of these the rows that each fold trains on, all but its own."""
    items = [F.struct(F.lit(c).alias("column"), column_to_double(df, c).alias("number"), F.lit(None).cast("string").alias("text")) for c in numeric]
    items += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("number"), qcol(c).cast("string").alias("text")) for c in categorical]
    long = df.select(qcol(fold_col).alias("fold"), F.explode(F.array(*items)).alias("kv")).select("fold", "kv.*")
    counts = long.groupBy("column", "number", "text").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("fold") == f).alias(f"own{i}") for i, f in enumerate(folds)])
    return materialize(counts.select("column", "number", "text", "n", *[(F.col("n") - F.col(f"own{i}")).alias(f"t{i}") for i in range(len(folds))]))


def fit_fold_preps(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold_col: str = "fold") -> tuple[dict[int, ML.Prep], dict[str, list[str]]]:
    """Preparation of each fold as ``models.fit_prep`` fits it on all other folds,
    and the values of each categorical column, from one scan of ``df``."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())      # k values
    counts, t = fold_counts(df, numeric, categorical, folds, fold_col), [f"t{i}" for i in range(len(folds))]
    known = counts.where("number IS NOT NULL")
    rows = {r["column"]: r for r in counts.groupBy("column").agg(
        F.count_distinct("text").alias("texts"), *[F.sum(c).alias(c) for c in t],
        *[F.sum(F.when(F.col("number").isNotNull(), F.col(c))).alias(f"has_{c}") for c in t],
        *[F.sum(F.col("number") * F.col(c)).alias(f"sum_{c}") for c in t]).collect()}
    for c in categorical:
        if c in rows and rows[c]["texts"] > ML.MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {ML.MAX_CATEGORIES} categories")
    modes = _modes(counts, t)
    medians = _medians(known, {(c, i): rows[c][f"has_t{i}"] for c in numeric if c in rows for i in range(len(t)) if rows[c][f"has_t{i}"]})
    preps = {f: ML.Prep(list(numeric), list(categorical), {c: medians.get((c, i), 0.0) for c in numeric},
                        {c: modes.get((c, i), "Unknown") for c in categorical}) for i, f in enumerate(folds)}
    means = {}
    for c, (i, f) in itertools.product(numeric, enumerate(folds)):
        n, has = (rows[c][f"t{i}"], rows[c][f"has_t{i}"] or 0) if c in rows else (0, 0)
        means[c, i] = ((rows[c][f"sum_t{i}"] or 0.0) + (n - has) * preps[f].medians[c]) / n if n else None
    spread = _spreads(known, numeric, means, t)
    for c, (i, f) in itertools.product(numeric, enumerate(folds)):
        if means[c, i] is None:
            preps[f].scaler[c] = (None, None)
            continue
        n, has = rows[c][f"t{i}"], rows[c][f"has_t{i}"] or 0
        square = spread.get((c, i), 0.0) + (n - has) * (preps[f].medians[c] - means[c, i]) ** 2
        preps[f].scaler[c] = (means[c, i], (square / n) ** 0.5)
    values = {c: [] for c in categorical}
    for r in counts.where("text IS NOT NULL").select("column", "text").orderBy("column", "text").collect():    # bounded by MAX_CATEGORIES
        values[r["column"]].append(r["text"])
    return preps, values


def _modes(counts: DataFrame, t: list[str]) -> dict[tuple[str, int], str]:
    best = [F.min_by("text", F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("less"), "text"))).alias(c) for c in t]
    got = counts.where("text IS NOT NULL").groupBy("column").agg(*best).collect()
    return {(r["column"], i): r[c] for r in got for i, c in enumerate(t) if r[c] is not None}


def _medians(known: DataFrame, totals: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """Median of each (column, fold) with ``totals`` values, by running sums of
    all folds' counts at once."""
    if not totals:
        return {}
    hit = F.lit(False)
    wanted = {}
    for (c, i), n in totals.items():
        for k in sorted({(n - 1) // 2, n // 2}):
            wanted[c, i, k] = None
            hit = hit | ((F.col("column") == c) & (F.col(f"cum_t{i}") - F.col(f"t{i}") <= k) & (F.col(f"cum_t{i}") > k))
    sums = sorted({f"t{i}" for _, i in totals})
    found = running_sums(known.select("column", "number", *sums), ["column"], "number", sums).where(hit).collect()     # two rows each at most
    for (c, i, k) in wanted:
        wanted[c, i, k] = next(r["number"] for r in found if r["column"] == c and r[f"cum_t{i}"] - r[f"t{i}"] <= k < r[f"cum_t{i}"])
    return {(c, i): (wanted[c, i, (n - 1) // 2] + wanted[c, i, n // 2]) / 2.0 for (c, i), n in totals.items()}


def _spreads(known: DataFrame, numeric: Sequence[str], means: dict, t: list[str]) -> dict[tuple[str, int], float]:
    """Sum of squares about each (column, fold)'s mean."""
    def about(i: int) -> Column:
        at = F.lit(0.0)
        for c in numeric:
            if means[c, i] is not None:
                at = F.when(F.col("column") == c, F.lit(float(means[c, i]))).otherwise(at)
        return F.col("number") - at

    got = known.groupBy("column").agg(*[F.sum(F.col(c) * about(i) * about(i)).alias(c) for i, c in enumerate(t)]).collect()
    return {(r["column"], i): r[c] for r in got for i, c in enumerate(t) if r[c] is not None}


def fold_statistics(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """(fold, column, median, mean, std, mode): what each fold's preparation is
    made of; means and deviations are those of the filled column."""
    preps, _ = fit_fold_preps(df, numeric, categorical, fold_col)
    rows = [(f, c, float(p.medians[c]), *(None if x is None else float(x) for x in p.scaler[c]), None) for f, p in preps.items() for c in numeric]
    rows += [(f, c, None, None, None, p.modes[c]) for f, p in preps.items() for c in categorical]
    return df.sparkSession.createDataFrame(rows, "fold int, column string, median double, mean double, std double, mode string")


# ---------------------------------------------------------------------------
# Many regressions in one scan
# ---------------------------------------------------------------------------


@dataclass
class Design:
    """The features of one preparation, as ``models.fit`` makes them: numeric
    columns filled and scaled, a slot for each value of a categorical one."""
    prep: ML.Prep
    values: dict[str, list[str]]

    def names(self) -> list[str]:
        return [*self.prep.numeric, *(f"{c}={v}" for c in self.prep.categorical for v in self.values[c]), "(intercept)"]

    def slots(self) -> Iterator[tuple[int, int]]:
        """(first feature, number of values) of each categorical column."""
        at = len(self.prep.numeric)
        for c in self.prep.categorical:
            yield at, len(self.values[c])
            at += len(self.values[c])

    def parts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """The features of a batch of ``_rows_for``: a row for each number and one of
        ones; for each categorical column the rows' slots, from 1 (0: none)."""
        numbers = np.ones((len(self.prep.numeric) + 1, batch.num_rows))
        for i, c in enumerate(self.prep.numeric):
            x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
            mean, std = self.prep.scaler.get(c, (0.0, 1.0))
            numbers[i] = (np.where(np.isnan(x), self.prep.medians[c], x) - (mean or 0.0)) / (std or 1.0)
        slots = []
        for i, c in enumerate(self.prep.categorical, len(self.prep.numeric)):
            code, mode = batch.column(i).to_numpy().astype(np.intp), self.prep.modes[c]
            missing = self.values[c].index(mode) if mode in self.values[c] else UNKNOWN
            slots.append(np.where(code == MISSING, missing, code) + 1)
        return numbers, slots

    def margin(self, w: np.ndarray, numbers: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """x w of each row."""
        out = np.append(w[:len(numbers) - 1], w[-1]) @ numbers
        for own, (at, size) in zip(slots, self.slots()):
            out += np.append(0.0, w[at:at + size])[own]
        return out

    def total(self, v: np.ndarray | None, numbers: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Sum of v x over the rows; without ``v`` the rows whose x is not zero."""
        first = np.count_nonzero(numbers, axis=1) if v is None else numbers @ v
        return np.concatenate([first[:-1], *(np.bincount(own, v, size + 1)[1:] for own, (_, size) in zip(slots, self.slots())), first[-1:]])

    def curvature(self, v: np.ndarray, numbers: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Sum of v x x' over the rows.  A row has one slot of a categorical column:
        sums by slot, and by pairs of slots, stand for products with its zeros."""
        at = [*range(len(numbers) - 1), -1]
        n = len(numbers) - 1 + sum(size for _, size in self.slots()) + 1
        out, weighted = np.zeros((n, n)), numbers * v
        out[np.ix_(at, at)] = weighted @ numbers.T
        before: list[tuple[int, int, np.ndarray]] = []
        for own, (a, size) in zip(slots, self.slots()):
            for i, x in zip(at, weighted):
                out[i, a:a + size] = out[a:a + size, i] = np.bincount(own, x, size + 1)[1:]
            np.fill_diagonal(out[a:a + size, a:a + size], out[-1, a:a + size])
            for b, width, other in before:
                pairs = np.bincount(own * (width + 1) + other, v, (size + 1) * (width + 1)).reshape(size + 1, width + 1)[1:, 1:]
                out[a:a + size, b:b + width], out[b:b + width, a:a + size] = pairs, pairs.T
            before.append((a, size, own))
        return out


@dataclass
class Regression:
    """One fit: on the rows outside ``fold`` (None: all), with ``l1`` and ``l2``
    penalties on the mean loss and weights of the classes 0 and 1."""
    fold: int | None
    l1: float = 0.0
    l2: float = 0.0
    weights: tuple[float, float] = (1.0, 1.0)
    params: str = "{}"
    w: np.ndarray | None = None
    loss: float = field(default=np.inf)
    steps: int = 0
    done: bool = False

    def penalty(self, w: np.ndarray) -> float:
        return self.l1 * float(np.abs(w[:-1]).sum()) + self.l2 / 2 * float((w[:-1] ** 2).sum())


#: Codes of a cell without a value, and of one whose value has no slot.
MISSING, UNKNOWN = -2, -1
#: Rows of a block, and blocks that a step takes at once.  A step's batches hold some
#: thousands of blocks: longer ones would make them too large for a task.
BLOCK, TAKEN = 100, 100


def _rows_for(df: DataFrame, design: Design, label: str, fold_col: str | None, packed: bool = False) -> DataFrame:
    """(x0, ..., c0, ..., fold, y): numbers, the place of each category among its
    column's values, fold and label.  ``packed`` makes a row of each block of rows, its
    columns the cells of one column side by side: steps read a stored one of these
    (``_unpacked``), so texts are looked up once and cells are not moved one by one."""
    numeric, categorical = design.prep.numeric, design.prep.categorical
    fold = qcol(fold_col).cast("int") if fold_col else F.lit(0)
    rows = df.select(*[column_to_double(df, c).alias(f"x{i}") for i, c in enumerate(numeric)], *[qcol(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)],
                     fold.alias("fold"), qcol(label).cast("double").alias("y"))
    places = [{v: k for k, v in enumerate(design.values[c])} for c in categorical]
    if not places and not packed:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            for i, at in enumerate(places, len(numeric)):
                cells = columns[i].dictionary_encode()
                code = np.array([at.get(v, UNKNOWN) for v in cells.dictionary.to_pylist()] + [MISSING], np.int32)
                columns[i] = pa.array(code[cells.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([_packed(c, kind) for c, kind in zip(columns, _kinds(batch))] if packed else columns, names=batch.schema.names)

    kinds = [f"x{i} double" for i in range(len(numeric))] + [f"c{i} int" for i in range(len(categorical))] + ["fold int", "y double"]
    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in rows.columns) if packed else ", ".join(kinds))


def _kinds(batch: pa.RecordBatch) -> list[type]:
    """Types of a block's cells; places are below ``models.MAX_CATEGORIES``."""
    return [np.int16 if name.startswith("c") else np.float64 for name in batch.schema.names]


def _packed(cells: pa.Array, kind: type) -> pa.Array:
    """The cells of one column by blocks; without a value: NaN."""
    x = cells.to_numpy(zero_copy_only=False).astype(kind)
    return pa.array([x[k:k + BLOCK].tobytes() for k in range(0, len(x), BLOCK)], pa.binary())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks, some thousands at once."""
    for whole in batches:
        for k in range(0, whole.num_rows, TAKEN):
            blocks = whole.slice(k, TAKEN)
            yield pa.RecordBatch.from_arrays([pa.array(_joined(c, kind)) for c, kind in zip(blocks.columns, _kinds(blocks))], names=blocks.schema.names)


def _joined(blocks: pa.Array, kind: type) -> np.ndarray:
    """The cells of a column's blocks, which lie side by side already."""
    blocks = blocks.cast(pa.binary())
    _, offsets, cells = blocks.buffers()
    ends = np.frombuffer(offsets, np.int32)[blocks.offset:blocks.offset + len(blocks) + 1]
    return np.frombuffer(cells, np.uint8)[ends[0]:ends[-1]].view(kind)


def _per_design(batch: pa.RecordBatch, designs: dict[int | None, Design], fits: list[Regression]):
    """(fit's number, fit, its rows' mask, its design and the batch's parts, y) for each fit."""
    folds, y = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
    made: dict[int | None, tuple] = {}
    for i, fit in enumerate(fits):
        if fit.fold not in made:
            made = {fit.fold: designs[fit.fold].parts(batch)}      # fits come by fold: one design at a time
        yield i, fit, folds == fit.fold, designs[fit.fold], made[fit.fold], y


def _added(parts: DataFrame, schema: str) -> list:
    """Sums of the arrays (packed doubles) of each fit: a row for each fit."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(packed)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["fit", "sums"])

    return parts.repartition("fit").mapInArrow(add, schema).collect()


def fit_regressions(df: DataFrame, designs: dict[int | None, Design], fits: list[Regression], label: str, fold_col: str | None = None,
                    tol: float = 1e-9, max_steps: int = 100, max_width: int = 2_000, blocks: DataFrame | None = None) -> list[Regression]:
    """Fits all of ``fits`` (with ``w`` set on return; by fold), a scan a step of
    ``blocks``, which ``_rows_for`` packs of the rows of ``df``, stored here unless
    they are given.  A fit that has not converged after ``max_steps`` is an error."""
    width = max(len(d.names()) for d in designs.values())
    if width > max_width:
        raise ValueError(f"{width} features; curvature is kept for {max_width} at most")
    blocks = materialize(_rows_for(df, next(iter(designs.values())), label, fold_col, packed=True)) if blocks is None else blocks
    fits = sorted(fits, key=lambda f: (f.fold is None, f.fold or 0))
    tried = {}
    for i, f in enumerate(fits):
        f.w, tried[i] = np.zeros(len(designs[f.fold].names())), np.zeros(len(designs[f.fold].names()))
    schema = "fit int, sums binary"
    for _ in range(max_steps):
        live = [i for i, f in enumerate(fits) if not f.done]
        if not live:
            return fits
        asked = [(i, Regression(fits[i].fold, weights=fits[i].weights, w=tried[i])) for i in live]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in _unpacked(batches):
                for k, fit, own, design, x, y in _per_design(batch, designs, [f for _, f in asked]):
                    weight = np.where(y == 1.0, fit.weights[1], fit.weights[0])
                    if fit.fold is not None:
                        weight[own] = 0.0
                    margin = design.margin(fit.w, *x)
                    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                    loss = (weight * (np.logaddexp(0.0, margin) - y * margin)).sum()
                    gradient = design.total(weight * (p - y), *x)
                    curve = design.curvature(weight * p * (1 - p), *x)
                    packed = np.concatenate(([weight.sum(), loss], gradient, curve.ravel()))
                    sums[asked[k][0]] = sums[asked[k][0]] + packed if asked[k][0] in sums else packed
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["fit", "sums"])

        for r in _added(blocks.mapInArrow(run, schema), schema):
            f, sums = fits[r["fit"]], np.frombuffer(r["sums"])
            _step(f, r["fit"], tried, sums, tol)
    raise RuntimeError(f"{sum(not f.done for f in fits)} regressions have not converged in {max_steps} steps")


def _step(f: Regression, i: int, tried: dict[int, np.ndarray], sums: np.ndarray, tol: float) -> None:
    """Takes or halves the step that was tried, and chooses the next."""
    n, total = len(f.w), sums[0]
    now = tried[i]
    loss = sums[1] / total + f.penalty(now)
    f.steps += 1
    if loss > f.loss + 1e-13 * abs(f.loss):                 # too far: half of the step
        tried[i] = (f.w + now) / 2
        f.done = float(np.abs(tried[i] - f.w).max()) < tol
        return
    f.w, f.loss = now, loss
    gradient, curve = sums[2:2 + n] / total, sums[2 + n:].reshape(n, n) / total
    ridge = np.full(n, f.l2)
    ridge[-1] = 0.0
    gradient, curve = gradient + ridge * now, curve + np.diag(ridge)
    move = _descent(gradient, curve, now, f.l1) if f.l1 else -np.linalg.lstsq(curve, gradient, rcond=1e-12)[0]
    f.done = float(np.abs(move).max(initial=0.0)) < tol
    tried[i] = now + move
    if f.done:
        f.w = tried[i]                                      # without it the rest of each sum would grow with the rows


def _descent(gradient: np.ndarray, curve: np.ndarray, w: np.ndarray, l1: float) -> np.ndarray:
    """The move that minimises the quadratic with ``l1`` on |w| but the intercept's."""
    move, slope = np.zeros_like(w), gradient.copy()
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(w)):
            if curve[j, j] <= 0.0:
                continue
            to = w[j] + move[j] - slope[j] / curve[j, j]
            if j < len(w) - 1:
                to = np.sign(to) * max(0.0, abs(to) - l1 / curve[j, j])
            step = to - w[j] - move[j]
            if step:
                move[j] += step
                slope += step * curve[:, j]
                largest = max(largest, abs(step))
        if largest < 1e-12:
            break
    return move


def regression_cells(df: DataFrame, designs: dict[int | None, Design], fits: list[Regression], label: str, fold_col: str) -> DataFrame:
    """(params, fold, tn, fp, fn, tp) of each fit on its own fold, at 0.5, in one scan."""
    rows = _rows_for(df, next(iter(designs.values())), label, fold_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, fit, own, design, x, y in _per_design(batch, designs, fits):
                got, real = design.margin(fit.w, *x)[own] >= 0.0, y[own] == 1.0
                out.append((fit.params, fit.fold, *(int((a & b).sum()) for a, b in ((~real, ~got), (~real, got), (real, ~got), (real, got)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CELLS.types)], names=CELLS.names)

    parts = rows.mapInArrow(run, "params string, fold int, tn bigint, fp bigint, fn bigint, tp bigint")
    return parts.groupBy("params", "fold").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


CELLS = pa.schema([("params", pa.string()), ("fold", pa.int32()), *((c, pa.int64()) for c in ("tn", "fp", "fn", "tp"))])


def _class_weights(df: DataFrame, label: str, fold_col: str, balanced: bool) -> dict[int, tuple[int, tuple[float, float]]]:
    """(rows, class weights) that each fold trains on."""
    counts = {(r[0], int(r[1])): r[2] for r in df.groupBy(qcol(fold_col), qcol(label).cast("int")).count().collect()}
    out = {}
    for f in sorted({f for f, _ in counts}):
        n = [sum(v for (g, y), v in counts.items() if g != f and y == k) for k in (0, 1)]
        classes = sum(x > 0 for x in n)
        out[f] = sum(n), tuple(round(sum(n) / (classes * x), 6) if balanced and x else 1.0 for x in n)
    return out


def cross_validate_regressions(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, grid: dict | None = None,
                               fold_col: str = "fold", metric: str = "f1", balanced: bool = False) -> DataFrame:
    """As ``models.cross_validate`` for logistic regression: (params, fold, score),
    all candidates and folds fitted side by side."""
    df = materialize(df)
    preps, values = fit_fold_preps(df, numeric, categorical, fold_col)
    designs = {f: Design(p, values) for f, p in preps.items()}
    fits = []
    for f, (n, weights) in _class_weights(df, label, fold_col, balanced).items():
        for choice in ML.candidates(grid):
            reg = ML.lr_reg_param(choice["C"], n) if "C" in choice else 0.0
            l1 = choice.get("penalty") == "l1"
            fits.append(Regression(f, reg if l1 else 0.0, 0.0 if l1 else reg, weights, json.dumps(choice, sort_keys=True)))
    fits = fit_regressions(df, designs, fits, label, fold_col)
    cells = regression_cells(df, designs, fits, label, fold_col)
    return EV.metrics_from_confusion(cells, ("params", "fold")).select("params", F.col("fold").cast("int").alias("fold"), F.col(metric).alias("score"))


def plain_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Design:
    """Preparation fitted on all rows of ``df`` as ``models.fit_prep`` fits it; limits,
    modes and values of the categories are told from one table of counts."""
    values: dict[str, list[str]] = {c: [] for c in categorical}
    modes = {c: "Unknown" for c in categorical}
    if categorical:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("text")) for c in categorical]))
        counts = materialize(df.select(cells.alias("x")).select("x.*").groupBy("column", "text").agg(F.count("*").alias("n")))
        for r in counts.groupBy("column").count().where(F.col("count") > ML.MAX_CATEGORIES).collect():      # one row a column
            raise ValueError(f"{r['column']} has more than {ML.MAX_CATEGORIES} categories")
        modes |= {c: mode for (c, _), mode in _modes(counts, ["n"]).items()}
        for r in counts.where("text IS NOT NULL").select("column", "text").collect():       # bounded by MAX_CATEGORIES
            values[r["column"]].append(r["text"])
    prep = ML.fit_prep(df, numeric, [])
    prep.categorical, prep.modes = list(categorical), modes
    return Design(prep, {c: sorted(texts) for c, texts in values.items()})


@dataclass
class Prepared:
    """What regressions of one label read: ``blocks`` of ``rows`` (``_rows_for``),
    stored; ``rows`` are worked out when they are read."""
    rows: DataFrame
    blocks: DataFrame
    design: Design
    classes: dict[int, int]


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str) -> Prepared:
    """The features of ``df``, its preparation and rows of each class, for any number of fits."""
    df = materialize(df.select(*[qcol(c) for c in dict.fromkeys([*numeric, *categorical, label])]))
    design = plain_design(df, numeric, categorical)
    blocks = materialize(_rows_for(df, design, label, None, packed=True))
    classes = df.groupBy(qcol(label).cast("double").cast("int").alias("y")).count().collect()
    return Prepared(_rows_for(df, design, label, None), blocks, design, {int(r["y"]): r["count"] for r in classes})


def score_equations(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, balanced: bool | Sequence[bool] = False,
                    prepared: Prepared | None = None) -> DataFrame:
    """(balanced, feature, rows, residual): of an unpenalised regression fitted on
    ``df`` the sum of weight * (y - p) * x over each feature's rows with x other than
    zero, and their number.  The fit is right where all sums are zero.  The fits of
    several ``balanced`` go side by side: a scan serves them all.
    ``prepared`` is what ``prepare`` has made of the same rows and columns."""
    ready = prepare(df, numeric, categorical, label) if prepared is None else prepared
    design, n = ready.design, ready.classes
    ways = [balanced] if isinstance(balanced, bool) else list(balanced)
    weights = [tuple(sum(n.values()) / (len(n) * n[k]) if way and n.get(k) else 1.0 for k in (0, 1)) for way in ways]
    fits = fit_regressions(df, {None: design}, [Regression(None, weights=w) for w in weights], label, blocks=ready.blocks)
    names = design.names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _unpacked(batches):
            for i, fit, _, _, x, y in _per_design(batch, {None: design}, fits):
                left = np.where(y == 1.0, *fit.weights[::-1]) * (y - 1.0 / (1.0 + np.exp(-design.margin(fit.w, *x))))
                own = design.total(None, *x), design.total(left, *x)
                sums[i] = tuple(a + b for a, b in zip(sums[i], own)) if i in sums else own
        for i, (rows, residual) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([ways[i]] * len(names)), pa.array(names), pa.array(rows, pa.int64()), pa.array(residual)],
                                             names=["balanced", "feature", "rows", "residual"])

    return ready.blocks.mapInArrow(run, "balanced boolean, feature string, rows bigint, residual double").groupBy("balanced", "feature").agg(
        F.sum("rows").alias("rows"), F.sum("residual").alias("residual"))


# ---------------------------------------------------------------------------
# Prefixes of ensembles
# ---------------------------------------------------------------------------


def families(kind: str, grid: dict) -> list[tuple[dict, list[dict]]]:
    """(parameters of the one fit, members): the candidates of ``grid`` that are
    prefixes of one ensemble."""
    found: dict[tuple, list[dict]] = {}
    for choice in ML.candidates(grid):
        p = ML.DEFAULTS[kind] | choice
        own = (p["bootstrap"],) if kind == "rf" else (p["stepSize"], p["maxDepth"], p["subsamplingRate"])
        found.setdefault((ML.least_leaf(p), p["seed"], *own), []).append(choice)
    out = []
    for members in found.values():
        largest = members[0] | {"minSplit": 2, "minInstancesPerNode": ML.least_leaf(ML.DEFAULTS[kind] | members[0])}
        for name in ("numTrees", "maxDepth") if kind == "rf" else ("maxIter",):
            largest[name] = max((ML.DEFAULTS[kind] | m)[name] for m in members)
        out.append((largest, members))
    return out


class Forest:
    """The nodes of a fitted ensemble of Spark ML, children of a node after it."""

    def __init__(self, spark: SparkSession, model, kind: str) -> None:
        folder = os.path.join(scratch_path(spark, "ensembles"), "model")
        model.write().overwrite().save(folder)
        nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()     # as many as the fitted rows allow
        self.kind = kind
        at = np.flatnonzero(np.diff(nodes["treeID"].to_numpy(), prepend=-1))
        self.roots = at
        offset = np.repeat(at, np.diff(np.append(at, len(nodes))))
        self.left, self.right = (np.where(nodes[c] < 0, -1, nodes[c] + offset) for c in ("leftChild", "rightChild"))
        self.feature = np.array([s["featureIndex"] for s in nodes["split"]])
        first = np.array([s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in nodes["split"]])
        slot = np.array([s["numCategories"] >= 0 for s in nodes["split"]])
        # A slot of 0 or 1 goes left where it is in the list: a threshold, with the children changed about for the list [1].
        self.cut, turned = np.where(slot, 0.5, first), slot & (first == 1.0)
        self.left, self.right = np.where(turned, self.right, self.left), np.where(turned, self.left, self.right)
        stats = np.array([list(x)[:2] for x in nodes["impurityStats"]], float)
        self.predicted = nodes["prediction"].to_numpy()
        self.value = self.predicted if kind == "gbt" else stats[:, 1] / np.maximum(stats.sum(1), 1e-300)
        self.weights = np.array(model.treeWeights)
        self.depth = np.zeros(len(nodes), int)
        for v in np.flatnonzero(self.left >= 0):
            self.depth[[self.left[v], self.right[v]]] = self.depth[v] + 1

    def leaves(self, max_depth: int) -> np.ndarray:
        """Nodes where trees end that are grown to ``max_depth``: Spark cuts
        twigs whose leaves predict alike."""
        leaf = (self.left < 0) | (self.depth >= max_depth)
        for v in np.flatnonzero(self.left >= 0)[::-1]:
            a, b = self.left[v], self.right[v]
            leaf[v] |= leaf[a] and leaf[b] and self.predicted[a] == self.predicted[b]
        return leaf

    def margins(self, x: np.ndarray, max_depth: int, sizes: Sequence[int]) -> dict[int, np.ndarray]:
        """Probability of class 1 of each row under the first trees, for each of ``sizes``."""
        leaf, total, out = self.leaves(max_depth), np.zeros(len(x)), {}
        for t, root in enumerate(self.roots[:max(sizes)], 1):
            at = np.full(len(x), root)
            while len(rows := np.flatnonzero(~leaf[at])):
                v = at[rows]
                at[rows] = np.where(x[rows, self.feature[v]] <= self.cut[v], self.left[v], self.right[v])
            total += self.value[at] * (self.weights[t - 1] if self.kind == "gbt" else 1.0)
            if t in sizes:
                out[t] = 1.0 / (1.0 + np.exp(-2.0 * total)) if self.kind == "gbt" else total / t
        return out


def prefix_cells(model: ML.FittedModel, rows: DataFrame, members: list[dict], fold: int) -> DataFrame:
    """(params, fold, tn, fp, fn, tp) of each of the ``members`` of a family whose
    largest is ``model``, on ``rows``, at 0.5, in one scan."""
    kind, size = model.kind, "numTrees" if model.kind == "rf" else "maxIter"
    forest = Forest(rows.sparkSession, model.pipeline.stages[-1], kind)
    full = [ML.DEFAULTS[kind] | m for m in members]
    names = [json.dumps(m, sort_keys=True) for m in members]
    asked: dict[int, list[int]] = {}
    for p in full:
        asked.setdefault(p["maxDepth"], []).append(p[size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            real = batch.column(1).to_numpy() == 1.0
            p = {(d, t): m for d, sizes in asked.items() for t, m in forest.margins(x, d, sizes).items()}
            out = []
            for name, q in zip(names, full):
                got = p[q["maxDepth"], q[size]] >= 0.5
                out.append((name, fold, *(int((a & b).sum()) for a, b in ((~real, ~got), (~real, got), (real, ~got), (real, got)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), CELLS.types)], names=CELLS.names)

    parts = model.features(rows).select(ML.vector_to_array("features").alias("x"), qcol(model.label).cast("double").alias("y")).mapInArrow(
        run, "params string, fold int, tn bigint, fp bigint, fn bigint, tp bigint")
    return parts.groupBy("params", "fold").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def cross_validate_trees(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, kind: str, grid: dict,
                         fold_col: str = "fold", metric: str = "f1", balanced: bool = False, parallelism: int = 4) -> DataFrame:
    """As ``models.cross_validate`` for forests and boosted trees: (params, fold,
    score), one fit for each family and fold."""
    df = materialize(df)
    preps, _ = fit_fold_preps(df, numeric, categorical, fold_col)

    def run(task: tuple[int, tuple[dict, list[dict]]]) -> list:
        fold, (largest, members) = task
        model = ML.fit(df.where(qcol(fold_col) != fold), numeric, categorical, label, kind, balanced=balanced, prep=preps[fold], **largest)
        return prefix_cells(model, df.where(qcol(fold_col) == fold), members, fold).collect()      # a row for each member

    # The longest fits first, so that none is left alone at the end.
    tasks = sorted(itertools.product(preps, families(kind, grid)), key=lambda t: -(ML.DEFAULTS[kind] | t[1][0])["maxDepth"])
    with ThreadPoolExecutor(parallelism) as pool:
        cells = [tuple(r) for some in pool.map(run, tasks) for r in some]
    table = df.sparkSession.createDataFrame(cells, "params string, fold int, tn bigint, fp bigint, fn bigint, tp bigint")
    return EV.metrics_from_confusion(table, ("params", "fold")).select("params", "fold", F.col(metric).alias("score"))


def grid_search(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, grids: dict[str, dict] | None = None,
                fold_col: str = "fold", parallelism: int = 4) -> DataFrame:
    """ML4: (kind, params, mean, std, rank) of all candidates of ``grids`` by mean
    F1 over the folds; ties keep the earlier one.  Defaults to all 42."""
    grids = ML.GRIDS if grids is None else grids
    order = {(k, json.dumps(c, sort_keys=True)): i for i, (k, c) in enumerate((k, c) for k, g in grids.items() for c in ML.candidates(g))}
    df, rows = materialize(df), []
    for kind, grid in grids.items():
        more = {"grid": grid, "fold_col": fold_col, "balanced": kind in ML.BALANCED}
        scores = cross_validate_regressions(df, numeric, categorical, label, **more) if kind == "lr" else \
            cross_validate_trees(df, numeric, categorical, label, kind, parallelism=parallelism, **more)
        rows += [(kind, *r) for r in scores.groupBy("params").agg(F.avg("score"), F.stddev_pop("score")).collect()]
    ranked = sorted(rows, key=lambda r: (-r[2], order[r[0], r[1]]))
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(ranked, 1)], "kind string, params string, mean double, std double, rank int")
