"""Fold statistics, regressions fitted side by side, prefixes of ensembles."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.operators import models as ML
from returnlens.operators import search as SE


@pytest.fixture(scope="module")
def table(spark):
    """Rows with gaps, ties, a column without values and a rare category."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        x, z = float(rng.integers(0, 40)), float(rng.normal())
        c = str(rng.choice(["a", "b", "c", "d"], p=[0.5, 0.3, 0.19, 0.01]))
        y = int(rng.random() < 1 / (1 + np.exp(-(0.08 * x - 1.5 + 0.8 * z + (c == "b")))))
        rows.append((i, i % 3, x if i % 7 else None, z, c if i % 11 else None, None, y))
    return spark.createDataFrame(rows, "id int, fold int, x double, z double, c string, empty double, y int").cache()


NUM, CAT = ["x", "z", "empty"], ["c"]


def test_fold_preparation_equals_a_fit_on_the_other_folds(table):
    preps, values = SE.fit_fold_preps(table, NUM, CAT)
    for fold, prep in preps.items():
        want = ML.fit_prep(table.where(F.col("fold") != fold), NUM, CAT)
        assert prep.medians == want.medians and prep.modes == want.modes
        for c in NUM:
            assert prep.scaler[c] == pytest.approx(want.scaler[c], rel=1e-12, abs=1e-12)
    assert sorted(preps) == [0, 1, 2] and values == {"c": ["a", "b", "c", "d"]}


def test_regressions_fitted_together_equal_single_fits(table):
    grid = {"C": [0.1, 10.0], "penalty": ["l1", "l2"]}
    preps, values = SE.fit_fold_preps(table, NUM, CAT)
    designs = {f: SE.Design(p, values) for f, p in preps.items()}
    fits = [SE.Regression(f, *((r, 0.0) if choice["penalty"] == "l1" else (0.0, r)), params=json.dumps(choice))
            for f in preps for choice in ML.candidates(grid) for r in [1 / (choice["C"] * table.where(F.col("fold") != f).count())]]
    for f in SE.fit_regressions(table, designs, fits, "y", "fold"):
        alone = ML.fit(table.where(F.col("fold") != f.fold), NUM, CAT, "y", "lr", prep=preps[f.fold], tol=1e-10, **json.loads(f.params)).pipeline.stages[-1]
        # A penalty on absolute values leaves a shift between the slots and the intercept open: margins are compared.
        got, want = f.w, np.append(alone.coefficients.toArray(), alone.intercept)
        assert got[:3] == pytest.approx(want[:3], abs=2e-3)
        assert got[3:7] + got[-1] == pytest.approx(want[3:7] + want[-1], abs=2e-3)


def test_cross_validated_scores_equal_single_fits(table):
    got = {(r["params"], r["fold"]): r["score"] for r in SE.cross_validate_regressions(table, NUM, CAT, "y", ML.GRIDS["lr"], balanced=True).collect()}
    want = {(r["params"], r["fold"]): r["score"] for r in ML.cross_validate(table, NUM, CAT, "y", "lr", ML.GRIDS["lr"], balanced=True, tol=1e-9).collect()}
    assert got.keys() == want.keys() and len(got) == 18
    assert all(abs(got[k] - want[k]) < 0.01 for k in got)      # a row near one half may fall on either side


def test_score_equations_are_zero_and_see_a_wrong_fit(table, monkeypatch):
    for balanced in (False, True):
        assert all(abs(r["residual"]) < 1e-6 for r in SE.score_equations(table, NUM, CAT, "y", balanced).collect())
    step = SE._step
    monkeypatch.setattr(SE, "_step", lambda f, *a: (step(f, *a), setattr(f, "done", f.steps > 1)))
    assert any(abs(r["residual"]) > 1e-3 for r in SE.score_equations(table, NUM, CAT, "y").collect())


def test_a_regression_that_does_not_converge_is_an_error(table):
    design = SE.plain_design(table, ["x"], [])
    with pytest.raises(RuntimeError):
        SE.fit_regressions(table, {None: design}, [SE.Regression(None)], "y", max_steps=2)
    with pytest.raises(ValueError):
        SE.fit_regressions(table, {None: design}, [SE.Regression(None)], "y", max_width=1)


def cells(df):
    return {r["params"]: tuple(r[c] for c in ("tn", "fp", "fn", "tp")) for r in df.collect()}


def own_cells(model, rows):
    return tuple(ML.evaluate_model(model, rows, "y").select("tn", "fp", "fn", "tp").first())


def test_boosted_prefix_scores_like_its_own_fit(table):
    train, test = table.where("fold > 0"), table.where("fold = 0")
    members = [{"maxIter": n, "maxDepth": 3, "stepSize": 0.1} for n in (4, 9)]
    (largest, some), = SE.families("gbt", {"maxIter": [4, 9], "maxDepth": [3], "stepSize": [0.1]})
    assert some == members and largest["maxIter"] == 9
    got = cells(SE.prefix_cells(ML.fit(train, NUM, CAT, "y", "gbt", **largest), test, members, 0))
    for m in members:
        assert got[json.dumps(m, sort_keys=True)] == own_cells(ML.fit(train, NUM, CAT, "y", "gbt", **m), test)


def test_forest_prefixes_score_like_their_own_fits(table):
    train, test = table.where("fold > 0"), table.where("fold = 0")
    # One tree chooses among all features, so depths differ by where they stop only.
    members = [{"numTrees": 1, "maxDepth": d} for d in (2, 4, 9)]
    got = cells(SE.prefix_cells(ML.fit(train, NUM, CAT, "y", "rf", numTrees=1, maxDepth=9), test, members, 0))
    for m in members:
        assert got[json.dumps(m, sort_keys=True)] == own_cells(ML.fit(train, NUM, CAT, "y", "rf", **m), test)
    full = ML.fit(train, NUM, CAT, "y", "rf", numTrees=7, maxDepth=5, balanced=True)
    assert list(cells(SE.prefix_cells(full, test, [{"numTrees": 7, "maxDepth": 5}], 0)).values()) == [own_cells(full, test)]


def test_few_fits_hold_the_whole_grid():
    rf, gbt = SE.families("rf", ML.GRIDS["rf"]), SE.families("gbt", ML.GRIDS["gbt"])
    assert len(rf) == 2 and sum(len(m) for _, m in rf) == 24 and all(f["numTrees"] == 200 and f["maxDepth"] == 30 for f, _ in rf)
    assert len(gbt) == 6 and sum(len(m) for _, m in gbt) == 12 and all(f["maxIter"] == 200 for f, _ in gbt)


def test_grid_search_ranks_all_candidates(table):
    grids = {"rf": {"numTrees": [2, 5], "maxDepth": [2, 4]}, "gbt": {"maxIter": [2, 3], "stepSize": [0.1], "maxDepth": [2]}, "lr": {"C": [1.0], "penalty": ["l2"]}}
    got = SE.grid_search(table, NUM, CAT, "y", grids).collect()
    assert [r["rank"] for r in got] == list(range(1, 8)) and len({(r["kind"], r["params"]) for r in got}) == 7
    assert [r["mean"] for r in got] == sorted((r["mean"] for r in got), reverse=True) and all(r["std"] >= 0 for r in got)


def test_steps_read_numbers_and_their_sums_equal_dense_products(table):
    prepared = SE.prepare(table.withColumn("d", F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string"))), NUM, ["c", "d"], "y")
    assert {t for _, t in prepared.rows.dtypes} <= {"double", "int"}
    batch = prepared.rows.toArrow().combine_chunks().to_batches()[0]
    numbers, slots = prepared.design.parts(batch)
    sizes = [n for _, n in prepared.design.slots()]
    x = np.hstack([numbers[:-1].T, *(np.eye(n + 1)[own][:, 1:] for own, n in zip(slots, sizes)), numbers[-1:].T])
    rng = np.random.default_rng(5)
    v, w = rng.random(len(x)), rng.normal(size=x.shape[1])
    assert x.shape == (700, len(prepared.design.names())) and prepared.design.values["d"] == ["0", "1", "2"]
    assert np.allclose(prepared.design.margin(w, numbers, slots), x @ w)
    assert np.allclose(prepared.design.total(v, numbers, slots), v @ x)
    assert np.array_equal(prepared.design.total(None, numbers, slots), (x != 0).sum(0))
    assert np.allclose(prepared.design.curvature(v, numbers, slots), x.T @ (x * v[:, None]))


def test_steps_read_blocks_that_hold_the_rows(table, monkeypatch):
    prepared = SE.prepare(table.repartition(3), NUM, CAT, "y")
    assert {t for _, t in prepared.blocks.dtypes} == {"binary"} and prepared.blocks.count() < 700 / 20
    monkeypatch.setattr(SE, "TAKEN", 2)     # several turns, the last not full
    batches = list(SE._unpacked(prepared.blocks.toArrow().combine_chunks().to_batches()))
    assert len(batches) > 2 and max(b.num_rows for b in batches) == 2 * SE.BLOCK
    got = [tuple(None if v != v else v for v in r.values()) for b in batches for r in b.to_pylist()]
    assert sorted(got, key=repr) == sorted(map(tuple, prepared.rows.collect()), key=repr)


def test_plain_design_equals_a_fit_of_the_preparation(table):
    """Ties go to the smallest text; a category without values has the mode 'Unknown'."""
    df = table.withColumn("d", F.when(F.col("id") < 600, F.concat(F.lit("v"), F.col("id") % 3))).withColumn("none", F.lit(None).cast("string"))
    design = SE.plain_design(df, NUM, ["c", "d", "none"])
    assert design.prep == ML.fit_prep(df, NUM, ["c", "d", "none"]) and design.prep.modes["d"] == "v0"
    assert design.values == {"c": ["a", "b", "c", "d"], "d": ["v0", "v1", "v2"], "none": []}


def test_fits_of_both_weightings_share_their_scans(table, monkeypatch):
    scans, added = [], SE._added
    monkeypatch.setattr(SE, "_added", lambda *a: scans.append(1) or added(*a))
    alone, needed = {}, []
    for balanced in (False, True):
        before = len(scans)
        alone |= {(balanced, r["feature"]): (r["rows"], r["residual"]) for r in SE.score_equations(table, NUM, CAT, "y", balanced).collect()}
        needed.append(len(scans) - before)
    before = len(scans)
    both = {(r["balanced"], r["feature"]): (r["rows"], r["residual"]) for r in SE.score_equations(table, NUM, CAT, "y", (False, True)).collect()}
    assert len(scans) - before == max(needed)
    assert both.keys() == alone.keys() and len(both) == 16
    assert all(both[k][0] == alone[k][0] and both[k][1] == pytest.approx(alone[k][1], abs=1e-6) for k in both)


def test_the_last_move_is_taken():
    """Of a quadratic from a point near its minimum: a sum over many rows would show what is left."""
    curve, best = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([0.3, -0.2])
    near = best + 4e-10
    fit, tried = SE.Regression(None, w=np.zeros(2)), {0: near}
    off = near - best
    SE._step(fit, 0, tried, np.concatenate(([1.0, 0.5 * off @ curve @ off], curve @ off, curve.ravel())), 1e-9)
    assert fit.done and np.abs(fit.w - best).max() < 1e-15
