"""Fits that a task makes whole: against the passes over all rows, against plain searches, and the whole grids."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from daybook.operators import blocks, boosting, forest, models, svm
from daybook.plans import q_models as qm
from tests.test_models import frame


def plain_best(codes, y, w, feats, least):
    """(gain, feature, cut) of the best split of these weighted rows, one by one."""
    best = (0.0, -1, 0)
    for f in feats:
        for c in range(forest.BINS - 1):
            a = codes[:, f] <= c
            n, m = w[a].sum(), w[~a].sum()
            if n >= least and m >= least:
                mean = np.average(y, weights=w)
                gain = n * (np.average(y[a], weights=w[a]) - mean) ** 2 + m * (np.average(y[~a], weights=w[~a]) - mean) ** 2
                if gain > best[0] * (1 + 1e-9) + 1e-12:
                    best = (gain, f, c)
    return best


@pytest.mark.parametrize(("least", "depth", "cells"), [(2, 30, 120_000), (5, 3, 500)])
def test_trees_take_the_best_split_of_their_sample(monkeypatch, least, depth, cells):
    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "SIDE", 150)  # two trees side by side
    rng = np.random.default_rng(5)
    codes = rng.integers(0, forest.BINS, (70, 4)).astype(np.uint8)
    y = codes[:, 0] / 10 + (codes[:, 2] > 9) + rng.normal(size=70)
    got = forest.grow(codes, y, range(3, 6), 2, least, depth, 42)
    pool, alone = forest.subsets(4, 2, 42), [forest.grow(codes, y, [t], 2, least, depth, 42) for t in range(3, 6)]
    assert np.allclose(sum(t.sums(codes, [depth]) for t in alone), got.sums(codes, [depth]))  # whatever grows beside it
    for t, tree in zip(range(3, 6), alone):
        w = np.random.default_rng([42, t]).poisson(1.0, 70).astype(float)
        level, nodes, gain = 0, [(0, w > 0)], np.zeros(4)
        while nodes:
            draw, below = np.random.default_rng([42, t, level]).integers(len(pool), size=len(nodes)), []
            for (at, rows), i in zip(nodes, draw):
                assert tree.value[at] == pytest.approx(np.average(y[rows], weights=w[rows]))
                best = plain_best(codes[rows], y[rows], w[rows], pool[i], least) if level < depth and w[rows].sum() >= 2 * least else (0.0, -1, 0)
                assert tree.feature[at] == best[1]
                if best[1] >= 0:
                    assert tree.cut[at] == best[2]
                    gain[best[1]] += best[0]
                    goes = codes[:, best[1]] > best[2]
                    below += [(tree.left[at], rows & ~goes), (tree.left[at] + 1, rows & goes)]
            nodes, level = below, level + 1
        assert level > 3 and np.allclose(tree.gain, gain / gain.sum())


def test_a_grid_of_forests_shares_its_trees(spark):
    """Scores of a grid are those of its models one by one, in whatever partitions the rows come."""
    df, x, y, fold = frame(spark)
    spec = models.Spec("RandomForest", {"max_depth": [2, 30], "min_leaf": [5, 20], "features": ["sqrt", 0.5]}, **models._grown(60), build=models.roster()["RandomForest"].build, scaled=False)
    fits = models.fit_groups(spec, df)
    assert set(fits) == {(f, i) for f in (0, 1) for i in range(8)} and all(isinstance(m.model, forest.Forest) and m.model.getNumTrees == 60 for m in fits.values())
    for train, rows in ((df, df), (df.repartition(5), df.coalesce(1))):
        got = models.fit_predict(spec, train, rows, ["id", "y"]).toPandas()
        assert len(got) == 401 * 8
        for (g, i), m in fits.items():
            part = got[(got.fold == g) & (got.point == str(spec.points()[i])) & (got.id < 400)].sort_values("id")
            assert part.id.tolist() == np.flatnonzero(fold == g).tolist() and np.allclose(part.pred, m.model.array(x[part.id]))
            assert m.weights().sum() == pytest.approx(1) and (m.params["max_depth"] > 2) == (np.corrcoef(part.pred, part.y)[0, 1] > 0.92) or m.params["min_leaf"] == 20


def test_classes_have_their_leaf_shares(spark):
    df, x, y, fold = frame(spark, classes=True)
    m = models.fit(models.classifiers(trees=20)["RandomForest"], {"max_depth": 30, "min_leaf": 5}, df, "y")
    p = m.model.array(x)
    assert 0 <= p.min() < 0.1 and 0.9 < p.max() <= 1 and ((p > 0.5) == (y > 0)).mean() > 0.9
    assert np.allclose([r.pred for r in m.predict(df.filter("id < 9").orderBy("id")).collect()], p[:9])


def test_odd_groups_have_forests(spark):
    """One row, equal labels, groups without test rows, rows without keys, and no rows at all."""
    rows = [(0, [1.0, 2.0], 3.0), *[(1, [float(i), 0.0], 5.0) for i in range(30)], *[(2, [float(i), 0.0], float(i)) for i in range(30)]]
    df = spark.createDataFrame(rows, "fold int, x array<double>, y_fit double").withColumn("z", F.col("x"))
    spec = models.at_point(models.roster(trees=4)["RandomForest"], {"max_depth": 3, "min_leaf": 1, "features": 0.5})
    got = models.fit_predict(spec, df, df.filter("fold < 2"), ["y_fit"]).collect()
    assert len(got) == 31 and {(r.fold, r.pred) for r in got} == {(0, 3.0), (1, 5.0)}
    assert models.fit_groups(spec, df.limit(0)) == {} and models.fit_predict(spec, df.limit(0), df, ["y_fit"]).count() == 0


@pytest.mark.parametrize("binary", [False, True])
def test_boosting_in_a_task_is_boosting_in_passes(spark, binary):
    df, x, y, fold = frame(spark, classes=binary)
    points = [{"max_depth": d, "learning_rate": 0.2, "reg_lambda": 1} for d in (1, 2, 3)]
    want, got = (f(df, points, keys=["id"], rounds=8, binary=binary) for f in (boosting.boost, boosting.boost_apart))
    assert set(got) == set(want) == {(g, i) for g in (0, 1) for i in range(3)}
    for f, m in got.items():
        assert np.allclose(m.array(x), want[f].array(x)) and np.allclose(m.gain, want[f].gain)
    assert boosting.boost_apart(df.limit(0), points, keys=["id"]) == {}


@pytest.mark.parametrize(("loss", "size"), [("epsilon", 20), ("hinge", 0), ("logistic", 0)])
def test_machines_of_a_task_are_those_of_passes(spark, loss, size):
    df, x, y, fold = frame(spark, classes=loss != "epsilon")
    want, got = (svm.machines(df, [{"C": 0.1}, {"C": 1.0}], keys=["id"], size=size, loss=loss, together=t) for t in (True, False))
    assert set(got) == set(want) and all(np.array_equal(m.weight, want[f].weight) and m.intercept == want[f].intercept for f, m in got.items())  # to the last digit


def test_small_fits_take_no_pass_per_step(spark, monkeypatch):
    """A pass over the rows for each level of each tree, or each step, was what the model queries took their time for."""
    def no_pass(*_):
        raise AssertionError("a pass")

    for where in (boosting, svm):
        monkeypatch.setattr(where, "added", no_pass)
    df, x, *_ = frame(spark)
    r = models.roster(trees=3, rounds=3, fourier=8)
    for name in ("BoostedTrees", "KernelSVR", "RandomForest"):
        assert len(models.fit_groups(r[name], df)) == 2 * len(r[name].points())
    monkeypatch.setattr(blocks, "SMALL", 0)  # more rows than a task holds
    assert isinstance(models.fit(r["RandomForest"], {"max_depth": 2, "min_leaf": 5}, df).model, RandomForestRegressionModel)
    for name in ("BoostedTrees", "KernelSVR"):
        with pytest.raises(AssertionError, match="a pass"):
            models.fit(r[name], r[name].points()[0], df)


def test_searches_take_whole_grids(spark, monkeypatch, tmp_path):
    """All points of all models are searched, and a query that needs some models searches only these."""
    asked = []

    def search(specs, *_):
        asked.append({x.name: x.points() for x in specs})
        rows = [(x.name, str(p), float(i), 0.0, i + 1 == len(x.points())) for x in specs for i, p in enumerate(x.points())]
        return spark.createDataFrame(rows, "model string, point string, cv_mean double, cv_std double, is_best boolean")

    monkeypatch.setattr(qm, "frames", lambda s, d: None)
    monkeypatch.setattr(qm.models, "grid_search", search)
    whole = models.roster()
    assert qm.best_points(spark, str(tmp_path), ["KernelSVR"]) == {"KernelSVR": {"C": 10}}
    assert qm.grid(spark, str(tmp_path)).count() == sum(len(x.points()) for x in whole.values()) == 41
    assert asked == [{"KernelSVR": whole["KernelSVR"].points()}, {n: x.points() for n, x in whole.items() if n != "KernelSVR"}]
    assert {n: x.points() for n, x in qm.CLASSIFIERS.items()} == {n: x.points() for n, x in models.classifiers().items()}
    assert qm.best_points(spark, str(tmp_path))["RandomForest"]["max_depth"] == models.UNLIMITED and len(asked) == 2
