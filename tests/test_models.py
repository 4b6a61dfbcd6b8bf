"""Fits against plain versions: pair-sum solvers, histogram boosting, support vector machines, stored artefacts."""

from threading import Barrier

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from daybook.operators import artefacts, boosting, linear, models, svm
from daybook.operators.blocks import blocks
from daybook.session import scratch_path


def frame(spark, n=400, k=5, folds=2, seed=0, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    x[:, 3] = 0.9 * x[:, 0] + 0.1 * x[:, 3]
    y = 2 * x[:, 0] - x[:, 1] + np.where(x[:, 2] > 0, 1.0, 0.0) + 0.5 * rng.normal(size=n)
    y = (y > 0.3).astype(float) if classes else y + 3
    rows = [(i, i % folds, v.tolist(), v.tolist(), float(t), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, fold int, x array<double>, z array<double>, y double, y_fit double").repartition(3)
    odd = spark.createDataFrame([(n, 0, [1.0] * k, [1.0] * k, None, None)], df.schema)
    return df.unionByName(odd), x, y, np.arange(n) % folds


def test_pair_sums_give_the_linear_models(spark):
    df, x, y, fold = frame(spark)
    gs = linear.grams(df, ["fold"])
    for f in (0, 1):
        a = np.column_stack([x[fold == f], y[fold == f]])
        assert gs[f,].n == len(a) and np.allclose(gs[f,].mean, a.mean(0)) and np.allclose(gs[f,].pairs, (a - a.mean(0)).T @ (a - a.mean(0)))
    sd, rows = gs[0,].sd_y, df.filter("fold = 0 and y is not null").select(array_to_vector("z").alias("f"), F.col("y_fit").alias("l"))

    for name, params, l1, l2 in (
        ("Ridge", {"alpha": 30.0}, 0, 30.0 / gs[0,].n), ("Lasso", {"alpha": 0.2}, 0.2, 0), ("Lasso", {"alpha": 0.01}, 0.01, 0), ("Lasso", {"alpha": 50.0}, 50.0, 0),
        ("ElasticNet", {"alpha": 0.3, "l1_ratio": 0.4}, 0.12, 0.18),
    ):
        m = models.fit_groups(models.at_point(models.roster()[name], params), df)[0, 0].model
        reg = l1 + l2 * sd  # MLlib scales the label by its deviation
        ml = LinearRegression(featuresCol="f", labelCol="l", regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, standardization=False, maxIter=5000, tol=1e-14).fit(rows)
        assert np.allclose(m.weight, ml.coefficients.toArray(), atol=2e-6) and m.intercept == pytest.approx(ml.intercept, abs=1e-5), name
        assert np.allclose(m.array(x[:5]), [r.pred for r in models.Fitted(models.roster()[name], params, m).predict(df.filter("id < 5").orderBy("id")).collect()])


def test_subsets_of_the_sums_are_fits_of_the_subsets(spark):
    df, x, y, fold = frame(spark)
    both = df.withColumn("role", F.lit("train")).unionByName(df.withColumn("role", F.lit("test")))
    r = models.roster()
    kernel = models.at_point(models.roster(fourier=20)["KernelSVR"], {"C": 1})
    got = models.ablation([r["Ridge"], r["Lasso"], kernel], both, {"few": [0, 4], "all": range(5)}, [0], 1, ["id"])
    rows = {(g.feature_set, g.model): g for g in got.collect()}
    assert set(rows) == {(s, m) for s in ("few", "all") for m in ("Ridge", "Lasso", "KernelSVR")}
    assert rows["all", "KernelSVR"].test_spearman > rows["few", "KernelSVR"].test_spearman > 0
    best = rows["few", "Ridge"]
    alpha = eval(best.point)["alpha"]  # noqa: S307 - written by the code under test
    a, b = x[fold == 1][:, [0, 4]], y[fold == 1]
    c = a - a.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (b - b.mean()))
    assert best.test_spearman == pytest.approx(pd.Series(a @ w).rank().corr(pd.Series(b).rank()), abs=1e-9)
    assert (best.n_features, best.degenerate) == (2, 0)


def plain_boost(x, y, h, edges, p, rounds, binary, k, seed=42):
    """Node by node over the rows themselves."""
    codes, n = boosting.binned(x, edges), len(y)
    margin = np.full(n, np.log(y.mean() / (1 - y.mean())) if binary else y.mean())
    rng, lam = np.random.default_rng(seed), p["reg_lambda"]
    for t in range(rounds):
        use = boosting.sampled(h, t, seed, 0.8)
        allowed = sorted(rng.permutation(k)[: max(1, round(0.8 * k))])
        prob = 1 / (1 + np.exp(-margin)) if binary else margin
        g, w = prob - y, prob * (1 - prob) if binary else np.ones(n)

        def grow(rows, depth, g=g, w=w, use=use, allowed=allowed):
            live = rows & use
            best = (1e-9 * max(abs(g[live].sum()), 1.0), None)
            if depth < p["max_depth"]:
                for f in allowed:
                    for c in range(boosting.BINS - 1):
                        a, b = live & (codes[:, f] <= c), live & (codes[:, f] > c)
                        if w[a].sum() >= 1 and w[b].sum() >= 1:
                            gain = sum(g[s].sum() ** 2 / (w[s].sum() + lam) for s in (a, b)) - g[live].sum() ** 2 / (w[live].sum() + lam)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (f, c))
            if best[1] is None:
                return np.where(rows, -p["learning_rate"] * g[live].sum() / (w[live].sum() + lam), 0.0)
            f, c = best[1]
            return grow(rows & (codes[:, f] <= c), depth + 1) + grow(rows & (codes[:, f] > c), depth + 1)

        margin = margin + grow(np.ones(n, bool), 0)
    return 1 / (1 + np.exp(-margin)) if binary else margin


@pytest.mark.parametrize("binary", [False, True])
def test_histogram_boosting_is_boosting(spark, monkeypatch, binary):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    monkeypatch.setattr(boosting, "ALONG", 2)
    df, x, y, fold = frame(spark, n=160, seed=1, classes=binary)
    points = [{"max_depth": 2, "learning_rate": 0.3, "reg_lambda": 1}, {"max_depth": 3, "learning_rate": 0.2, "reg_lambda": 5}]
    fits = boosting.boost(df, points, keys=["id"], rounds=7, binary=binary)
    assert set(fits) == {(f, i) for f in (0, 1) for i in (0, 1)}
    for r in df.filter("y is not null").groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("id", F.xxhash64("id").alias("h")))).alias("r")).collect():
        at = [v.id for v in r.r]
        h = np.array([v.h for v in r.r]).view(np.uint64)
        for i, p in enumerate(points):
            m = fits[r.fold, i]
            assert np.allclose(m.array(x[at]), plain_boost(x[at], y[at], h, m.edges, p, 7, binary, 5), atol=1e-8)
    again = boosting.boost(df.repartition(7), points, keys=["id"], rounds=7, binary=binary)
    assert all(np.allclose(again[f].array(x), fits[f].array(x)) for f in fits)


def test_blocks_of_a_fit_are_even(spark):
    """Rows in one file per fold are dealt out to all cores; a task has few folds."""
    big = spark.range(12_000).selectExpr("id", "cast(least(floor(id / 1500), 2) as int) fold", "array(cast(id as double), 1D) x", "cast(id as double) y").coalesce(1)
    with blocks(big, "fold", "x", "y", ["id"]) as data:
        tasks = data.mapPartitions(lambda part: [[(g, len(x)) for g, x, _, _ in part]]).collect()
    sizes = [sum(n for _, n in t) for t in tasks]
    assert sum(sizes) == 12_000 and len(sizes) >= 4 and max(sizes) < 2 * 12_000 / len(sizes) and sum(len({g for g, _ in t}) for t in tasks) <= len(tasks) + 2


def test_boosting_adds_up_one_child_of_a_node(spark, monkeypatch):
    """Below the root a pass gives sums of one child of each node and only of the tree's features."""
    shapes, real = [], boosting.added
    monkeypatch.setattr(boosting, "added", lambda *a: [shapes.append({h.shape for h in got.values()}) or got for got in [real(*a)]][0])
    df, x, *_ = frame(spark)
    boosting.boost(df, [{"max_depth": 3}], keys=["id"], rounds=2)
    assert shapes == [{(n, 4, boosting.BINS, 2)} for n in (1, 1, 2)] * 2


def test_forests_hold_no_tree_objects(spark):
    df, x, y, fold = frame(spark)
    for spec, rows in ((models.roster(trees=5)["RandomForest"], df), (models.classifiers(trees=5)["RandomForest"], frame(spark, classes=True)[0])):
        m = models.fit(spec, {"max_depth": 3, "min_leaf": 5}, rows).model
        m.write().overwrite().save(path := scratch_path(spark, "forest"))
        again = type(m).load(path)
        for one in (m, again):
            assert "trees" not in vars(one) and one.getNumTrees == 5 == len(one.trees) and one.getMaxDepth() == 3
        ready = rows.select("id", array_to_vector("x").alias("_f"))
        assert m.transform(ready).orderBy("id").select("prediction").collect() == again.transform(ready).orderBy("id").select("prediction").collect()


def test_steps_of_a_minimum_are_tried_together():
    """Halvings of a step share passes, and the longest good one is taken."""
    calls = []

    def value(points):
        calls.append(len(points))
        return {f: (50 * v @ v, 100 * v) for f, v in points.items()}

    got = svm.minimise(value, {(0, 0): np.array([1.0, 0.0]), (0, 1): np.array([0.0, 3.0])}, rounds=30)
    assert all(np.abs(v).max() < 1e-6 for v in got.values())
    assert max(calls) <= 2 * max(svm.HALVED) and sum(svm.HALVED) == 25
    passes = []  # of a function without a way down
    svm.minimise(lambda p: passes.append(1) or {f: (float(len(f) > 2), np.ones(2)) for f in p}, {(0, 0): np.zeros(2)}, rounds=5)
    assert len(passes) == 1 + len(svm.HALVED)


def test_models_are_fitted_at_the_same_time():
    """Each waits for the other."""
    both = Barrier(2, timeout=20)
    assert models.at_once([lambda: both.wait() >= 0 and "a", lambda: both.wait() >= 0 and "b"]) == ["a", "b"] and models.at_once([]) == []


def test_boosting_of_constant_labels(spark):
    df, x, _, _ = frame(spark)
    flat = df.withColumn("y_fit", F.lit(2.5))
    m = boosting.boost(flat, [{}], keys=["id"], rounds=3)[0, 0]
    assert np.allclose(m.array(x), 2.5)
    assert boosting.boost(df.limit(0), [{}], keys=["id"], rounds=3) == {}


def test_support_vector_regression_has_no_duality_gap(spark):
    df, x, y, fold = frame(spark)
    for (f, _), m in svm.machines(df, [{"C": 0.5}], keys=["id"], size=30).items():
        a, t = svm.mapped(x[fold == f], m.map), y[fold == f]
        r = a @ m.weight + m.intercept - t
        primal = m.weight @ m.weight / 2 + 0.5 * np.maximum(np.abs(r) - 0.1, 0).sum()
        alpha = -0.5 * (svm.rounded(r - 0.1, svm.WIDTHS[-1])[1] - svm.rounded(-r - 0.1, svm.WIDTHS[-1])[1])
        assert abs(alpha.sum()) < 1e-2 and np.allclose(a.T @ alpha, m.weight, atol=1e-2)
        w = a.T @ alpha
        dual = alpha @ t - 0.1 * np.abs(alpha).sum() - w @ w / 2
        assert dual <= primal + 1e-2 and primal - dual < 0.01 * primal


def test_support_vector_classes_have_no_duality_gap(spark):
    df, x, y, fold = frame(spark, classes=True)
    for (f, _), m in svm.machines(df, [{"C": 1.0}], keys=["id"], size=0, loss="hinge").items():
        a, s = x[fold == f], 2 * y[fold == f] - 1
        margin = s * m.array(a)
        primal = m.weight @ m.weight / 2 + np.maximum(1 - margin, 0).sum()
        alpha = svm.rounded(1 - margin, svm.WIDTHS[-1])[1]
        w = a.T @ (alpha * s)
        dual = alpha.sum() - w @ w / 2
        assert abs((alpha * s).sum()) < 1e-2 and primal - dual < 0.01 * primal
        assert ((m.array(a) > 0) == (s > 0)).mean() > 0.85


def test_logistic_model_is_at_its_minimum(spark):
    df, x, y, fold = frame(spark, classes=True)
    for (f, _), m in svm.machines(df, [{"C": 0.3}], keys=["id"], size=0, loss="logistic").items():
        a, t, p = x[fold == f], y[fold == f], m.array(x[fold == f])
        assert np.abs(m.weight + 0.3 * a.T @ (p - t)).max() < 1e-3 and abs((p - t).sum()) < 1e-3 and 0 < p.min() < p.max() < 1


def test_frozen_models_need_no_training_rows(spark):
    df, x, y, _ = frame(spark)
    cols = [f"f{i}" for i in range(5)]
    wide = df.filter("y is not null").select("id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    train, path = scratch_path(spark, "train"), scratch_path(spark, "frozen")
    wide.write.parquet(train)
    rows = spark.read.parquet(train)
    from daybook.operators import prep

    params = prep.fit_frame(rows, cols, cols, y="y")
    ready = prep.apply_frame(rows, params, cols, y="y", keep=["id"])
    roster = models.roster(trees=5, rounds=4, fourier=20)
    points = {"Ridge": {"alpha": 1}, "BoostedTrees": {"max_depth": 2, "learning_rate": 0.3, "reg_lambda": 1}, "KernelSVR": {"C": 1}, "RandomForest": {"max_depth": 3, "min_leaf": 5, "features": "sqrt"}}
    fits = [models.fit(roster[n], p, ready) for n, p in points.items()]
    want = models.ensemble_predictions(fits, ready, ["id"]).orderBy("id").toPandas()
    artefacts.save(spark, path, fits, params)
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(train)  # the training table is gone
    again = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x))))
    frozen = artefacts.load(spark, path, models.roster(), list(points))
    got = frozen.predict(again, cols, ["id"]).orderBy("id").toPandas()
    assert got.columns.tolist() == want.columns.tolist() and np.allclose(got.drop(columns="id"), want.drop(columns="id"))
    assert [f.params for f in frozen.members] == list(points.values())


def test_permutation_importance_of_a_linear_model(spark):
    """A swap moves a prediction by coefficient times difference, so the donors can be told from hashes."""
    df, x, y, fold = frame(spark, n=120)
    test = df.filter("y is not null").withColumn("role", F.lit("test"))
    w = np.array([2.0, -1.0, 0.5, 0.0, 0.0])
    fits = {f: models.Fitted(models.roster()["Ridge"], {}, linear.Linear(w, 1.0)) for f in (0, 1)}
    got = {r.feature: r.importance for r in models.permutation_importance(fits, test, list("abcde"), ["id"], ["id"], repeats=3).collect()}
    spear = lambda a, b: pd.Series(a).rank().corr(pd.Series(b).rank())
    drop = {j: [] for j in range(5)}
    for r in range(3):
        h = {v.id: v.h for v in test.select("id", F.xxhash64(F.lit(r) + models.SEED, "id").alias("h")).collect()}
        for f in (0, 1):
            ids = np.flatnonzero(fold == f)
            donors = sorted(ids, key=lambda i: h[i])
            for j in range(5):
                pred = x[ids] @ w + w[j] * (x[donors, j] - x[ids, j])
                drop[j].append(spear(x[ids] @ w, y[ids]) - spear(pred, y[ids]))
    assert all(got["abcde"[j]] == pytest.approx(np.mean(v), abs=1e-9) for j, v in drop.items())
    assert got["d"] == got["e"] == 0 < got["b"] < got["a"]


def test_model_frames_read_their_rows_once(spark, monkeypatch):
    """The rows of all roles are written before the passes of the preparation read them."""
    from daybook.plans import q_models as qm

    rows = spark.createDataFrame([(i % 2, "train" if i % 3 else "test") for i in range(12)], "fold int, role string").repartition(3)
    seen = []
    monkeypatch.setattr(qm, "role_rows", lambda s, d: rows)
    monkeypatch.setattr(qm.prep, "fit_frame", lambda train, *_, **__: seen.append(train) or train)
    monkeypatch.setattr(qm.prep, "apply_frame", lambda got, *_, **__: got)
    assert qm._frames(spark, "", [], []).count() == 12 and seen[0].count() == 8
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
