"""Model roster: every fit is a Spark job over prepared rows.

Input rows carry ``x`` (clipped, imputed features), ``z`` (also standardised), ``y`` (raw
label) and ``y_fit`` (clipped label). Linear models are solved from pair sums, boosted trees, support vector machines and
logistic models of all folds and grid points are fitted in the same passes, or each whole in a task if the rows fit one. So are
forests; those of more rows are MLlib's, a few fits at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.ranking import order_positions, spearman
from daybook.operators import boosting, forest, linear, svm
from daybook.operators import metrics as mt
from daybook.operators.blocks import even_tasks, fits_a_task
from daybook.session import materialize

# fixed values
SEED = 42
UNLIMITED = 30  # MLlib's maximum depth, for trees that only min_leaf ends
PARALLEL = 4  # fits of one roster that run at the same time


@dataclass(frozen=True)
class Spec:
    """A model: its grid, which feature array it reads, and one way to fit it.

    ``solve`` (params, pair sums) -> weights; ``joint`` (rows, points, keys, by, label) -> models of all groups and points;
    ``build`` (params, label statistics) -> MLlib estimator, for rows that don't fit a task if there is also ``joint``; ``scored`` (rows,
    points, test rows, keep, keys, by, label) -> predictions of the joint models, which stay in their tasks.
    """

    name: str
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    build: Callable[[Mapping, Mapping], object] | None = None
    solve: Callable[[Mapping, linear.Gram], np.ndarray] | None = None
    joint: Callable[..., dict] | None = None
    scored: Callable[..., DataFrame] | None = None
    scaled: bool = True
    classifier: bool = False

    @property
    def source(self) -> str:
        return "z" if self.scaled else "x"

    def points(self) -> list[dict]:
        keys = list(self.grid)
        return [dict(zip(keys, v)) for v in product(*[self.grid[k] for k in keys])]


@dataclass
class Fitted:
    spec: Spec
    params: dict
    model: object

    def predict(self, rows: DataFrame, out: str = "pred") -> DataFrame:
        kept = [c for c in rows.columns if c != out]
        model = self.model
        if isinstance(model, linear.Linear):
            return rows.select(*kept, model.column(model.source).alias(out))
        if hasattr(model, "array"):

            @F.pandas_udf("double")
            def run(x: pd.Series) -> pd.Series:
                return pd.Series(model.array(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

            return rows.select(*kept, run(model.source).alias(out))
        got = model.transform(rows.withColumn("_f", array_to_vector(F.col(self.spec.source))))
        p = vector_to_array(F.col("probability"))[1] if self.spec.classifier else F.col("prediction")
        return got.select(*kept, p.alias(out))

    def weights(self) -> np.ndarray:
        """Coefficients, or importances that add up to 1."""
        m = self.model
        if isinstance(m, linear.Linear):
            return m.weight
        if isinstance(m, boosting.Boosted):
            return m.gain / max(m.gain.sum(), 1e-300)
        if isinstance(m, forest.Forest):
            return m.grown.gain / max(m.grown.gain.sum(), 1e-300)
        return (m.coefficients if hasattr(m, "coefficients") else m.featureImportances).toArray()

    def importance(self, names: Sequence[str]) -> DataFrame:
        """(model, feature, importance, coefficient), largest first."""
        rows = [(self.spec.name, n, float(v)) for n, v in zip(names, self.weights(), strict=True)]
        out = SparkSession.getActiveSession().createDataFrame(rows, "model string, feature string, coefficient double")
        return out.withColumn("importance", F.abs("coefficient")).orderBy(F.col("importance").desc(), "feature")


class _Slim:
    """A forest whose trees are no attribute of their own: PySpark lists a model's attributes to find its parameters, and ``trees`` as it
    is makes an object of each tree then, which takes seconds for 400."""

    @property
    def trees(self):
        return list(self._call_java("trees"))

    @classmethod
    def load(cls, path: str):
        stored = next(c for c in cls.__mro__ if c.__module__.startswith("pyspark.ml.")).read()
        model = cls(stored._jread.load(path))
        model._transfer_params_from_java()
        return model


class ForestRegression(_Slim, RandomForestRegressionModel):
    pass


class ForestClassification(_Slim, RandomForestClassificationModel):
    pass


class ForestRegressor(RandomForestRegressor):
    def _create_model(self, java_model):
        return ForestRegression(java_model)


class ForestClassifier(RandomForestClassifier):
    def _create_model(self, java_model):
        return ForestClassification(java_model)


def _ridge(p: Mapping, g: linear.Gram) -> np.ndarray:
    return linear.ridge(g, p["alpha"])


def _lasso(p: Mapping, g: linear.Gram) -> np.ndarray:
    return linear.coordinate_descent(g, p["alpha"])


def _elastic(p: Mapping, g: linear.Gram) -> np.ndarray:
    return linear.coordinate_descent(g, p["alpha"] * p["l1_ratio"], p["alpha"] * (1 - p["l1_ratio"]))


def _forest(cls, trees: int):
    def build(p: Mapping, s: Mapping):
        return cls(
            numTrees=trees, maxDepth=p.get("max_depth", 5), minInstancesPerNode=p.get("min_leaf", 20),
            featureSubsetStrategy=str(p.get("features", "sqrt")), seed=SEED,
        )
    return build


def _grown(trees: int) -> dict[str, Callable]:
    def joint(rows: DataFrame, points: Sequence[Mapping], keys: Sequence[str], by: str, label: str) -> dict:
        return forest.forests(rows, points, keys=keys, by=by, y=label, trees=trees, seed=SEED)

    def scored(rows: DataFrame, points: Sequence[Mapping], test: DataFrame, keep: Sequence[str], keys: Sequence[str], by: str, label: str) -> DataFrame:
        return forest.scored(rows, points, test, keep, keys=keys, by=by, y=label, trees=trees, seed=SEED)

    return {"joint": joint, "scored": scored}


def _boosted(rounds: int, binary: bool = False):
    def joint(rows: DataFrame, points: Sequence[Mapping], keys: Sequence[str], by: str, label: str) -> dict:
        boost = boosting.boost_apart if fits_a_task(rows, "x", label, 1) else boosting.boost
        return boost(rows, points, keys=keys, by=by, y=label, rounds=rounds, binary=binary, seed=SEED)
    return joint


def _machine(size: int, loss: str = "epsilon"):
    def joint(rows: DataFrame, points: Sequence[Mapping], keys: Sequence[str], by: str, label: str) -> dict:
        whole = fits_a_task(rows, "z", label, 8)
        return svm.machines(rows, points, keys=keys, by=by, y=label, size=size, loss=loss, seed=SEED, together=not whole)
    return joint


# fixed values: the grids of the rosters
RIDGE = {"alpha": [0.1, 1, 10, 100, 1000]}
LASSO = {"alpha": [1e-3, 1e-2, 1e-1, 1]}
ELASTIC = {"alpha": [1e-2, 1e-1, 1], "l1_ratio": [0.2, 0.5, 0.8]}
FOREST = {"max_depth": [3, 5, UNLIMITED], "min_leaf": [5, 20], "features": ["sqrt", 0.5]}
BOOSTED = {"max_depth": [2, 3], "learning_rate": [0.02, 0.05], "reg_lambda": [1, 5]}
MACHINE = {"C": [0.1, 1, 10]}
LOGISTIC = {"C": [0.01, 0.1, 1, 10]}
FOREST_CLASSES = {"max_depth": [3, 5, UNLIMITED], "min_leaf": [5, 20]}


def roster(trees: int = 400, rounds: int = 300, fourier: int = 200) -> dict[str, Spec]:
    return {
        "Ridge": Spec("Ridge", RIDGE, solve=_ridge),
        "Lasso": Spec("Lasso", LASSO, solve=_lasso),
        "ElasticNet": Spec("ElasticNet", ELASTIC, solve=_elastic),
        "RandomForest": Spec("RandomForest", FOREST, build=_forest(ForestRegressor, trees), **_grown(trees), scaled=False),
        "BoostedTrees": Spec("BoostedTrees", BOOSTED, joint=_boosted(rounds), scaled=False),
        "KernelSVR": Spec("KernelSVR", MACHINE, joint=_machine(fourier)),
    }


def classifiers(trees: int = 400, rounds: int = 300, fourier: int = 200) -> dict[str, Spec]:
    return {
        "LogisticRegression": Spec("LogisticRegression", LOGISTIC, joint=_machine(0, "logistic"), classifier=True),
        "RandomForest": Spec("RandomForest", FOREST_CLASSES, build=_forest(ForestClassifier, trees), **_grown(trees), scaled=False, classifier=True),
        "BoostedTrees": Spec("BoostedTrees", BOOSTED, joint=_boosted(rounds, binary=True), scaled=False, classifier=True),
        "KernelSVM": Spec("KernelSVM", MACHINE, joint=_machine(fourier, "hinge"), classifier=True),
    }


def at_point(spec: Spec, params: Mapping) -> Spec:
    """The same model with one grid point."""
    return replace(spec, grid={k: [v] for k, v in params.items()})


def _keys(rows: DataFrame, label: str) -> list[str]:
    """What names a row: its columns beside the features and labels."""
    return [c for c in rows.columns if c not in {"x", "z", "y", "y_fit", label}]


def _in_tasks(spec: Spec, train: DataFrame, label: str | None) -> bool:
    """Whether forests are grown in tasks that hold all rows: a byte a feature, and its number while it is binned."""
    return spec.build is not None and spec.joint is not None and fits_a_task(train, spec.source, label, 1)


def fit(spec: Spec, params: Mapping, train: DataFrame, label: str = "y_fit") -> Fitted:
    """One fit over all rows of ``train``."""
    if spec.build is not None and not _in_tasks(spec, train, label):
        # label statistics needed for the penalties come from one small aggregate
        st = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
        stats = {"n": float(st.n), "sd": float(st.sd or 0.0) or 1.0}
        rows = train.filter(F.col(label).isNotNull()).select(array_to_vector(F.col(spec.source)).alias("_f"), F.col(label).cast("double").alias("_y"))
        tasks = even_tasks(rows, st.n)
        if tasks:
            rows = rows.repartition(tasks)
        return Fitted(spec, dict(params), spec.build(params, stats).setFeaturesCol("_f").setLabelCol("_y").fit(rows))
    return fit_groups(at_point(spec, params), train.withColumn("_all", F.lit(0)), "_all", label)[0, 0]


def at_once(todo: Sequence[Callable[[], object]]) -> list:
    """What each gives. Passes of some fits are mostly their start, so different models are fitted at the same time."""
    with ThreadPoolExecutor(max(1, len(todo))) as pool:
        return [f.result() for f in [pool.submit(run) for run in todo]]


def fit_groups(spec: Spec, train: DataFrame, by: str = "fold", label: str = "y_fit") -> dict[tuple[int, int], Fitted]:
    """A fit for every group of the int column ``by`` and every grid point: (group, number of the point) -> fit."""
    points = spec.points()
    if spec.solve is not None:
        got = linear.grams(train, [by], spec.source, label)
        made = {(g, i): linear.solved(gram, spec.solve(p, gram), source=spec.source) for (g,), gram in got.items() for i, p in enumerate(points)}
    elif spec.joint is not None and (spec.build is None or _in_tasks(spec, train, label)):
        made = spec.joint(train, points, [c for c in _keys(train, label) if c != by], by, label)
    else:
        groups = sorted(r[0] for r in train.select(by).distinct().collect())
        todo = [(g, i) for g in groups for i in range(len(points))]
        with ThreadPoolExecutor(PARALLEL) as pool:
            return dict(zip(todo, pool.map(lambda t: fit(spec, points[t[1]], train.filter(F.col(by) == t[0]), label), todo), strict=True))
    return {(g, i): Fitted(spec, points[i], m) for (g, i), m in made.items()}


def predictions(fits: Mapping[tuple[int, int], Fitted], rows: DataFrame, keep: Sequence[str], by: str = "fold") -> DataFrame:
    """``keep``, ``by``, model, point and pred of every fit for the rows of its group."""
    keep = [c for c in keep if c != by]
    quick = {((g,), f"{f.spec.name}|{f.params}"): f.model for (g, _), f in fits.items() if hasattr(f.model, "array")}
    parts = []
    if quick:
        got = linear.scores(rows, quick, keep, [by])
        parts.append(got.select(*keep, by, F.substring_index("which", "|", 1).alias("model"), F.expr("substring(which, instr(which, '|') + 1)").alias("point"), "pred"))
    for (g, _), f in fits.items():
        if not hasattr(f.model, "array"):
            got = f.predict(rows.filter(F.col(by) == g).select(*keep, by, "x", "z"))
            parts.append(got.select(*keep, by, F.lit(f.spec.name).alias("model"), F.lit(str(f.params)).alias("point"), "pred"))
    return _union(parts)


def fit_predict(spec: Spec, train: DataFrame, rows: DataFrame, keep: Sequence[str], by: str = "fold", label: str = "y_fit") -> DataFrame:
    """``predictions`` of ``fit_groups``, without the models where these are large."""
    if spec.scored is not None and _in_tasks(spec, train, label) and _in_tasks(spec, rows, None):
        keep, points = [c for c in keep if c != by], spec.points()
        got = spec.scored(train, points, rows, keep, [c for c in _keys(train, label) if c != by], by, label)
        name = F.array(*[F.lit(str(p)) for p in points])
        return got.select(*keep, by, F.lit(spec.name).alias("model"), F.get(name, F.col("_point")).alias("point"), "pred")
    return predictions(fit_groups(spec, train, by, label), rows, keep, by)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_predictions(fits: Sequence[Fitted], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, model and pred of each fit for all rows."""
    one = rows.withColumn("_all", F.lit(0))
    return predictions({(0, i): f for i, f in enumerate(fits)}, one, keep, "_all").select(*keep, "model", "pred")


def linear_ablation(
    specs: Sequence[Spec], frames: DataFrame, subsets: Mapping[str, Sequence[int]], folds: Sequence[int], final: int, keys: Sequence[str], label: str = "y_fit"
) -> DataFrame:
    """Per feature set and linear model, its best point by mean fold Spearman: that score, the test score of the fit on fold
    ``final``, and whether that fit is constant on its own rows.

    One pass gives the pair sums of all folds; every set, model and point is solved from them, and one more pass scores them.
    """
    mine = frames.filter(F.col("fold").isin([*folds, final]))
    gs = linear.grams(mine.filter("role = 'train'"), ["fold"], "z", label)
    fits, spread = {}, []
    for name, at in subsets.items():
        for (fold,), g in gs.items():
            part = g.subset(at)
            for spec in specs:
                for p in spec.points():
                    w = spec.solve(p, part)
                    fits[(fold,), f"{name}|{spec.name}|{p}"] = linear.solved(part, w, at, len(g.mean) - 1)
                    if fold == final:  # variance of the fit on its rows, from the same sums
                        spread.append((name, spec.name, str(p), len(at), int(np.sqrt(max(w @ part.pairs[:-1, :-1] @ w, 0.0) / part.n) < mt.DEGENERATE_STD)))
    pred = linear.scores(mine.filter("role = 'test'"), fits, [*keys, "y"])
    part = F.split("which", r"\|", 3)
    named = pred.select("fold", "y", "pred", *[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(("feature_set", "model", "point"))])
    by = ["feature_set", "model", "point"]
    s = spearman(materialize(named, "ablation_predictions"), [*by, "fold"], "pred", "y")
    per = s.groupBy(*by).agg(F.avg(F.when(F.col("fold") != final, F.col("spearman"))).alias("cv_spearman"), F.max(F.when(F.col("fold") == final, F.col("spearman"))).alias("test_spearman"))
    flags = frames.sparkSession.createDataFrame(spread, "feature_set string, model string, point string, n_features int, degenerate int")
    return _best_of_sets(per.join(flags, by))


def _best_of_sets(points: DataFrame) -> DataFrame:
    best = points.groupBy("feature_set", "model").agg(F.min(F.struct((-F.col("cv_spearman")).alias("_m"), "point", "cv_spearman", "test_spearman", "n_features", "degenerate")).alias("b"))
    return best.select("feature_set", "model", "b.point", "b.cv_spearman", "b.test_spearman", "b.n_features", "b.degenerate")


def ablation(
    specs: Sequence[Spec], frames: DataFrame, subsets: Mapping[str, Sequence[int]], folds: Sequence[int], final: int, keys: Sequence[str], label: str = "y_fit"
) -> DataFrame:
    """``linear_ablation`` for a whole roster: other models are fitted on the arrays of each feature set."""
    straight, others = [x for x in specs if x.solve is not None], [x for x in specs if x.solve is None]
    parts = [linear_ablation(straight, frames, subsets, folds, final, keys, label)] if straight else []
    mine = frames.filter(F.col("fold").isin([*folds, final]))
    for name, at in subsets.items() if others else ():
        def pick(c: str, at: Sequence[int] = tuple(at)) -> Column:
            return F.array(*[F.get(c, F.lit(i)) for i in at]).alias(c)

        sub = materialize(mine.select(*[pick(c) if c in ("x", "z") else c for c in mine.columns]), "ablation_rows")
        train, test = sub.filter("role = 'train'"), sub.filter("role = 'test'")
        by = ["model", "point"]
        for spec in others:
            fits = fit_groups(spec, train, "fold", label)
            pred = materialize(predictions(fits, test, [*keys, "y"]), "ablation_predictions")
            s = spearman(pred, [*by, "fold"], "pred", "y")
            per = s.groupBy(*by).agg(F.avg(F.when(F.col("fold") != final, F.col("spearman"))).alias("cv_spearman"), F.max(F.when(F.col("fold") == final, F.col("spearman"))).alias("test_spearman"))
            own = predictions({f: m for f, m in fits.items() if f[0] == final}, train.filter(F.col("fold") == final), keys)
            flat = own.groupBy(*by).agg((F.stddev_pop("pred") < mt.DEGENERATE_STD).cast("int").alias("degenerate"))
            parts.append(_best_of_sets(per.join(flat, by).withColumns({"feature_set": F.lit(name), "n_features": F.lit(len(at))})))
    return _union(parts)


def grid_predictions(specs: Sequence[Spec], frames: DataFrame, folds: Sequence[int], keys: Sequence[str], label: str = "y_fit", both_sides: bool = False, y: str = "y") -> DataFrame:
    """Predictions of every (model, grid point, fold): columns model, point, fold, role, pred."""
    mine = frames.filter(F.col("fold").isin(list(folds)))
    train, rows = mine.filter("role = 'train'"), mine if both_sides else mine.filter("role = 'test'")
    keep = [*keys, "role", y]
    got = at_once([partial(fit_predict, spec, train, rows, keep, "fold", label) for spec in specs])
    return materialize(_union(got), "grid_predictions")


def grid_search(specs: Sequence[Spec], frames: DataFrame, folds: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Mean and std of the fold Spearman per grid point; ``is_best`` marks each model's best."""
    from pyspark.sql import Window

    pred = grid_predictions(specs, frames, folds, keys)
    s = spearman(pred, ["model", "point", "fold"], "pred", "y")
    g = s.groupBy("model", "point").agg(F.avg("spearman").alias("cv_mean"), F.stddev_pop("spearman").alias("cv_std"))
    w = Window.partitionBy("model").orderBy(F.col("cv_mean").desc(), "point")  # a grid's points
    return g.withColumn("is_best", F.row_number().over(w) == 1)


def train_vs_validation(specs: Sequence[Spec], frames: DataFrame, folds: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Per model: mean fold RMSE and Spearman on both sides and the gaps."""
    pred = grid_predictions(specs, frames, folds, keys, both_sides=True)
    by = ["model", "fold", "role"]
    per = mt.rmse(pred, "pred", "y", by).join(spearman(pred, by, "pred", "y").select(*by, "spearman"), by)
    tr, va = F.col("role") == "train", F.col("role") == "test"
    out = per.groupBy("model").agg(
        F.avg(F.when(tr, F.col("rmse"))).alias("train_rmse"), F.avg(F.when(va, F.col("rmse"))).alias("val_rmse"),
        F.avg(F.when(tr, F.col("spearman"))).alias("train_spearman"), F.avg(F.when(va, F.col("spearman"))).alias("val_spearman"),
        F.stddev_pop(F.when(va, F.col("spearman"))).alias("val_spearman_std"),
    )
    return out.withColumns(
        {"rmse_gap": F.col("train_rmse") - F.col("val_rmse"), "spearman_gap": F.col("train_spearman") - F.col("val_spearman")}
    )


def ensemble_predictions(members: Sequence[Fitted], rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean prediction of fitted members, one pass over the rows."""
    out = rows
    for i, m in enumerate(members):
        out = m.predict(out, f"pred_{i}")
    mean = sum((F.col(f"pred_{i}") for i in range(1, len(members))), F.col("pred_0")) / len(members)
    return out.select(*keys, *[F.col(f"pred_{i}").alias(f"pred_{m.spec.name}") for i, m in enumerate(members)], mean.alias("pred"))


def final_ranking(pred: DataFrame, trained: DataFrame, meta: DataFrame, entity: str = "entity", home: str = "primary") -> DataFrame:
    """Dense order 1..n of the latest rows with the provenance flags."""
    known = trained.select(entity).distinct().withColumn("_in", F.lit(1))
    j = pred.join(meta, entity).join(known, entity, "left")
    neg = j.withColumn("_neg", -F.col("pred"))
    pos = order_positions(neg, [], ["_neg", entity], "_pos")
    return pos.select(
        *pred.columns, "source", (F.col("source") != home).cast("int").alias("out_of_training_dist"),
        F.col("_in").isNull().cast("int").alias("prediction_only"), (F.col("_pos") + 1).alias("rank"),
    )


def curve_sizes(n: int, points: int = 8, val_frac: float = 0.2, gap: int = mt.FOLD_GAP, min_rows: int = 60) -> tuple[list[int], int]:
    """Sizes of the growing prefixes of a time line of ``n`` rows, and where the fixed last slice starts."""
    n_val = int(n * val_frac)
    pool = n - n_val - gap
    return [k for frac in np.linspace(0.15, 1.0, points) for k in [int(pool * frac)] if k >= min_rows], n - n_val


def learning_curve(choices: Sequence[tuple[Spec, Mapping]], frames: DataFrame, sizes: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Error and rank correlation of each model on the prefix it was trained on and on the fixed last slice.

    ``frames`` are prepared rows with fold (number of the size) and role: train the prefix, test the slice.
    """
    pred = grid_predictions([at_point(spec, params) for spec, params in choices], frames, range(len(sizes)), keys, both_sides=True)
    by = ["model", "fold", "role"]
    got = mt.rmse(pred, "pred", "y", by).join(spearman(pred, by, "pred", "y").select(*by, "spearman"), by)
    return got.withColumn("n_train", F.array(*[F.lit(k) for k in sizes])[F.col("fold")]).drop("fold")


def permutation_importance(fits: Mapping[int, Fitted], frames: DataFrame, names: Sequence[str], keys: Sequence[str], by: Sequence[str], repeats: int = 5) -> DataFrame:
    """Mean drop in fold Spearman when one feature is shuffled inside a validation fold.

    A repeat pairs every row with a donor row: the row at position p in key order takes the
    value of the row at position p in the order of a seeded hash. Both orders are computed
    with bucketed positions, so no fold is sorted in one task. A pair of row and donor is read once
    and scored for all features; only its predictions leave the task. Models must score arrays.
    """
    models = {f: m.model for f, m in fits.items()}
    arr = next(iter(fits.values())).spec.source
    test = frames.filter(F.col("role") == "test").filter(F.col("fold").isin(list(fits)))
    own = materialize(order_positions(test, ["fold"], list(by), "_p").drop("_p_n"), "fold_positions")
    again = test.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    mixed = again.withColumn("_h", F.xxhash64(F.col("repeat") + SEED, *keys))
    donor = order_positions(mixed, ["fold", "repeat"], ["_h", *by], "_p").select("fold", "repeat", "_p", F.col(arr).alias("_other"))
    pairs = own.join(donor, ["fold", "_p"]).select("fold", "repeat", F.col("y").cast("double").alias("y"), F.col(arr).alias("_own"), "_other")

    def swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fold, part in b.groupby("fold"):
                x, other = np.stack(part["_own"].to_numpy()), np.stack(part["_other"].to_numpy())
                slim, m = part[["fold", "repeat", "y"]], models[fold]
                yield slim.assign(_j=-1, pred=m.array(x))  # as it is
                for j in range(len(names)):
                    held = x[:, j].copy()
                    x[:, j] = other[:, j]
                    yield slim.assign(_j=j, pred=m.array(x))
                    x[:, j] = held

    pred = materialize(pairs.mapInPandas(swapped, "fold int, repeat int, y double, _j int, pred double"), "permuted_predictions")
    s = spearman(pred, ["fold", "_j", "repeat"], "pred", "y").select("fold", "_j", "repeat", "spearman")
    base = s.filter("_j = -1").select("fold", "repeat", F.col("spearman").alias("base"))
    name = F.array(*[F.lit(x) for x in names])
    drop = s.filter("_j >= 0").join(base, ["fold", "repeat"]).groupBy("_j").agg(F.avg(F.col("base") - F.col("spearman")).alias("importance"))
    return drop.select(F.get(name, F.col("_j")).alias("feature"), "importance")
