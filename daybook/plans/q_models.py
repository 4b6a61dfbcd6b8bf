"""Model queries (MLlib part of L, and B2)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.functions.ranking import order_positions, quantiles, spearman
from daybook.operators import backtest as bt
from daybook.operators import artefacts, kpi, models, prep
from daybook.operators import metrics as mt
from daybook.plans import stages as st
from daybook.plans.q_learn import CLIPPED, NAMES, split_date
from daybook.plans.q_stats import eligible
from daybook.plans.q_table import KEYS
from daybook.plans.registry import query
from daybook.session import materialize, ready, stage, stage_folder

CV = list(range(mt.N_FOLDS))
FINAL, ALL = 5, 6  # fold numbers of train+val -> test and all eligible -> latest rows
BEST = 3  # members of the ensemble


def role_rows(s, d):
    """Eligible rows repeated per (fold, role): CV folds, the final split and the ranking set."""
    cols = [*KEYS, "period", "sharpe_raw"]
    el = prep.build_features(eligible(s, d), cols)
    tv = el.filter(F.col("report_date") <= split_date())
    keep = [c for c in el.columns]
    cv = mt.time_folds(tv, "report_date", ["entity"]).select(*keep, "fold", "role")
    final = el.select(*keep, F.lit(FINAL).alias("fold"), F.when(F.col("report_date") <= split_date(), "train").otherwise("test").alias("role"))
    everything = el.select(*keep, F.lit(ALL).alias("fold"), F.lit("train").alias("role"))
    newest = kpi.latest_report(st.modelling(s, d))
    rank = prep.build_features(newest, cols).select(*keep, F.lit(ALL).alias("fold"), F.lit("test").alias("role"))
    return cv.unionByName(final).unionByName(everything).unionByName(rank)


def _frames(s, d, names, clipped):
    rows = materialize(role_rows(s, d), "role_rows")  # each of the passes below reads them
    params = prep.fit_frame(rows.filter("role = 'train'"), names, clipped, by=["fold"], y="sharpe_raw")
    return prep.apply_frame(rows, params, names, by=["fold"], y="sharpe_raw", keep=[*KEYS, "period", "role"])


def frames(s, d):
    return stage(s, d, "model_frames", lambda: _frames(s, d, NAMES, CLIPPED), by=["fold", "role"])


def side(s, d, fold, role):
    return frames(s, d).filter((F.col("fold") == fold) & (F.col("role") == role))


ROSTER = models.roster()


def grid(s, d, names=tuple(ROSTER)) -> DataFrame:
    """Fold scores of every grid point of these models; everything that needs tuned models starts here."""
    left = [n for n in names if not ready(s, d, f"grid_search_{n}")]
    got = materialize(models.grid_search([ROSTER[n] for n in left], frames(s, d), CV, KEYS), "grid_search") if left else None
    return models._union([stage(s, d, f"grid_search_{n}", lambda n=n: got.filter(F.col("model") == n).coalesce(1)) for n in names])  # a model's points


def best_points(s, d, names=tuple(ROSTER)) -> dict[str, dict]:
    best = {r.model: r.point for r in grid(s, d, names).filter("is_best").collect()}  # one row per model
    return {n: next(p for p in ROSTER[n].points() if str(p) == best[n]) for n in names}


@query("l9_grid_search")
def l9(s, d):
    return grid(s, d).select("model", "point", F.round("cv_mean", 4).alias("cv_mean"), F.round("cv_std", 4).alias("cv_std"), "is_best")


def _coefficients(name, params):
    def run(s, d):
        m = models.fit(ROSTER[name], params, side(s, d, FINAL, "train"))
        return m.importance(NAMES).select("model", "feature", r6("coefficient").alias("coefficient"))
    return run


query("l10_ridge")(_coefficients("Ridge", {"alpha": 100}))
query("l11_lasso")(_coefficients("Lasso", {"alpha": 0.01}))
query("l12_elastic_net")(_coefficients("ElasticNet", {"alpha": 0.01, "l1_ratio": 0.5}))


def _test_predictions(name, params):
    def run(s, d):
        def build():
            m = models.fit(ROSTER[name], params, side(s, d, FINAL, "train"))
            return m.predict(side(s, d, FINAL, "test")).select(*KEYS, "pred")
        return stage(s, d, f"test_predictions_{name}", build).select(*KEYS, r6("pred").alias("pred"))
    return run


l13 = query("l13_random_forest")(_test_predictions("RandomForest", {"max_depth": 5, "min_leaf": 20, "features": "sqrt"}))
l14 = query("l14_boosted_trees")(_test_predictions("BoostedTrees", {"max_depth": 2, "learning_rate": 0.05, "reg_lambda": 1}))
query("l15_kernel_svr")(_test_predictions("KernelSVR", {"C": 1}))


def tuned(s, d) -> str:
    """Folder with the tuned models, refitted on train+val, and the preparation of that split."""
    def build(path):
        train = side(s, d, FINAL, "train")
        fits = models.at_once([partial(models.fit, ROSTER[n], p, train) for n, p in best_points(s, d).items()])
        base = prep.build_features(eligible(s, d), [*KEYS, "sharpe_raw"]).filter(F.col("report_date") <= split_date())
        artefacts.save(s, path, fits, prep.fit_frame(base, NAMES, CLIPPED, y="sharpe_raw"))
    return stage_folder(s, d, "tuned_models", build)


def selected(s, d) -> DataFrame:
    """One row per model: scores of its best point, the constant-model flag, test scores, and whether it is a member."""
    def build():
        frozen = artefacts.load(s, tuned(s, d), ROSTER)
        both = models.long_predictions(frozen.members, frames(s, d).filter(F.col("fold") == FINAL), [*KEYS, "period", "role", "y"])
        flags = mt.degenerate(both.filter("role = 'train'"), "pred")
        test = both.filter("role = 'test'")
        scores = spearman(test, ["model"], "pred", "y").select("model", F.col("spearman").alias("test_spearman"))
        cv = grid(s, d).filter("is_best").select("model", "point", "cv_mean", "cv_std").join(flags, "model")
        member = mt.best_models(cv, BEST).withColumn("member", F.lit(True))
        return cv.join(scores, "model").join(mt.rmse(test, "pred", "y"), "model").join(member, "model", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return stage(s, d, "selected_models", build)


def members(s, d) -> list[str]:
    return [r.model for r in selected(s, d).filter("member").orderBy(F.col("cv_mean").desc(), "model").collect()]  # three


@query("l17_selected_models")
def l17s(s, d):
    """Search, refit, flags, best three and one-shot test scores."""
    got = selected(s, d)
    return got.select("model", "point", *[F.round(c, 4).alias(c) for c in ("cv_mean", "cv_std", "insample_pred_std", "test_spearman", "rmse")], "degenerate", "member")


@query("l17_test_ensemble")
def l17t(s, d):
    """The selected members and their mean on the test rows."""
    frozen = artefacts.load(s, tuned(s, d), ROSTER, members(s, d))
    rows = prep.build_features(eligible(s, d), [*KEYS, "sharpe_raw"]).filter(F.col("report_date") > split_date())
    out = frozen.predict(rows, NAMES, KEYS)
    return out.select(*KEYS, r6("pred").alias("pred"))


@query("l22_importances")
def l22(s, d):
    """Weights of the tuned models that have one per feature."""
    fits = [f for f in artefacts.load(s, tuned(s, d), ROSTER).members if f.spec.name != "KernelSVR"]
    return models._union([f.importance(NAMES) for f in fits]).select("model", "feature", r6("importance").alias("importance"))


@query("l23_final_ranking")
def l23(s, d):
    """The members, refitted on all eligible rows, rank each entity's latest row."""
    train, rows = side(s, d, ALL, "train"), side(s, d, ALL, "test")

    def build():
        best = best_points(s, d)
        fits = models.at_once([partial(models.fit, ROSTER[n], best[n], train) for n in members(s, d)])
        return models.ensemble_predictions(fits, rows, ["entity", "report_date"])

    pred = stage(s, d, "latest_predictions", build)
    meta = st.modelling(s, d).groupBy("entity").agg(F.max("source").alias("source"))
    out = models.final_ranking(pred, train, meta)
    return out.select("entity", "report_date", r6("pred").alias("pred"), "out_of_training_dist", "prediction_only", "rank")


SETS = {"subscores_only": prep.MODEL_SCORES, "kpis_only": prep.MODEL_KPIS, "full": prep.LEVELS}
ABLATED = ["Ridge", "Lasso", "ElasticNet"]  # with KernelSVR it takes two minutes at sf0.01


@query("l24_ablation")
def l24(s, d):
    """Per feature set and model: best fold Spearman, test Spearman of that point, and the constant-model flag."""
    # preparation is per feature, so a subset of the prepared arrays is the same fit
    subsets = {name: [NAMES.index(f) for f in prep.feature_names(levels)] for name, levels in SETS.items()}
    out = models.ablation([ROSTER[n] for n in ABLATED], frames(s, d), subsets, CV, FINAL, KEYS)
    return out.select("feature_set", "n_features", "model", *[F.round(c, 4).alias(c) for c in ("cv_spearman", "test_spearman")], "degenerate")


@query("l25_train_vs_validation")
def l25(s, d):
    def build():
        specs = [models.at_point(ROSTER[n], p) for n, p in best_points(s, d).items()]
        return models.train_vs_validation(specs, frames(s, d), CV, KEYS)

    out = stage(s, d, "train_vs_validation", build)
    return out.select("model", *[F.round(c, 4).alias(c) for c in out.columns if c != "model"])


CURVE = ["Ridge", "RandomForest", "BoostedTrees"]


def time_line(s, d):
    el = prep.build_features(eligible(s, d), [*KEYS, "sharpe_raw"]).filter(F.col("report_date") <= split_date())
    return stage(
        s, d, "time_line",
        lambda: order_positions(el.withColumn("_day", F.unix_date("report_date")), [], ["_day", "entity"], "pos").drop("_day"),
    )


def curve_frames(s, d) -> tuple[DataFrame, list[int]]:
    """Prefixes of the time line and its fixed last slice, each prefix prepared by its own rows: fold is the prefix."""
    lined = time_line(s, d)
    n = lined.agg(F.max("pos_n")).first()[0]
    sizes, start = models.curve_sizes(n)

    def build():
        k = F.array(*[F.lit(x) for x in sizes])
        each = lined.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))))
        role = F.when(F.col("pos") < F.get(k, F.col("fold")), "train").when(F.col("pos") >= start, "test")
        rows = each.withColumn("role", role).filter("role is not null")
        params = prep.fit_frame(rows.filter("role = 'train'"), NAMES, CLIPPED, by=["fold"], y="sharpe_raw")
        return prep.apply_frame(rows, params, NAMES, by=["fold"], y="sharpe_raw", keep=[*KEYS, "role"])

    return stage(s, d, "curve_frames", build, by=["fold", "role"]), sizes


@query("l26_learning_curve")
def l26(s, d):
    def build():
        rows, sizes = curve_frames(s, d)
        best = best_points(s, d, CURVE)
        return models.learning_curve([(ROSTER[n], best[n]) for n in CURVE], rows, sizes, KEYS)

    out = stage(s, d, "learning_curve", build)
    return out.select("model", "n_train", "role", F.round("rmse", 4).alias("rmse"), F.round("spearman", 4).alias("spearman"))


@query("l27_permutation_importance")
def l27(s, d):
    f = frames(s, d).withColumn("_day", F.unix_date("report_date"))
    one = models.at_point(ROSTER["KernelSVR"], best_points(s, d, ["KernelSVR"])["KernelSVR"])
    fits = {g: m for (g, _), m in models.fit_groups(one, f.filter("role = 'train'").filter(F.col("fold").isin(CV))).items()}
    out = models.permutation_importance(fits, f, NAMES, KEYS, ["_day", "entity"], repeats=5)
    return out.withColumn("importance", F.round("importance", 6))


CLASSIFIERS = models.classifiers()
SCHEMES = ("train_fitted", "within_period")


def labelled(s, d, scheme: str) -> DataFrame:
    """Rows of the folds and the final split with ``label``: top and bottom thirds; the middle drops out.

    train_fitted: by the bounds of the fold's own training rows. within_period: by rank within the period, train+val and test
    apart.
    """
    def build():
        rows = frames(s, d).filter(F.col("fold") <= FINAL)
        if scheme == "train_fitted":
            cut = quantiles(rows.filter("role = 'train'"), ["fold"], "y", {"_lo": 1 / 3, "_hi": 2 / 3})
            return rows.join(cut, "fold").withColumn("label", F.when(F.col("y") >= F.col("_hi"), 1).when(F.col("y") <= F.col("_lo"), 0)).drop("_lo", "_hi").filter("label is not null")
        final = rows.filter(F.col("fold") == FINAL).select(*KEYS, "period", "role", "y")
        fixed = mt.within_period_tercile(final, "y", ["role", "period"]).select(*KEYS, "label")
        return rows.join(fixed, KEYS).filter("label is not null")
    return stage(s, d, f"labelled_{scheme}", build, by=["fold", "role"])


def class_scores(s, d, scheme: str) -> DataFrame:
    """Predictions of every classifier, grid point and fold on test rows."""
    def build():
        rows = labelled(s, d, scheme)
        train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
        # a fold whose training rows have one label only can't be fitted
        both = [r[0] for r in train.groupBy("fold").agg(F.countDistinct("label").alias("n")).filter("n = 2").collect()]
        train, test = (x.filter(F.col("fold").isin(both)) for x in (train, test))
        return models._union(models.at_once([partial(models.fit_predict, spec, train, test, [*KEYS, "label"], "fold", "label") for spec in CLASSIFIERS.values()]))
    return stage(s, d, f"class_scores_{scheme}", build)


def fold_auc(s, d) -> DataFrame:
    """Per scheme, model and point: mean and std of the fold AUC."""
    parts = [class_scores(s, d, x).withColumn("scheme", F.lit(x)) for x in SCHEMES]
    by = ["scheme", "model", "point"]
    per = mt.auc(models._union(parts).filter(F.col("fold") < FINAL), "label", "pred", [*by, "fold"]).filter("auc is not null")
    return per.groupBy(*by).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count("*").alias("n_folds"))


@query("l32_fold_auc")
def l32(s, d):
    got = fold_auc(s, d)
    return got.select("scheme", "model", "point", F.round("auc_mean", 4).alias("auc_mean"), F.round("auc_std", 4).alias("auc_std"), "n_folds")


@query("l31_classifiers")
def l31(s, d):
    """Test metrics of each classifier at the point with the best fold AUC, for both label schemes."""
    best = fold_auc(s, d).groupBy("scheme", "model").agg(F.min(F.struct((-F.col("auc_mean")).alias("m"), "point")).alias("b")).select("scheme", "model", "b.point")
    test = models._union([class_scores(s, d, x).filter(F.col("fold") == FINAL).withColumn("scheme", F.lit(x)) for x in SCHEMES])
    pred = test.join(F.broadcast(best), ["scheme", "model", "point"])  # one row per scheme and classifier
    by = ["scheme", "model"]
    out = mt.auc(pred, "label", "pred", by).join(mt.classification_metrics(pred, "label", "pred", by=by), by)
    return out.select(*by, *[F.round(c, 4).alias(c) for c in out.columns if c not in by])


@query("b2_frozen_ensemble")
def b2(s, d):
    """The stored members, fitted once on train+val, applied to the backtest universe."""
    md = st.modelling(s, d)
    uni = bt.universe(md.withColumn("rd", F.col("report_date")), split_date())
    raw = prep.build_features(uni, [*KEYS, "period", "sharpe_raw"])
    out = artefacts.load(s, tuned(s, d), ROSTER, members(s, d)).predict(raw, NAMES, [*KEYS, "period"])
    return out.select(*KEYS, "period", r6("pred").alias("pred"))
