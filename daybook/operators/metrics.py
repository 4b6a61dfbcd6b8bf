"""Splits, folds and rank evaluation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.ranking import order_positions, quantiles, running_counts, spearman, value_counts

# fixed values
N_FOLDS = 5
FOLD_GAP = 21
MIN_PERIOD_ROWS = 8
MIN_TERCILE_ROWS = 9
DEGENERATE_STD = 1e-6


def time_split(df: DataFrame, at: str, split: Column) -> DataFrame:
    """Training and validation up to the split date, test after it."""
    return df.withColumn("role", F.when(F.col(at) <= split, "train_val").otherwise("test"))


def time_folds(df: DataFrame, at: str, tie: Sequence[str], n: int = N_FOLDS, gap: int = FOLD_GAP) -> DataFrame:
    """(row, fold, role): consecutive test blocks at the end of the time line, training rows
    are all earlier ones minus ``gap``. Positions are exact without sorting in one task."""
    at_day = df.withColumn("_day", F.unix_date(at))
    pos = order_positions(at_day, [], ["_day", *tie], "_pos")
    size = F.floor(F.col("_pos_n") / (n + 1))
    def start(i: Column) -> Column:
        return F.col("_pos_n") - n * size + i * size
    def role(i: Column) -> Column:
        s = start(i)
        return F.when(F.col("_pos") < s - gap, "train").when((F.col("_pos") >= s) & (F.col("_pos") < s + size), "test")
    folds = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("fold"), role(i).alias("role"))),
        lambda x: x["role"].isNotNull(),
    )
    return pos.select(*df.columns, F.explode(folds).alias("_x")).select(*df.columns, "_x.fold", "_x.role")


def fold_scores(folds: DataFrame, pred: str, y: str, model: str = "model") -> DataFrame:
    """Spearman per (model, fold) on the test blocks."""
    return spearman(folds.filter("role = 'test'"), [model, "fold"], pred, y).select(model, "fold", "spearman")


def degenerate(df: DataFrame, pred: str, model: str = "model") -> DataFrame:
    sd = F.stddev_pop(pred)
    return df.groupBy(model).agg(sd.alias("insample_pred_std"), (sd < DEGENERATE_STD).cast("int").alias("degenerate"))


def cv_table(folds: DataFrame, insample: DataFrame, pred: str, y: str, model: str = "model") -> DataFrame:
    """Mean and population std of the fold scores with the degeneracy flag, one row per model."""
    s = fold_scores(folds, pred, y, model).groupBy(model).agg(
        F.avg("spearman").alias("cv_mean"), F.stddev_pop("spearman").alias("cv_std")
    )
    return s.join(degenerate(insample, pred, model), model)


def best_models(cv: DataFrame, k: int = 3, model: str = "model") -> DataFrame:
    """The k best non-degenerate models (a handful of rows)."""
    return cv.filter("degenerate = 0").orderBy(F.col("cv_mean").desc(), model).limit(k).select(model)


def ensemble(predictions: DataFrame, members: DataFrame, keys: Sequence[str], pred: str = "pred", model: str = "model") -> DataFrame:
    """Unweighted mean of the member predictions per row."""
    # members: at most the roster of models
    return predictions.join(F.broadcast(members), model).groupBy(*keys).agg(F.avg(pred).alias("pred"))


def per_period_spearman(df: DataFrame, pred: str, y: str, by: Sequence[str] = ("model",), period: str = "period", min_n: int = MIN_PERIOD_ROWS) -> DataFrame:
    s = spearman(df, [*by, period], pred, y).filter(F.col("n") >= min_n)
    return s.groupBy(*by).agg(F.avg("spearman").alias("spearman_mean"), F.count(F.lit(1)).alias("n_periods"))


def decile_spread(df: DataFrame, pred: str, y: str, entity: str = "entity", at: Sequence[str] = ("rd",), by: Sequence[str] = (), frac: float = 0.1) -> DataFrame:
    """Mean outcome of the top minus the bottom fraction over each entity's latest row."""
    one = df.select(*by, entity, *at, pred, y)
    rest = [pred, y]
    latest = one.groupBy(*by, entity).agg(F.max(F.struct(*at, *rest)).alias("_m")).select(
        *by, entity, F.col(f"_m.{pred}").alias(pred), F.col(f"_m.{y}").alias(y)
    )
    pos = order_positions(latest, list(by), [pred, entity], "_pos")
    k = F.greatest(F.lit(1), F.bround(F.col("_pos_n") * F.lit(frac), 0).cast("long"))
    top, bottom = F.col("_pos") >= F.col("_pos_n") - k, F.col("_pos") < k
    out = pos.groupBy(*by).agg(
        F.avg(F.when(top, F.col(y))).alias("top_mean"), F.avg(F.when(bottom, F.col(y))).alias("bottom_mean"),
        F.max(k).alias("k"), F.count(F.lit(1)).alias("n_entities"),
    )
    return out.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))


def fixed_spread(df: DataFrame, pred: str, y: str, by: Sequence[str] = ("model",), period: str = "period", k: int = 10, tie: str = "entity") -> DataFrame:
    """Top-k minus bottom-k mean outcome per period, averaged; short periods are skipped.

    Both ranks carry a constant limit, so map tasks keep at most k rows per group.
    """
    g = [*by, period]
    enough = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * k)
    up = Window.partitionBy(*g).orderBy(F.col(pred), F.col(tie))
    down = Window.partitionBy(*g).orderBy(F.col(pred).desc(), F.col(tie).desc())
    def leg(w, name):
        r = df.select(*g, pred, tie, y).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return r.groupBy(*g).agg(F.avg(y).alias(name))
    s = enough.join(leg(down, "_top"), g).join(leg(up, "_bot"), g)
    return s.groupBy(*by).agg(F.avg(F.col("_top") - F.col("_bot")).alias("spread_mean"), F.count(F.lit(1)).alias("n_periods"))


def rmse(df: DataFrame, pred: str, y: str, by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(pred), 2))).alias("rmse"))


def rank_consensus(importances: DataFrame, value: str = "importance", model: str = "model", feature: str = "feature") -> DataFrame:
    """Average over models of the descending rank (ties averaged) of each feature."""
    down = importances.withColumn("_v", -F.abs(value))
    rc = running_counts(value_counts(down, [model], "_v"), [model], "_v")
    r = rc.select(model, "_v", (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("_rank"))
    return down.join(r, [model, "_v"]).groupBy(feature).agg(F.avg("_rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_models"))


def _tercile(y: Column, lo: Column, hi: Column) -> Column:
    return F.when(y >= hi, 1).when(y <= lo, 0)


def tercile_label(df: DataFrame, train: DataFrame, y: str) -> DataFrame:
    """1 for the top third, 0 for the bottom third; bounds from the training rows only."""
    b = quantiles(train, [], y, {"_lo": 1 / 3, "_hi": 2 / 3})  # one row
    return df.crossJoin(F.broadcast(b)).withColumn("label", _tercile(F.col(y), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def within_period_tercile(df: DataFrame, y: str, by: Sequence[str], min_n: int = MIN_TERCILE_ROWS) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n)
    b = quantiles(df, list(by), y, {"_lo": 1 / 3, "_hi": 2 / 3}).join(n, list(by))
    return df.join(b, list(by), "left").withColumn("label", _tercile(F.col(y), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_n")


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    pos, neg = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    return running_counts(
        value_counts(df, by, score, {"pos": pos, "neg": neg}), by, score, ("n", "pos", "neg")
    )


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with averaged ties, from the counts per distinct score."""
    rc = _score_counts(df, label, score, by)
    rank = F.col("below_n") + (F.col("n") + 1) / 2.0
    g = rc.groupBy(*by).agg(
        F.sum(F.col("pos") * rank).alias("_s"), F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg")
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return g.select(*by, "n_pos", "n_neg", ((F.col("_s") - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rates of rows at or above every distinct score."""
    rc = _score_counts(df, label, score, by)
    def rate(k: str) -> Column:
        total = F.col(f"total_{k}").cast("double")
        return (total - F.col(f"below_{k}")) / F.nullif(total, F.lit(0.0))
    return rc.select(*by, F.col(score).alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    n = df.groupBy(*by).agg(
        F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(hit & real).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    def part(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    recall, precision = part(tp, tp + fn), part(tp, tp + fp)
    base = part(tp + fn, total)
    return n.select(
        *by, "tn", "fp", "fn", "tp", part(tp + tn, total).alias("accuracy"),
        ((recall + part(tn, tn + fp)) / 2).alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        part(2 * precision * recall, precision + recall).alias("f1"), F.greatest(base, 1 - base).alias("majority_baseline"),
    )


def select_model(cv: DataFrame, model: str = "model") -> DataFrame:
    """Best CV score among the non-degenerate models, first name on ties."""
    best = cv.filter("degenerate = 0").agg(F.min(F.struct((-F.col("cv_mean")).alias("neg"), model)).alias("m"))
    return best.select(F.col(f"m.{model}").alias(model), (-F.col("m.neg")).alias("cv_mean"))


def model_table(cv: DataFrame, test: DataFrame, model: str = "model") -> DataFrame:
    """Full outer merge of CV and test metrics, ensemble rows first."""
    out = cv.join(test, model, "full_outer")
    return out.withColumn("row_order", F.when(F.lower(model).startswith("ensemble"), 0).otherwise(1)).orderBy("row_order", model)
