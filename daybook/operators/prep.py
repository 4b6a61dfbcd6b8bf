"""Fold-fitted preprocessing: clip, median impute, standardise.

Bounds, medians, means and deviations are fitted on training rows only, for all folds in one
pass each, and come back as a few scalars per (fold, feature). Applying them is a projection
over feature arrays joined to one parameter row per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.column_quantiles import clipped_sums, column_order_stats
from daybook.functions.exprs import clip
from daybook.functions.ranking import quantiles
from daybook.operators.table import RATIO_TAILS

# fixed values: level features fed to the models
MODEL_KPIS = [
    "gross_margin", "operating_margin", "return_on_assets", "return_on_equity",
    "revenue_growth_yoy", "operating_income_growth_yoy", "net_income_growth_yoy",
    "operating_cash_flow_growth_yoy", "operating_cash_flow_margin", "cash_conversion",
    "debt_to_assets", "cash_to_assets", "equity_ratio", "asset_turnover",
    "capex_intensity", "r_and_d_intensity", "ROIC",
]
MODEL_SCORES = [
    "profitability_score", "growth_score", "cash_flow_score", "leverage_score", "efficiency_score", "investment_score",
]
LEVELS = [*MODEL_SCORES, "text_score", *MODEL_KPIS]


def feature_names(levels: Sequence[str] = LEVELS) -> list[str]:
    return [*levels, *[f"{c}_change" for c in levels]]


def clipped_names(levels: Sequence[str] = LEVELS) -> list[str]:
    return [*[c for c in levels if c in RATIO_TAILS], *[f"{c}_change" for c in levels]]


def build_features(df: DataFrame, keep: Sequence[str], levels: Sequence[str] = LEVELS) -> DataFrame:
    """Level columns (ratio tails from their raw version) and their changes."""
    cols = [F.col(f"{c}_raw" if c in RATIO_TAILS else c).cast("double").alias(c) for c in levels]
    return df.select(*keep, *cols, *[F.col(f"{c}_change").cast("double").alias(f"{c}_change") for c in levels])


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.unpivot(list(by), list(cols), "feature", "v")


def fit_bounds(train: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    return quantiles(_long(train, cols, by), [*by, "feature"], "v", {"lo": lo, "hi": hi})


class FoldWinsorizer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Clip columns at percentiles of the fitted rows; NULL passes through."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FoldWinsorizerModel:
        cols = self.getInputCols()
        got = {r.feature: r for r in fit_bounds(dataset, cols).collect()}  # one row per column
        lo = [got[c].lo if c in got else float("-inf") for c in cols]
        hi = [got[c].hi if c in got else float("inf") for c in cols]
        return FoldWinsorizerModel(inputCols=cols, lower=lo, upper=hi)


class FoldWinsorizerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    lower = Param(Params._dummy(), "lower", "lower bounds", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "upper bounds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, lower: list[float] | None = None, upper: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lo, hi = self.getOrDefault("lower"), self.getOrDefault("upper")
        return dataset.withColumns(
            {c: clip(c, F.lit(a), F.lit(b)) for c, a, b in zip(self.getInputCols(), lo, hi)}
        )


class TargetWinsorizer(FoldWinsorizer):
    """The same clip on the label, for fitting only; predictions stay on the raw scale."""


def clip_target(df: DataFrame, train: DataFrame, y: str, out: str = "y_fit") -> DataFrame:
    copy = df.withColumn(out, F.col(y))
    return TargetWinsorizer(inputCols=[out]).fit(train.withColumn(out, F.col(y))).transform(copy)


def fit_frame(train: DataFrame, features: Sequence[str], clipped: Sequence[str], by: Sequence[str] = (), y: str | None = None) -> DataFrame:
    """One row per fold with arrays lo, hi, med, mean, sd in feature order (and label bounds)."""
    by, inf = list(by), float("inf")
    cols = [*features, *([y] if y else [])]
    stats = column_order_stats(train, by, cols, [0.01, 0.5, 0.99])  # folds x features scalars
    edged = {i for i, c in enumerate(cols) if c in clipped or i == len(features)}
    keys = sorted({key for key, i in stats if i in edged})

    def between(n: int, a: float, b: float, p: float) -> float:
        return float(a + (b - a) * (p * (n - 1) - np.floor(p * (n - 1))))

    lo, hi, med = {}, {}, {}
    for key in keys:
        own = [stats.get((key, i)) for i in range(len(cols))]
        lo[key] = [between(*own[i][0], 0.01) if own[i] and i in edged else -inf for i in range(len(cols))]
        hi[key] = [between(*own[i][2], 0.99) if own[i] and i in edged else inf for i in range(len(cols))]
        # a clipped column has its order statistics clipped
        mid = [(o[1][0], *np.fmin(np.maximum(o[1][1:], a), b)) if o else (1, 0.0, 0.0) for o, a, b in zip(own, lo[key], hi[key])]
        med[key] = [between(*x, 0.5) for x in mid]
    k, out = len(features), []
    # a missing value becomes the median, so it adds nothing to sums of differences from it
    for key, (n, s, ss) in clipped_sums(train, by, list(features), lo, hi, med).items():
        var = ss / n - (s / n) ** 2
        sd = np.where(var <= 1e-18, 1.0, np.sqrt(np.maximum(var, 0.0)))
        ys = (lo[key][k], hi[key][k]) if y else (-inf, inf)
        out.append((*key, lo[key][:k], hi[key][:k], *ys, med[key][:k], (np.array(med[key][:k]) + s / n).tolist(), sd.tolist()))
    return train.sparkSession.createDataFrame(
        out,
        "".join(f"{b} int, " for b in by) + "lo array<double>, hi array<double>, y_lo double, y_hi double, med array<double>, mean array<double>, sd array<double>",
    )


def _join_params(df: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    # params: one row per fold
    return df.join(F.broadcast(params), list(by)) if by else df.crossJoin(F.broadcast(params))


def apply_frame(df: DataFrame, params: DataFrame, features: Sequence[str], by: Sequence[str] = (), y: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``x`` (clipped, imputed) and ``z`` (also standardised) arrays, and ``y_fit``."""
    j = _join_params(df, params, by)
    raw = F.array(*[F.col(f) for f in features])

    def impute(v: Column, i: Column) -> Column:
        return F.coalesce(clip(v, F.col("lo")[i], F.col("hi")[i]), F.col("med")[i])

    x = j.withColumn("x", F.transform(raw, impute))
    z = x.withColumn("z", F.transform("x", lambda v, i: (v - F.col("mean")[i]) / F.col("sd")[i]))
    ys = [F.col(y).alias("y"), clip(y, "y_lo", "y_hi").alias("y_fit")] if y else []
    return z.select(*keep, *by, *ys, "x", "z")
