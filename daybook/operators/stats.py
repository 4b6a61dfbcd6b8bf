"""Exploratory statistics. Wide tables are reduced by map-side aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.exprs import flag
from daybook.functions.moments import corrected_kurtosis, corrected_skew, pair_correlation, pair_count, pearson
from daybook.functions.rank_pairs import rank_pair_sums
from daybook.functions.ranking import quantiles

# fixed values
MIN_PAIRS = 30
RELIABLE_N = 800
HIGH_CORR = 0.8


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.unpivot(list(keep), list(cols), "feature", "v")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, bias-corrected skew and excess kurtosis, min, median, max per column."""
    long = long_form(df, cols)
    shape = long.groupBy("feature").agg(
        F.count("v").alias("n"), corrected_skew(F.col("v")).alias("skew"),
        corrected_kurtosis(F.col("v")).alias("kurtosis"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    med = quantiles(long, ["feature"], "v", {"median": 0.5})
    return shape.join(med, "feature", "left")


def histogram(df: DataFrame, cols: Sequence[str], split: str, edges: int = 30, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Counts per (feature, bin, split) over equal bins between two quantiles."""
    long = long_form(df, cols, [split]).filter(F.col("v").isNotNull())
    bounds = quantiles(long, ["feature"], "v", {"lo": lo, "hi": hi})
    return _binned(long, bounds, edges - 1, [split])


def _binned(long: DataFrame, bounds: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    # bounds: one row per listed feature
    hit = long.join(F.broadcast(bounds), "feature").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(bins - 1))
    return hit.groupBy("feature", *by, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _raw_and_clipped(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    raw = df.select(*[F.col(f"{c}_raw").alias(c) for c in cols]).unpivot([], list(cols), "feature", "v")
    clipped = df.unpivot([], list(cols), "feature", "v")
    both = raw.withColumn("series", F.lit("raw")).unionByName(clipped.withColumn("series", F.lit("clipped")))
    return both.filter(F.col("v").isNotNull())


def raw_vs_clipped(df: DataFrame, cols: Sequence[str], bins: int = 60) -> DataFrame:
    """Both distributions of each clipped column over a padded range of the raw one."""
    long = _raw_and_clipped(df, cols)
    q = quantiles(long.filter("series = 'raw'"), ["feature"], "v", {"p1": 0.01, "p99": 0.99})
    w = F.col("p99") - F.col("p1")
    pad = F.when(w > 0, w * 1.5).otherwise(1.0)
    bounds = q.select("feature", (F.col("p1") - pad).alias("lo"), (F.col("p99") + pad).alias("hi"))
    return _binned(long, bounds, bins, ["series"])


def raw_vs_clipped_skew(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = _raw_and_clipped(df, cols)
    return long.groupBy("feature", "series").agg(F.count("v").alias("n"), corrected_skew(F.col("v")).alias("skew"))


_GRAM = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _gram_of(batches: Iterator[pd.DataFrame], complete: bool, center: np.ndarray) -> Iterator[pd.DataFrame]:
    """Pair sums of one partition; a k x k block leaves the task, however many rows it saw."""
    acc = None
    for b in batches:
        x = b.to_numpy(dtype="float64", na_value=np.nan) - center
        if complete:
            x = x[~np.isnan(x).any(axis=1)]
        m = (~np.isnan(x)).astype("float64")
        z = np.nan_to_num(x, nan=0.0)
        part = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        acc = part if acc is None else acc + part
    if acc is None:
        return
    n, sx, sxx, sxy = acc
    i, j = np.triu_indices(n.shape[0])
    yield pd.DataFrame(
        {"i": i, "j": j, "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]}
    )


def pair_sum_table(df: DataFrame, cols: Sequence[str], complete: bool = False) -> DataFrame:
    """(i, j) pair sums of all column pairs, each column less its mean, which comes from one row of means."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = wide.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in cols]).first()
    center = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    part = wide.mapInPandas(lambda it: _gram_of(it, complete, center), _GRAM)
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson, upper triangle in long form."""
    names = F.array(*[F.lit(c) for c in cols])
    return (
        pair_sum_table(df, cols)
        .filter(F.col("i") < F.col("j"))
        .select(
            names[F.col("i")].alias("feat_a"), names[F.col("j")].alias("feat_b"),
            F.col("n").cast("long").alias("n"), pearson().alias("r"),
        )
    )


def high_corr_pairs(corr: DataFrame, threshold: float = HIGH_CORR) -> DataFrame:
    return corr.filter(F.abs("r") > threshold).orderBy(F.abs("r").desc(), "feat_a", "feat_b")


def feature_target_corr(df: DataFrame, cols: Sequence[str], y: str, min_n: int = MIN_PAIRS, reliable_n: int = RELIABLE_N) -> DataFrame:
    """Pearson and Spearman of each column with ``y`` over complete pairs; a constant side gives NULL and 0."""
    at = range(len(cols))
    wide = df.filter(F.col(y).isNotNull()).select(F.col(y).alias("_y"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    pairs = wide.select("_y", F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_x{i}").alias("x")) for i in at]))).filter(F.col("x").isNotNull())
    plain = pairs.groupBy("f").agg(pair_correlation(F.col("x"), F.col("_y")).alias("pearson"))
    sums = df.sparkSession.createDataFrame(rank_pair_sums(df, y, cols), "f int, " + ", ".join(f"r_{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    n = F.col("r_n").cast("long")
    return sums.join(plain, "f").select(
        F.array(*[F.lit(c) for c in cols])[F.col("f")].alias("feature"), n.alias("n"), F.when(n >= min_n, F.col("pearson")).alias("pearson"),
        F.when(n >= min_n, F.coalesce(pearson("r_"), F.lit(0.0))).alias("spearman"), (n >= reliable_n).alias("reliable"),
    )


def vif(df: DataFrame, cols: Sequence[str], block: str) -> DataFrame:
    """Variance inflation from the k x k matrix of one pass; exact dependencies are infinite."""
    spark = df.sparkSession
    k = len(cols)
    rows = pair_sum_table(df, cols, complete=True).collect()  # k(k+1)/2 rows
    cov = np.zeros((k, k))
    n = 0.0
    for r in rows:
        n = r.n
        cov[r.i, r.j] = cov[r.j, r.i] = r.sxy - r.sx * r.sy / max(r.n, 1.0)
    out = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        tot = cov[i, i]
        if tot <= 0:
            r2 = 0.0
        else:
            sd = np.sqrt(np.clip(np.diag(cov)[others], 1e-300, None))
            a = cov[np.ix_(others, others)] / np.outer(sd, sd)
            b = cov[others, i] / sd
            # least squares on the scaled normal equations copes with rank loss
            beta = np.linalg.lstsq(a, b, rcond=1e-10)[0]
            r2 = float(min(max(beta @ b / tot, 0.0), 1.0))
        v = float("inf") if r2 >= 0.9999999 else 1.0 / (1.0 - r2)
        mark = "HIGH>10" if v > 10 else "elevated>5" if v > 5 else ""
        out.append((block, cols[i], r2, v, int(n), mark))
    return spark.createDataFrame(out, "block string, feature string, r2 double, vif double, n_rows long, flag string")


def missingness(df: DataFrame, cols: Sequence[str], cohorts: Mapping[str, Column]) -> DataFrame:
    """Percent NULL per feature for all rows and each cohort."""
    long = df.select(*cols, *[c.alias(f"_c_{k}") for k, c in cohorts.items()]).unpivot(
        [f"_c_{k}" for k in cohorts], list(cols), "feature", "v"
    )
    miss = F.col("v").isNull().cast("double") * 100
    return long.groupBy("feature").agg(
        F.avg(miss).alias("pct_missing_all"),
        *[F.avg(F.when(F.col(f"_c_{k}"), miss)).alias(f"pct_missing_{k}") for k in cohorts],
        F.sum(flag(F.col("v").isNull())).alias("n_missing_all"),
    )


def target_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = long_form(df, cols)
    base = long.groupBy("feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), corrected_skew(F.col("v")).alias("skew"),
    )
    q = quantiles(long, ["feature"], "v", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return base.join(q, "feature", "left")


def grouped_summary(df: DataFrame, by: str, y: str) -> DataFrame:
    base = df.groupBy(by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    q = quantiles(df, [by], y, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(q, by, "left")


def lag1_autocorr(df: DataFrame, y: str, by: str = "frequency", entity: str = "entity", at: str = "report_date", min_pairs: int = MIN_PAIRS) -> DataFrame:
    w = Window.partitionBy(entity, by).orderBy(at)
    pairs = df.select(by, F.lag(y).over(w).alias("a"), F.col(y).alias("b"))
    a, b = F.col("a"), F.col("b")
    out = pairs.groupBy(by).agg(pair_count(a, b).alias("n_pairs"), pair_correlation(a, b).alias("lag1_pearson"))
    return out.filter(F.col("n_pairs") >= min_pairs)


def observed_caps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_form(df, cols).groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def cohort_columns(df: DataFrame, home_source: str = "primary") -> DataFrame:
    return df.withColumns(
        {
            "split": F.when(F.col("train_eligible") == 1, "train").otherwise("prediction_only"),
            "cohort": F.when(F.col("source") == home_source, "domestic").otherwise("international"),
        }
    )
