"""Moment sums that combine on the map side; correlations and shapes are read off them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are present; NULL when a side is constant, up to the rounding of its mean.
    Spark's aggregates keep centred moments, so a large offset costs no digits."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(xs), F.stddev_pop(ys)
    live = (sx > 1e-13 * F.abs(F.avg(xs))) & (sy > 1e-13 * F.abs(F.avg(ys)))
    return F.when(live, F.covar_pop(xs, ys) / F.nullif(sx * sy, F.lit(0.0)))


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def pearson(prefix: str = "", tiny: float = 1e-12) -> Column:
    """Correlation from pair sums of values near zero; NULL when a side is constant."""
    n, sx, sy, sxx, syy, sxy = (F.col(f"{prefix}{k}") for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    live = (vx > tiny * F.greatest(n * sxx, F.lit(1e-300))) & (vy > tiny * F.greatest(n * syy, F.lit(1e-300)))
    return F.when(live, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def corrected_skew(c: Column) -> Column:
    """Sample skewness (bias-corrected); NULL below three rows."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(c))


def corrected_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis (bias-corrected); NULL below four rows."""
    n = F.count(c).cast("double")
    den = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, (n - 1) / den * ((n + 1) * F.kurtosis(c) + 6.0))


def weighted_pair_sums(x: Column, y: Column, w: Column, prefix: str = "") -> list[Column]:
    """Pair sums of rows that stand for ``w`` equal rows each."""
    x, y = x.cast("double"), y.cast("double")
    return [
        F.sum(w).alias(f"{prefix}n"), F.sum(w * x).alias(f"{prefix}sx"), F.sum(w * y).alias(f"{prefix}sy"),
        F.sum(w * x * x).alias(f"{prefix}sxx"), F.sum(w * y * y).alias(f"{prefix}syy"),
        F.sum(w * x * y).alias(f"{prefix}sxy"),
    ]


weighted_pearson = pearson
