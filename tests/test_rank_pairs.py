"""Rank correlation over packed rows against pandas: runs, ties, hot values, NaN and infinities."""

import numpy as np
import pandas as pd
import pytest

from daybook.functions import rank_pairs, ranking
from daybook.operators import stats


def ordered(v):
    """Ranks with NaN after every number, as in Spark; NULL (None) stays out before."""
    return pd.Series(np.where(np.isnan(v), 1e308, np.clip(v, -1e300, 1e300))).rank().to_numpy()


def sample(n=3000):
    rng = np.random.default_rng(3)
    a = rng.normal(size=n)
    y = np.round(a + rng.normal(size=n), 1)
    y[: n // 3] = 0.5  # one hot target
    y[n // 3 : n // 3 + 40], y[n // 3 + 40 : n // 3 + 50] = np.nan, np.inf
    cols = {"a": a, "b": rng.integers(0, 5, n).astype(float), "hot": np.where(rng.random(n) < 0.8, 7.0, a), "odd": np.where(rng.random(n) < 0.3, np.nan, np.where(rng.random(n) < 0.1, -np.inf, y))}
    here = {c: rng.random(n) < 0.7 for c in cols} | {"y": rng.random(n) < 0.9}
    return y, cols, here


@pytest.mark.parametrize(("target", "column"), [(1 << 16, 1 << 18), (100, 70), (1 << 16, 200), (250, 1 << 18)])
def test_rank_sums_match_pandas(spark, monkeypatch, target, column):
    monkeypatch.setattr(rank_pairs, "TARGET_ROWS", target)
    monkeypatch.setattr(rank_pairs, "COLUMN_ROWS", column)
    monkeypatch.setattr(rank_pairs, "SENT_ROWS", 300)
    y, cols, here = sample()
    both = {"y": y, **cols}
    rows = [tuple(float(both[c][i]) if here[c][i] else None for c in both) + (None,) for i in range(len(y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*both, "none"])).repartition(5)
    got = {r[0]: r[1:] for r in rank_pairs.rank_pair_sums(df, "y", [*cols, "none"])}
    assert set(got) == {0, 1, 2, 3}
    for f, c in enumerate(cols):
        at = here[c] & here["y"]
        rx, ry = (ordered(v[at]) - (at.sum() + 1) / 2 for v in (cols[c], y))
        assert got[f][0] == at.sum() and np.allclose(got[f][1:3], 0, atol=1e-6) and np.allclose(got[f][3:], [rx @ rx, ry @ ry, rx @ ry], rtol=1e-12)
    assert rank_pairs.rank_pair_sums(df.limit(0), "y", ["a"]) == [] == rank_pairs.rank_pair_sums(df, "none", ["a"])


def test_target_correlations_search_no_run_for_each_value(spark, monkeypatch):
    """A search by expressions for each value of each column, twice, was what e6 and d12 took their time for."""
    def no_search(*_):
        raise AssertionError("a search")

    monkeypatch.setattr(ranking, "_run", no_search)
    df = spark.range(500).selectExpr("double(id % 50) y", "double(id % 7) a", "double(-id) b")
    got = {r.feature: r for r in stats.feature_target_corr(df, ["a", "b"], "y").collect()}
    pdf = df.toPandas()
    assert all(got[c].spearman == pytest.approx(pdf[c].rank().corr(pdf.y.rank())) and got[c].n == 500 for c in "ab")
