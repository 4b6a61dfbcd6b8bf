"""Order statistics of columns against sorting, and the preparation read off them against plain numpy."""

import numpy as np
import pytest

from daybook.functions import column_quantiles as cq
from daybook.operators import prep


def test_integers_keep_the_order_of_numbers():
    v = np.array([-np.inf, -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    u = cq.ordered(v)
    assert (np.diff(u.astype(object)) > 0).all() and np.array_equal(cq.numbers(u), v, equal_nan=True)
    assert cq.ordered(np.array([-0.0])) == cq.ordered(np.array([0.0])) and cq.ordered(np.array([-np.nan])) == u[-1:]


def sample(n=2500):
    rng = np.random.default_rng(11)
    fold = rng.integers(0, 3, n)
    cols = {"a": rng.normal(size=n), "ties": rng.integers(0, 4, n) / 2, "odd": np.where(rng.random(n) < 0.1, np.nan, np.where(rng.random(n) < 0.1, np.inf, rng.normal(size=n))), "flat": np.full(n, 2.5)}
    here = {c: rng.random(n) < 0.8 for c in cols}
    here["a"] &= fold != 1  # a group without numbers
    return fold, cols, here


def table(spark, fold, cols, here):
    rows = [(int(f), *[float(v[i]) if here[c][i] else None for c, v in cols.items()]) for i, f in enumerate(fold)]
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)


@pytest.mark.parametrize(("unit", "kept"), [(1 << 16, 1000), (97, 5), (200, 1)])
def test_order_statistics_are_exact(spark, monkeypatch, unit, kept):
    monkeypatch.setattr(cq, "UNIT_ROWS", unit)
    monkeypatch.setattr(cq, "KEPT", kept)
    fold, cols, here = sample()
    df, probs = table(spark, fold, cols, here), [0.0, 0.01, 0.5, 0.77, 1.0]
    for by in (["fold"], []):
        got = cq.column_order_stats(df, by, list(cols), probs)
        want = {}
        for key in [(0,), (1,), (2,)] if by else [()]:
            for i, (c, v) in enumerate(cols.items()):
                own = np.sort(v[here[c] & ((fold == key[0]) if by else True)])  # NaN last
                if len(own):
                    want[key, i] = [(len(own), own[int(np.floor(p * (len(own) - 1)))], own[int(np.ceil(p * (len(own) - 1)))]) for p in probs]
        assert set(got) == set(want) and all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)
    assert cq.column_order_stats(df.limit(0), ["fold"], list(cols), probs) == {}


def test_frames_are_prepared_by_columns(spark, monkeypatch):
    """Bounds, medians, means and deviations are those of plain numpy, and no value is a row of its own."""
    monkeypatch.setattr(prep, "quantiles", None)
    fold, cols, here = sample()
    del cols["odd"]
    df, names = table(spark, fold, cols, here), ["a", "ties", "flat"]
    for r in prep.fit_frame(df, names, ["a", "flat"], by=["fold"], y="ties").collect():
        for i, c in enumerate(names):
            own = cols[c][here[c] & (fold == r.fold)]
            if not len(own):
                assert (r.lo[i], r.hi[i], r.med[i], r["mean"][i], r.sd[i]) == (-np.inf, np.inf, 0.0, 0.0, 1.0)
                continue
            if c != "ties":
                assert np.allclose((r.lo[i], r.hi[i]), np.quantile(own, [0.01, 0.99]))
                own = np.clip(own, r.lo[i], r.hi[i])
            full = np.concatenate([own, np.full((fold == r.fold).sum() - len(own), np.median(own))])
            assert np.allclose((r.med[i], r["mean"][i], r.sd[i]), (np.median(own), full.mean(), full.std() or 1.0))
            assert np.allclose((r.y_lo, r.y_hi), np.quantile(cols["ties"][here["ties"] & (fold == r.fold)], [0.01, 0.99]))
