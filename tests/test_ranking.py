from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from daybook.functions import ranking as rk


@pytest.fixture(params=[4096, 3, 1], ids=["whole", "runs", "single"])
def path(request, monkeypatch):
    """Groups in one run, in runs of about three values, and with a run for each value."""
    monkeypatch.setattr(rk, "RUN_VALUES", request.param)


def sample(spark):
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.normal(0, 50, 400), 1), "w": rng.integers(0, 9, 400).astype(float)})
    few = pd.DataFrame({"g": "few", "v": [0.0, 0.0, -3.5, 1e-9], "w": [1.0, 1.0, 2.0, 2.0]})
    one = pd.DataFrame({"g": ["one"], "v": [4.0], "w": [1.0]})
    pdf = pd.concat([hot, few, one], ignore_index=True)
    pdf["id"] = np.arange(len(pdf), dtype="int64")
    return pdf, spark.createDataFrame(pdf)


def test_midrank_and_average_rank(spark, path):
    pdf, df = sample(spark)
    got = df.join(rk.midrank_percentile(df, ["g"], "v"), ["g", "v"]).join(rk.average_ranks(df, ["g"], "v", "r"), ["g", "v"]).toPandas().set_index("id").sort_index()
    by = pdf.groupby("g")["v"]
    rank, n = by.rank(method="average"), by.transform("size")
    assert np.allclose(got["r"], rank)
    assert np.allclose(got["pct"], (rank - 0.5) / n)
    assert got.loc[got.g == "one", "pct"].item() == 0.5


def test_quantiles_match_numpy(spark, path):
    pdf, df = sample(spark)
    probs = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 1.0}
    got = rk.quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, v in pdf.groupby("g")["v"]:
        assert np.allclose(got.loc[g, list(probs)].astype(float), np.quantile(v, list(probs.values())))
    whole = rk.quantiles(df, [], "v", probs).first()
    assert np.allclose(list(whole), np.quantile(pdf["v"], list(probs.values())))


def test_spearman_matches_pandas_and_constant_is_zero(spark, path):
    pdf, df = sample(spark)
    got = {r.g: r for r in rk.spearman(df, ["g"], "v", "w").collect()}
    hot = pdf[pdf.g == "hot"]
    assert got["hot"].spearman == pytest.approx(hot["v"].rank().corr(hot["w"].rank()))
    assert got["hot"].pearson == pytest.approx(hot["v"].corr(hot["w"]))
    assert got["one"].spearman == 0.0 and got["one"].pearson is None


def test_order_positions_split_ties(spark, path):
    pdf, df = sample(spark)
    got = rk.order_positions(df, ["g"], ["w", "id"], "p").toPandas()
    for _, g in got.groupby("g"):
        want = g.sort_values(["w", "id"])["p"].tolist()
        assert want == list(range(len(g)))
        assert set(g["p_n"]) == {len(g)}


def test_run_counts_cuts_at_or_below(spark):
    v = [-5.0, -1.0, 0.0, 2.0, 2.5, 9.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(x, c) for x in v for c in ([], [0.0], [-1.0, 2.0, 9.0], sorted(v[:7]))], "v double, c array<double>")
    for r in df.withColumn("r", rk._run(rk.F.col("c"), rk.F.col("v"))).collect():
        assert r.r == sum(x <= r.v or r.v != r.v for x in r.c)


def test_special_values_and_narrow_bands(spark, path):
    nan, inf = float("nan"), float("inf")
    rows = [("s", v) for v in (1.0, nan, -inf, inf, 1.0, -2.0, nan, 0.0, -0.0)]
    rows += [("t", 1.7e15 + 0.25 * (i % 500)) for i in range(700)] + [("u", 5e-324 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, repr(r.v + 0.0)): r.r for r in rk.average_ranks(df, ["g"], "v", "r").collect()}
    for g in "stu":
        v = pd.Series([x for k, x in rows if k == g])
        order = v.map(lambda x: (x != x, x if x == x else 0.0))  # NaN last
        rank = order.rank() if g != "s" else pd.Series([sorted(order).index(x) + (list(order).count(x) + 1) / 2 for x in order])
        assert all(got[g, repr(x + 0.0)] == r for x, r in zip(v, rank, strict=True))


def test_runs_are_even(spark):
    """200,000 distinct values in a narrow band: no run holds more than a small part of them."""
    df = spark.range(200_000).selectExpr("'a' g", "1.7e15D + id * 0.25D v")
    cut = rk._cut(rk.value_counts(df, ["g"], "v"), ["g"], "v", ["n"])
    assert cut.groupBy("_bucket").count().agg({"count": "max"}).first()[0] < 40_000
    r = rk.average_ranks(df, ["g"], "v", "r").selectExpr("max(abs(r - ((v - 1.7e15D) / 0.25D + 1))) e", "count(*) n").first()
    assert (r.e, r.n) == (0.0, 200_000)


def test_quantiles_shuffle_no_rows(spark):
    """Of 200,000 distinct values only those near the wanted ones leave a task, and the results are those of the plain way, with
    ties, NaN and infinities too."""
    value = "case when id % 7 = 0 then null when id % 5 = 0 then double('NaN') when id % 11 = 0 then -double('inf') when id % 3 = 0 then 70.25D else (id * 7919) % 200003 * 0.25D end"
    df = spark.range(200_000).selectExpr("if(id % 50 = 0, null, if(id % 4 = 0, 'b', 'a')) g", "(id * 7919) % 200003 * 0.25D v", f"{value} w", "id % 1000 + 5 k")
    probs = {"lo": 0.01, "near": 0.0101, "q": 0.27, "mid": 0.5, "hi": 0.99, "first": 0.0, "last": 1.0}
    for c in ("v", "w", "k"):
        for keys in (["g"], []):
            got, want = (sorted(map(str, f(df, keys, c, probs).collect())) for f in (rk.quantiles, rk.quantiles_of_many))
            assert got == want and len(got) == (2 if keys else 1)
    assert 0 < _shuffled(rk.quantiles(df, ["g"], "v", probs)) < 10_000 < 150_000 < _shuffled(rk.quantiles_of_many(df, ["g"], "v", probs))


def _shuffled(df) -> int:
    """Records that the plan's exchanges wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else []
        if name == "Exchange":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        seq = p.children()
        todo += kids or [seq.apply(i) for i in range(seq.size())]
    return total


@pytest.mark.parametrize("hot_run", [1 << 18, 40, 0], ids=["even", "some hot", "all hot"])
def test_row_counts_match_pandas(spark, path, monkeypatch, hot_run):
    """Rows keep their columns; NULL keys and values take no part; rows that repeat are counted each."""
    monkeypatch.setattr(rk, "HOT_RUN", hot_run)
    pdf, _ = sample(spark)
    pdf = pd.concat([pdf, pdf[pdf.g == "hot"].head(60), pdf[pdf.g == "hot"].head(1).loc[[0] * 90]], ignore_index=True)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("hot", None, 0.0, -1), (None, 1.0, 0.0, -2)], "g string, v double, w double, id long"))
    got = rk.row_counts(df, ["g"], "v").toPandas().sort_values(["id"], kind="stable", ignore_index=True)
    want = pdf.sort_values("id", kind="stable", ignore_index=True)
    by = want.groupby("g")["v"]
    assert list(got.columns) == ["g", "v", "w", "id", "below_n", "n", "total_n"] and got[["g", "v", "w", "id"]].equals(want[["g", "v", "w", "id"]])
    assert (got["below_n"] == by.rank(method="min") - 1).all() and (got["below_n"] + got["n"] == by.rank(method="max")).all()
    assert (got["total_n"] == by.transform("size")).all()
    whole = rk.row_counts(df, [], "v").toPandas()
    assert len(whole) == len(pdf) + 1 and (whole["total_n"] == len(pdf) + 1).all()


def test_row_counts_special_values(spark, path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, nan, -inf, inf, 1.0, nan, 0.0, -0.0)], "v double")
    got = {repr(r.v + 0.0): (r.below_n, r.n) for r in rk.row_counts(df, [], "v").collect()}
    assert got == {"-inf": (0, 1), "0.0": (1, 2), "1.0": (3, 2), "inf": (5, 1), "nan": (6, 2)}


def test_percentiles_do_not_move_rows_to_meet_counts(spark):
    """Rows are shuffled once, by run: no join of the plan sorts and moves them."""
    from daybook.operators import peers

    rows = [("s", "annual", "2020", "k", float(i % 7), i) for i in range(60)]
    out = peers.peer_percentiles(spark.createDataFrame(rows, "sector string, frequency string, period string, kpi_name string, value double, id int"))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns[:5] == ["sector", "frequency", "period", "kpi_name", "oriented"] and out.count() == 60
