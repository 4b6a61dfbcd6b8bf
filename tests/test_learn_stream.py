from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.operators import backtest as bt
from daybook.operators import metrics as mt
from daybook.operators import models, prep, quality, serve, stats
from daybook.operators.label import forward_labels
from daybook.session import scratch_path
from daybook.streaming.bars import stream_weekly_bars
from daybook.streaming.labels import LATE, OUT, PRICE, REPORT, ROCKS, _OpenReleases, clock, run_labels, stream_session, time_line
from daybook.streaming.upsert import current, manifest, paths, stream_upsert, write_batch

D0 = dt.date(2020, 1, 1)


def frame(spark, n=300, k=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, k))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ np.arange(1.0, k + 1) + rng.normal(size=n)
    df = spark.createDataFrame([(i, r.tolist(), r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, x array<double>, z array<double>, y_fit double")
    return x, y, df


def test_ridge_equals_closed_form(spark):
    x, y, df = frame(spark)
    m = models.fit(models.roster()["Ridge"], {"alpha": 10.0}, df)
    want = np.linalg.solve(x.T @ x + 10 * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(m.model.weight, want, atol=1e-6)


def test_lasso_and_elastic_net_meet_their_optimality_conditions(spark):
    x, y, df = frame(spark)
    n = len(y)
    for name, p, l1, l2 in (("Lasso", {"alpha": 0.5}, 0.5, 0.0), ("ElasticNet", {"alpha": 0.5, "l1_ratio": 0.4}, 0.2, 0.3)):
        b = models.fit(models.roster()[name], p, df).model.weight
        g = x.T @ (y - y.mean() - x @ b) / n - l2 * b
        on = np.abs(b) > 1e-8
        assert np.allclose(g[on], l1 * np.sign(b[on]), atol=1e-4) and (np.abs(g[~on]) <= l1 + 1e-4).all()


def test_fold_winsorizer_roundtrip(spark):
    df = spark.createDataFrame([(float(i), None if i % 9 == 0 else float(-i)) for i in range(200)], "a double, b double")
    m = prep.FoldWinsorizer(inputCols=["a", "b"]).fit(df.filter("a < 101"))
    path = scratch_path(spark, "model")
    m.save(path)
    again = prep.FoldWinsorizerModel.load(path)
    out = again.transform(df).agg(F.min("a"), F.max("a"), F.count("b")).first()
    assert (out[0], out[1]) == (1.0, 99.0) and out[2] == df.filter("b is not null").count()


def test_time_folds_match_plain_splits(spark):
    n = 130
    df = spark.createDataFrame([(i, D0 + dt.timedelta(days=(i * 7) % 50)) for i in range(n)], "entity int, rd date")
    got = mt.time_folds(df, "rd", ["entity"], n=5, gap=3).toPandas()
    order = sorted(range(n), key=lambda i: ((i * 7) % 50, i))
    size = n // 6
    for f in range(5):
        s = n - 5 * size + f * size
        assert set(got[(got.fold == f) & (got.role == "test")].entity) == set(order[s : s + size])
        assert set(got[(got.fold == f) & (got.role == "train")].entity) == set(order[: s - 3])


def test_auc_and_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.2)], "label int, score double")
    assert mt.auc(df, "label", "score").first().auc == pytest.approx(4.5 / 6)
    m = mt.classification_metrics(df.filter("label = 0"), "label", "score").first()
    assert (m.tp, m.fp, m.precision, m.recall, m.f1, m.majority_baseline) == (0, 1, 0.0, 0.0, 0.0, 1.0)


def test_spreads_skip_short_periods(spark):
    rows = [("m", p, e, float(e), float(e)) for p, n in ((1, 20), (2, 19)) for e in range(n)]
    df = spark.createDataFrame(rows, "model string, period int, entity int, pred double, y double")
    r = mt.fixed_spread(df, "pred", "y").first()
    assert (r.spread_mean, r.n_periods) == (10.0, 1)


def test_vif_flags_exact_dependency(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + b, "d": rng.normal(size=500)})
    got = {r.feature: r for r in stats.vif(spark.createDataFrame(pdf), list("abcd"), "t").collect()}
    assert got["c"].vif == float("inf") and got["c"].flag == "HIGH>10" and got["d"].vif < 1.1


def test_turnover_equity_drawdown(spark):
    names = {1: ({1, 2}, {8, 9}), 2: ({2, 3}, {8, 9}), 3: ({2, 3}, {7, 1})}
    rows = [(p, p, leg, e, 0.0) for p, (lo, sh) in names.items() for leg, s in (("long", lo), ("short", sh)) for e in s]
    book = spark.createDataFrame(rows, "period int, period_idx int, leg string, entity int, ret double")
    assert {r.period: r.traded_notional for r in bt.turnover(book, 2).collect()} == {1: 2.0, 2: 1.0, 3: 2.0}
    net = spark.createDataFrame([(0.0, 1, -0.5), (0.0, 2, 1.0), (0.0, 3, -0.25)], "cost_bps double, period_idx int, net double")
    eq = bt.equity_curve(net)
    assert [round(r.equity, 9) for r in eq.orderBy("period_idx").collect()] == [0.5, 1.0, 0.75]
    assert bt.max_drawdown(eq).first().max_drawdown == pytest.approx(-0.25)
    assert bt.max_drawdown(eq, include_start=True).first().max_drawdown == pytest.approx(-0.5)


def test_fingerprint_sees_order_duplicates_and_null(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    def fp(d):
        return tuple(quality.fingerprint(d, "t").first())
    assert fp(a) == fp(b)
    assert fp(a) != fp(a.unionByName(a).unionByName(a)) and fp(a) != fp(a.fillna("x"))
    assert fp(a.limit(0))[1] == 0


TICK = "entity int, ts timestamp, event_id int, kind string, value double"


def ticks(n=400):
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2024, 1, 1)
    return [(int(rng.integers(0, 3)), t0 + dt.timedelta(hours=3 * i), i, f"k{i % 4}", float(rng.integers(1, 50))) for i in range(n)]


def feed(spark, name, schema, parts):
    """One file set per element, picked up one after another by separate runs."""
    src = scratch_path(spark, name)
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
        yield spark.readStream.schema(schema).parquet(src)


def test_stream_upsert_equals_batch_and_logs(spark):
    rows = ticks()
    target, log, ck = (scratch_path(spark, n) for n in ("t", "l", "c"))
    key = ["entity", "kind"]
    schema = spark.createDataFrame(rows[:1], TICK).schema
    for s in feed(spark, "u", TICK, [rows[:150], rows[150:300], rows[300:]]):
        stream_upsert(s, target, log, ck, key, "value", "entity", ["ts", "event_id"], buckets=4).awaitTermination()
    last = {}
    for r in rows:
        last[r[0], r[3]] = r[4]
    got = {(r.entity, r.kind): r.value for r in current(spark, target, schema, key).collect()}
    assert got == last
    changed = spark.read.parquet(f"{log}/restatements")
    assert changed.select("batch_id").distinct().count() == 2 and changed.filter("old_value = new_value").count() == 0


def test_upsert_reads_a_base_and_few_deltas(spark):
    """However many batches came before, a bucket is a base and fewer than ``fold`` deltas, and the logs stay right."""
    rows = ticks(600)
    target, log = (scratch_path(spark, n) for n in ("t", "l"))
    key, last, changed = ["entity", "kind"], {}, 0
    schema = spark.createDataFrame(rows[:1], TICK).schema
    for n in range(12):
        part = rows[50 * n : 50 * n + 50]
        for _ in range(2 if n in (4, 5) else 1):  # a batch that is run again
            write_batch(spark.createDataFrame(part, TICK), n, target, log, key, "value", "entity", ["ts", "event_id"], 4, fold=3)
        new = {(r[0], r[3]): r[4] for r in part}
        want = {(k, last[k], v) for k, v in new.items() if k in last and last[k] != v}
        if n:
            got = spark.read.parquet(f"{log}/restatements/batch_id={n}").collect()
            assert {((r.entity, r.kind), r.old_value, r.new_value) for r in got} == want
        changed, last = changed + len(want), {**last, **new}
        held = manifest(spark, target)
        assert all(len(d) < 3 for _, d in held.values()) and len(paths(target, held, held)) <= 3 * len(held)
        assert {(r.entity, r.kind): r.value for r in current(spark, target, schema, key).collect()} == last
    assert changed and any(base is not None for base, _ in held.values())


def test_stream_bars_equal_batch(spark):
    rows = ticks()
    out, ck = scratch_path(spark, "b"), scratch_path(spark, "bc")
    for s in feed(spark, "bars", TICK, [rows[:200], rows[200:]]):
        stream_weekly_bars(s, delay="1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    batch = serve.weekly_bars(spark.createDataFrame(rows, TICK)).toPandas()
    end = rows[-1][1] - dt.timedelta(days=1)
    want = batch[[dt.datetime.combine(w, dt.time()) + dt.timedelta(days=7) <= end for w in batch.week]]
    got = spark.read.parquet(out).toPandas()
    cols = ["entity", "week", "last_day", "open", "high", "low", "close", "n"]
    a, b = (x[cols].sort_values(["entity", "week"]).astype(str).values.tolist() for x in (got, want))
    assert a == b and a


LABELS = ["entity", "release_date", "t1_date", "t63_date", "ret", "vol", "sharpe", "status"]


def run_parts(spark, line, parts, **options):
    """Labels and late counts after each part has come in a run of its own."""
    src, out, late, ck = (scratch_path(spark, n) for n in ("ls", "lo", "ll", "lc"))
    own = stream_session(spark)
    for part in parts:
        part.write.mode("append").parquet(src)
        run_labels(own.readStream.schema(line.schema).parquet(src), out, late, ck, **options)
    return spark.read.schema(OUT).parquet(out), spark.read.schema(LATE).parquet(late)


def same_labels(got, want):
    a, b = (x.select(*LABELS).toPandas().sort_values(LABELS[:2]).reset_index(drop=True) for x in (got, want))
    a.loc[a.status == "insufficient_window", "t1_date"] = b.loc[b.status == "insufficient_window", "t1_date"] = None
    pd.testing.assert_frame_equal(a, b, check_exact=False, check_dtype=False)
    return set(b.status)


def test_stream_labels_equal_batch(spark):
    rng = np.random.default_rng(2)
    day = lambda i: D0 + dt.timedelta(days=i)
    prices = [(e, day(i), float(rng.integers(50, 90)) if e else 5.0) for e in (0, 1, 2) for i in range(60)]
    prices += [(4, day(i), float(rng.integers(50, 90))) for i in range(22)]  # ends early
    reports = [(e, day(i)) for e in (0, 1, 2) for i in (0, 3, 30, 55)] + [(4, day(0)), (4, day(5)), (4, day(5)), (5, day(3)), (1, None)]
    p = spark.createDataFrame(prices, "entity long, d date, adjusted_close double")
    r = spark.createDataFrame(reports, "entity long, release_date date")
    line = time_line(r, p)
    # real trading days come a part late, inside the delay; other rows come far too late
    held = (F.col("kind") == 0) & (F.col("day") >= F.lit(day(18))) & (F.col("day") < F.lit(day(25))) & (F.dayofmonth("day") % 2 == 0)
    cut = lambda a, b: (F.col("day") >= F.lit(day(a))) & (F.col("day") < F.lit(day(b)))
    late = line.filter((F.col("kind") == 0) & cut(0, 10)).withColumn("close", F.col("close") * 2)
    parts = [line.filter(cut(0, 25) & ~held), line.filter(cut(25, 41)).unionByName(line.filter(held)), line.filter(cut(41, 99)).unionByName(late), clock(line, dt.date(2200, 1, 1))]
    got, log = run_parts(spark, line, parts, n=20, delay="8 days")
    want = forward_labels(r, p, n=20)
    assert same_labels(got, want) == {"ok", "zero_volatility", "insufficient_window"}
    assert log.agg(F.sum("n_late")).first()[0] == late.count() > 0


def test_stream_labels_wait_for_the_watermark(spark):
    """A price that is corrected before the watermark passes counts with its last value, and idle entities are closed."""
    p = [(1, D0 + dt.timedelta(days=i), 10.0 + i) for i in range(30)]
    prices = spark.createDataFrame(p, "entity long, d date, adjusted_close double")
    reports = spark.createDataFrame([(1, D0 + dt.timedelta(days=5)), (1, D0 + dt.timedelta(days=25))], "entity long, release_date date")
    line = time_line(reports, prices)
    first = F.col("day") <= D0 + dt.timedelta(days=12)
    fixed = line.filter((F.col("kind") == 0) & (F.col("day") == D0 + dt.timedelta(days=12))).withColumn("close", F.lit(99.0))
    got, _ = run_parts(spark, line, [line.filter(first), line.filter(~first).unionByName(fixed)], n=10, delay="5 days", idle_days=20)
    changed = prices.withColumn("adjusted_close", F.when(F.col("d") == D0 + dt.timedelta(days=12), 99.0).otherwise(F.col("adjusted_close")))
    assert same_labels(got, forward_labels(reports, changed, n=10).filter("status = 'ok'")) == {"ok"}
    got, _ = run_parts(spark, line, [line.filter(first), line.filter(~first).unionByName(fixed), clock(line, D0 + dt.timedelta(days=60))], n=10, delay="5 days", idle_days=20)
    assert same_labels(got, forward_labels(reports, changed, n=10)) == {"ok", "insufficient_window"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS


def test_correlations_of_offset_columns(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"g": "x", "a": 1e9 + a, "b": 1e9 + a + 0.01 * rng.normal(size=400), "c": 7.0})
    df = spark.createDataFrame(pdf)
    want = np.corrcoef(pdf.a - 1e9, pdf.b - 1e9)[0, 1]
    r = {(x.feat_a, x.feat_b): x.r for x in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(want, abs=1e-6) and r["a", "c"] is None
    s = {x.feature: x for x in stats.feature_target_corr(df, ["a", "c"], "b", min_n=2).collect()}
    assert s["a"].pearson == pytest.approx(want, abs=1e-6) and s["c"].pearson is None and s["c"].spearman == 0


def test_feature_target_corr_matches_pandas_and_moves_rows_of_features_once(spark):
    """Ranks are those among complete pairs; ties, NULLs, empty and constant columns; rows of features have one large shuffle."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"y": rng.integers(0, 30, 300) / 4, "a": rng.integers(0, 9, 300) / 2, "b": rng.normal(size=300), "k": 1.0, "none": np.nan})
    for c, part in (("y", 0.1), ("a", 0.4), ("b", 0.7)):
        pdf.loc[rng.random(300) < part, c] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf))
    out = stats.feature_target_corr(df, ["a", "b", "k", "none"], "y", min_n=2, reliable_n=100)
    # one of rows, one of sums for each of the two results that are joined
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(f") <= 3
    got = {r.feature: r for r in out.collect()}
    assert set(got) == {"a", "b", "k"} and got["k"].pearson is None and got["k"].spearman == 0
    for c in "ab":
        both = pdf[[c, "y"]].dropna()
        assert got[c].n == len(both) and got[c].reliable == (len(both) >= 100)
        assert got[c].pearson == pytest.approx(both[c].corr(both.y)) and got[c].spearman == pytest.approx(both[c].rank().corr(both.y.rank()))


def test_fingerprint_tells_texts_and_names_apart(spark):
    def fp(rows, schema):
        return tuple(quality.fingerprint(spark.createDataFrame(rows, schema), "t").first())[3:]

    one = fp([("x|y", "z")], "a string, b string")
    others = [fp([("x", "y|z")], "a string, b string"), fp([("x|y", "z")], "a string, c string"), fp([("x|y", None)], "a string, b string"), fp([("x|y", "~")], "a string, b string")]
    assert len({one, *others}) == 5
    many = spark.range(3000).selectExpr("id", "'same' b").unionByName(spark.range(3000).selectExpr("id", "'same' b"))
    assert int(quality.fingerprint(many, "t").first().sum_hash) > 2**63


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    """A Python function of the package runs from a folder where workers cannot import it."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from daybook.session import local_session; from daybook.operators import sections as sx\n"
        "s = local_session('1', 1)\n"
        "print('TEXT', sx.html_to_text(s.createDataFrame([('<p>a</p>',)], 'html string'), 'html').first().text)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "TEXT a" in got.stdout, got.stderr[-2000:]


def test_unlimited_forests_have_the_maximum_depth():
    from daybook.operators import models

    for specs in (models.roster(), models.classifiers()):
        assert max(specs["RandomForest"].grid["max_depth"]) == 30


def test_label_state_is_called_by_entity_not_by_row():
    """Each call of the state crosses to the JVM: 1,000 prices of an entity cost no more calls than ten."""
    calls = []

    class State:
        def __init__(self):
            self.rows = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "exists":
                    return self.rows is not None
                if name in ("get", "iterator"):
                    return self.rows if isinstance(self.rows, tuple) else iter(self.rows or [])
                if name in ("put", "update"):
                    self.rows = args[0]
                if name == "appendList":
                    self.rows = [*(self.rows or []), *args[0]]
                if name == "clear":
                    self.rows = None
            return call

    class Handle:
        def __getattr__(self, name):
            return (lambda *a: State()) if name.startswith("get") else (lambda *a: calls.append(name) or [])

    class Now:
        def getCurrentWatermarkInMs(self):
            return (D0 + dt.timedelta(days=2000) - dt.date(1970, 1, 1)).days * 86_400_000

    def used(n):
        calls.clear()
        p = _OpenReleases(63, 0.02, 400)
        p.init(Handle())
        rows = [(D0, REPORT, None)] + [(D0 + dt.timedelta(days=1 + i), PRICE, 100.0 + i % 7) for i in range(n)]
        list(p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["day", "kind", "close"])]), None))
        return len(calls), [x for b in p.handleExpiredTimer((1,), Now(), None) for x in b.itertuples()]

    few, many = used(10), used(1000)
    assert many[0] == few[0] and len(calls) < 30
    assert [r.status for r in few[1]] == ["insufficient_window"] and [r.status for r in many[1]] == ["ok"]
