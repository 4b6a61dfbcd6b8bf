from __future__ import annotations

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from daybook.operators import label, table

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def brute(release, rows, n=63, rf=0.02):
    rows = sorted(rows)
    after = [r for r in rows if r[0] > release]
    if len(after) < n:
        return after[0][0] if after else None, None, len(after), None, None, "insufficient_window"
    w = [c for _, c in after[:n]]
    ret = [b / a - 1 for a, b in zip(w, w[1:])]
    sd = statistics.stdev(ret)
    sharpe = (statistics.fmean(ret) - rf / 252) / sd * 252**0.5 if sd > 0 else None
    return after[0][0], after[n - 1][0], n, w[-1] / w[0] - 1, sharpe, "ok" if sd > 0 else "zero_volatility"


def test_forward_labels_edges(spark):
    prices = [("a", day(2 * i), 100.0 + (i * 37 % 11)) for i in range(100)]
    prices += [("flat", day(i), 5.0) for i in range(70)] + [("exact", day(i), 10.0 + i) for i in range(64)]
    reports = [("a", day(0)), ("a", day(1)), ("a", day(80)), ("a", day(198)), ("a", day(500)), ("flat", day(0)), ("exact", day(0)), ("exact", day(1)), ("gone", day(3))]
    p = spark.createDataFrame(prices, "entity string, d date, adjusted_close double")
    r = spark.createDataFrame(reports, "entity string, release_date date")
    got = {(x.entity, x.release_date): x for x in label.forward_labels(r, p).collect()}
    assert ("gone", day(3)) not in got
    for e, rel in reports[:-1]:
        t1, t63, n, ret, sharpe, status = brute(rel, [(d, c) for k, d, c in prices if k == e])
        x = got[e, rel]
        assert (x.t1_date, x.t63_date, x.n_forward_days, x.status) == (t1, t63, n, status)
        assert x.ret == pytest.approx(ret) if ret is not None else x.ret is None
        assert x.sharpe == pytest.approx(sharpe) if sharpe is not None else x.sharpe is None
    assert got["a", day(0)].t1_date == day(2)  # a release on a trading day starts on the next one


def test_asof_score_never_looks_ahead(spark):
    spine = spark.createDataFrame([(1, day(10)), (1, day(5)), (2, day(10)), (3, day(10))], "entity int, report_date date")
    sc = spark.createDataFrame(
        [(1, day(10), 0.9, "primary"), (1, day(4), 0.1, "secondary"), (1, day(3), 0.3, "secondary"), (2, day(11), 0.7, "secondary"), (3, day(9), 0.5, "primary")],
        "entity int, score_date date, score double, source string",
    )
    got = {(x.entity, x.report_date): (x.text_score, x.text_match, x.text_asof_date) for x in table.asof_score(spine, sc, "secondary").collect()}
    assert got[1, day(10)] == (0.9, "exact", day(10))
    assert got[1, day(5)] == (0.1, "asof", day(4))
    assert got[2, day(10)] == (None, None, None)  # only a later score
    assert got[3, day(10)] == (None, None, None)  # only another source before it


def test_winsorize_keeps_null_and_raw(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    out = table.winsorize(df, ["x"])
    r = out.agg(F.min("x"), F.max("x"), F.max("x_raw"), F.count_if(F.col("x").isNull())).first()
    assert tuple(r) == (1.0, 99.0, 100.0, 1)


def test_changes_and_floor(spark):
    rows = [(e, "quarterly", day(90 * i), float(i * i)) for e in (1, 2) for i in range(8 if e == 1 else 3)] + [(1, "annual", day(100), 7.0)]
    df = spark.createDataFrame(rows, "entity int, frequency string, report_date date, v double").withColumn("target_missing", F.lit(0))
    out = table.train_eligible(table.change_features(df, ["v"]), 6).collect()
    one = sorted((x.report_date, x.v_change, x.first_obs, x.train_eligible) for x in out if x.entity == 1 and x.frequency == "quarterly")
    assert one[0][1:] == (None, 1, 0) and one[2][1] == 3.0
    assert sum(x.train_eligible for x in out if x.entity == 1) == 7
    assert sum(x.train_eligible for x in out if x.entity == 2) == 0


def test_reports_without_a_release_have_no_label(spark):
    p = spark.createDataFrame([("a", day(i), 10.0 + i % 7) for i in range(70)] + [("a", None, 1.0)], "entity string, d date, adjusted_close double")
    r = spark.createDataFrame([("a", None), ("a", day(0))], "entity string, release_date date")
    assert {x.release_date: x.t1_date for x in label.first_row_after(r, p).collect()} == {None: None, day(0): day(1)}
    assert [x.release_date for x in label.forward_labels(r, p.filter("d is not null")).collect()] == [day(0)]


def test_facts_and_prices_move_bare_rows(spark, tmp_path):
    """Rows that hardly meet in a task are not summed there before the shuffle; sums, NULL entities and repeated rows stay as they were."""
    from daybook.plans import fixtures as fx

    rows = [(e, f"1996-0{m}-11 00:00:00", 10.0 * m, 0.05, 0.02, 4.0 * m, "A", "O") for e in (1, 1, 2, None) for m in (1, 2, 5)]
    names = ["l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"]
    li = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, ["long", "string", *["double"] * 4, "string", "string"], strict=True)))
    li.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (2, 3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(3, 4)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    prices, facts = fx._prices(spark, str(tmp_path)), fx._facts_wide(spark, str(tmp_path))
    for df in (prices, facts):
        assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.entity, r.d.month, r.adjusted_close) for r in prices.collect()} == {(e, m, 2.5) for e in (1, 2, None) for m in (1, 2, 5)}
    assert {(r.entity, r.form, r.period_end.month, r.total_assets, r.total_debt) for r in facts.collect()} == {
        (e, form, m, k * 30.0 * s, None) for e, k in ((1, 2), (2, 1)) for form, m, s in (("quarterly", 3, 3), ("quarterly", 6, 5), ("annual", 12, 8))
    }
