from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daybook.functions.exprs import debt_sum, growth, positive, safe_ratio
from daybook.operators import kpi, select
from daybook.sources import market


def d(s):
    return dt.date.fromisoformat(s)


def test_expressions(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, None, None, 9.0), (1.0, -2.0, 3.0, None, 9.0), (None, 2.0, None, None, None)],
        "a double, b double, s double, l double, t double",
    )
    got = df.select(safe_ratio("a", "b"), positive("b"), debt_sum("s", "l", "t"), growth("a", "b", True)).collect()
    assert tuple(got[0]) == (None, None, 9.0, None)
    assert tuple(got[1]) == (-0.5, None, 3.0, 1.5)
    assert tuple(got[2]) == (None, 2.0, 0.0, None)


def test_positions_map_zero_is_data(spark):
    df = spark.createDataFrame([(1, "x", 0.0, "missing"), (1, "y", 0.0, "selected")], "k int, position string, value double, selection_status string")
    r = kpi.positions_map(df, ["k"], ["x", "y", "z"]).first()
    assert (r.x, r.y, r.z) == (None, 0.0, None)


def test_collision_prefers_quarterly_and_null_release_uses_period_end(spark):
    df = spark.createDataFrame(
        [(1, "annual", d("2020-12-31"), d("2021-02-01")), (1, "quarterly", d("2020-12-31"), d("2021-02-01")), (2, "annual", d("2020-12-31"), None)],
        "entity int, form string, period_end date, release_date date",
    )
    got = {(r.entity, r.report_date): r.form for r in kpi.resolve_collision(kpi.with_effective_date(df)).collect()}
    assert got == {(1, d("2021-02-01")): "quarterly", (2, d("2020-12-31")): "annual"}


def test_prior_window_bounds(spark):
    base = d("2021-12-31")
    rows = [(1, "quarterly", base, 1.0)] + [(1, "quarterly", base - dt.timedelta(days=g), float(g)) for g in (349, 350, 381, 382)]
    df = spark.createDataFrame(rows, "entity int, form string, period_end date, revenue double")
    got = kpi.with_prior(df, ["revenue"]).filter(F.col("period_end") == base).first()
    assert got.prior_revenue == 350.0
    only = kpi.with_prior(df.filter("revenue in (1.0, 349.0, 382.0)"), ["revenue"]).filter(F.col("period_end") == base).first()
    assert only.prior_end is None


CAND = "accession int, position string, line_no int, statement string, form string, report_date date, start_date date, end_date date, filed date, source string, concept_priority int, value double"


def fact(line, statement, form, start, end, source="companyfacts", prio=1, filed="2021-03-01", acc=1):
    return (acc, "p", line, statement, form, d("2020-12-31"), d(start) if start else None, d(end), d(filed), source, prio, float(line))


def best(spark, rows):
    return select.select_best_fact(spark.createDataFrame(rows, CAND)).first()


def test_best_fact_tiers(spark):
    inc, bal = "income_statement", "balance_sheet"
    r = best(spark, [fact(1, bal, "10-K", None, "2020-12-31", "ixbrl"), fact(2, bal, "10-K", None, "2021-01-31", prio=0)])
    assert (r.value, r.selection_status) == (1.0, "selected_ixbrl_balance_sheet_exact_report_date")
    r = best(spark, [fact(1, bal, "10-K", None, "2020-09-30"), fact(2, bal, "10-K", None, "2020-11-30")])
    assert (r.value, r.selection_status) == (2.0, "selected_balance_sheet_fallback_latest_instant_check")
    r = best(spark, [fact(1, bal, "10-K", "2020-01-01", "2020-11-30")])
    assert r.selection_status == "selected_balance_sheet_fallback_check"
    r = best(spark, [fact(1, inc, "10-K", "2020-10-01", "2020-12-31"), fact(2, inc, "10-K", "2020-04-01", "2020-12-31")])
    assert (r.value, r.selection_status) == (None, "missing")  # 91 and 274 days are not a year
    r = best(spark, [fact(1, inc, "10-K", "2020-10-01", "2020-12-31", prio=0), fact(2, inc, "10-K", "2020-01-01", "2020-12-31", prio=5)])
    assert (r.value, r.selection_status) == (2.0, "selected_annual_duration_exact_end_date")
    r = best(spark, [fact(1, inc, "10-K", "2019-01-01", "2020-12-31")])
    assert r.selection_status == "selected_annual_exact_end_date_duration_fallback_check"
    r = best(spark, [fact(1, inc, "10-K", "2019-10-01", "2020-09-30")])
    assert r.selection_status == "selected_annual_duration_without_exact_end_date_check"
    r = best(spark, [fact(1, inc, "10-Q", "2020-01-01", "2020-12-31"), fact(2, inc, "10-Q", "2020-06-01", "2020-12-31")])
    assert (r.value, r.selection_status) == (2.0, "selected_quarter_exact_end_date_duration_fallback_check")
    r = best(spark, [fact(1, inc, "10-Q", "2020-10-01", "2020-12-31", filed="2021-01-01"), fact(2, inc, "10-Q", "2020-10-01", "2020-12-31", filed="2021-02-01")])
    assert (r.value, r.selection_status) == (2.0, "selected_quarter_duration_exact_end_date")
    r = best(spark, [fact(1, inc, "20-F", "2020-01-01", "2020-12-31", "ixbrl"), fact(2, inc, "20-F", "2020-12-01", "2020-12-31")])
    assert (r.value, r.selection_status) == (2.0, "selected_default_exact_end_date")
    r = best(spark, [fact(1, inc, "10-Q", None, "2020-12-31"), fact(2, inc, "10-Q", "2020-12-31", "2020-12-31", prio=2)])
    assert (r.value, r.selection_status) == (1.0, "selected_no_duration_available_check")


def test_decumulate(spark):
    def row(acc, end, dur, v, form="10-Q", status="selected", st="cash_flow_statement"):
        return (acc, "p", "e", form, st, d(end) - dt.timedelta(days=dur), d(end), dur, v, status)

    rows = [
        row(1, "2020-03-31", 90, 10.0), row(2, "2020-06-30", 181, 25.0), row(3, "2020-09-30", 273, 45.0),
        row(4, "2021-06-30", 181, 30.0), row(5, "2021-12-31", 365, 99.0, form="10-K"),
        row(6, "2022-03-31", 90, 1.0), row(7, "2022-09-30", 273, 9.0), row(8, "2022-06-30", 181, 5.0, st="balance_sheet"),
    ]
    df = spark.createDataFrame(rows, "accession int, position string, entity string, form string, statement string, start_date date, end_date date, duration_days int, value double, selection_status string")
    fye = spark.createDataFrame([("e", 12)], "entity string, fye_month int")
    got = {r.accession: (r.value, r.duration_days, r.selection_status) for r in select.decumulate_ytd(df, fye).collect()}
    assert got[1] == (10.0, 90, "selected")
    assert got[2] == (15.0, 91, "selected+decumulated")
    assert got[3] == (20.0, 92, "selected+decumulated")  # against the original, not the changed value
    assert got[4] == (None, 181, "missing")  # no baseline in its year
    assert got[5] == (99.0, 365, "selected")
    assert got[7] == (None, 273, "missing")  # a quarter in between is absent
    assert got[8] == (5.0, 181, "selected")


def loop(values, rules):
    v = dict(values)
    for _ in range(5):
        moved = False
        for r in rules:
            if r.target not in v or (v[r.target] is not None and not r.overwrite_existing):
                continue
            total, missing, found = 0.0, 0, 0
            for n, w in r.components:
                if v.get(n) is None:
                    missing += not r.missing_components_as_zero
                else:
                    total += w * v[n]
                    found += 1
            if missing or (r.require_at_least_one_component and not found):
                continue
            moved = v[r.target] != total or moved
            v[r.target] = total
        if not moved:
            break
    return v


def test_calculations_match_a_plain_loop(spark):
    R = select.CalcRule
    rules = [
        R("c", (("b", 1.0), ("x", 2.0))), R("b", (("a", 1.0), ("y", -1.0)), missing_components_as_zero=True, require_at_least_one_component=True),
        R("z", (("c", 1.0),), overwrite_existing=True), R("q", (("nope", 1.0),), missing_components_as_zero=True),
    ]
    names = ["a", "b", "c", "x", "y", "z", "q"]
    cases = [
        dict(zip(names, t)) for t in [
            (1.0, None, None, 3.0, None, 5.0, None), (None, None, None, 3.0, None, 5.0, 1.0), (2.0, 7.0, None, None, 1.0, None, None), (2.0, None, 4.0, 1.0, 1.0, None, None),
        ]
    ]
    rows = [(i, n, v) for i, c in enumerate(cases) for n, v in c.items()]
    rows = [r for r in rows if not (r[0] == 3 and r[1] == "z")]  # a target without a row stays absent
    df = spark.createDataFrame(rows, "k int, position string, value double")
    got: dict = {}
    for r in select.apply_calculations(df, rules, ["k"], names).collect():
        got.setdefault(r.k, {})[r.position] = r.value
    for i, c in enumerate(cases):
        want = {n: v for n, v in c.items() if (i, n) != (3, "z")}
        assert got[i] == loop(want, rules)


def test_release_match_and_year_partner(spark):
    p = spark.createDataFrame([(1, d("2020-12-31")), (1, d("2021-12-31")), (2, d("2020-12-31"))], "entity int, period_end date")
    r = spark.createDataFrame([(1, d("2020-12-31")), (1, d("2021-04-30")), (1, d("2021-03-01")), (2, d("2021-06-30"))], "entity int, release_date date")
    got = {(x.entity, x.period_end): (x.release_date, x.lag_days) for x in market.match_release(p, r, F.lit(120)).collect()}
    assert got == {(1, d("2020-12-31")): (d("2021-03-01"), 60), (1, d("2021-12-31")): (None, None), (2, d("2020-12-31")): (None, None)}
    n = {x.entity: (x.periods, x.with_partner) for x in market.yoy_partner_count(p).collect()}
    assert n == {1: (2, 1), 2: (1, 0)}


def test_fye_month_ties_and_default(spark):
    rows = [(1, "10-K", d("2020-06-30")), (1, "10-K", d("2021-03-31")), (1, "10-Q", d("2021-09-30")), (2, "10-Q", d("2021-09-30"))]
    df = spark.createDataFrame(rows, "entity int, form string, report_date date")
    assert {r.entity: r.fye_month for r in select.fye_month(df).collect()} == {1: 3, 2: 12}


def test_upsert_keeps_the_last_write(spark):
    from daybook.operators import ingest

    old = spark.createDataFrame([(1, 5.0), (2, 6.0), (4, None)], "k int, value double")
    new = spark.createDataFrame([(1, 9.0, 1), (1, 2.0, 2), (3, 7.0, 1), (3, None, 2), (4, 8.0, 0)], "k int, value double, seq int")
    for batch in (new, new.orderBy("value")):
        assert sorted(tuple(r) for r in ingest.upsert(old, batch, ["k"], ["seq"]).collect()) == [(1, 2.0), (2, 6.0), (3, None), (4, 8.0)]
