"""Label queries (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.operators import label as L
from daybook.plans import fixtures as fx
from daybook.plans.oracle import cte, sql
from daybook.plans.registry import query
from daybook.session import stage

cte(
    "pw",
    """select entity, d, adjusted_close c,
  count(*) over ahead n_rows, last_value(d) over ahead last_day, last_value(adjusted_close) over ahead last_close,
  avg(ret) over moves mean_ret, stddev_samp(ret) over moves sd_ret
from (select *, adjusted_close / lag(adjusted_close) over (partition by entity order by d) - 1 ret from f2)
window ahead as (partition by entity order by d rows between current row and 62 following),
  moves as (partition by entity order by d rows between 1 following and 62 following)""",
    "f2",
)


def label_cte(name: str, reports: str, cols: str) -> None:
    cte(
        name,
        f"""select {cols}, t1_date, case when n_rows >= 63 then last_day end t63_date,
  cast(least(coalesce(n_rows, 0), 63) as int) n_forward_days,
  case when n_rows >= 63 then last_close / c - 1 end ret, case when n_rows >= 63 then sd_ret end vol,
  case when n_rows >= 63 and sd_ret > 0 then (mean_ret - cast(0.02 as double)/cast(252 as double)) / sd_ret * sqrt(cast(252 as double)) end sharpe,
  case when n_rows >= 63 and sd_ret > 0 then mean_ret / sd_ret * sqrt(cast(252 as double)) end sharpe_rf0,
  cast(0.02 as double) risk_free_annual,
  case when coalesce(n_rows,0) < 63 then 'insufficient_window' when sd_ret > 0 then 'ok' else 'zero_volatility' end status
from (select {cols.replace('entity', 'r.entity', 1)}, min(d) t1_date from {reports} r left join f2 on f2.entity = r.entity and d > release_date
   group by {cols.replace('entity', 'r.entity', 1)}) t
left join pw on pw.entity = t.entity and pw.d = t.t1_date
where t.entity in (select entity from f2)""".replace(f"select {cols}, t1_date", f"select {cols.replace('entity', 't.entity', 1)}, t1_date", 1),
        "f2", "pw", reports,
    )


label_cte("lab", "rep", "entity, release_date")
cte(
    "lrep",
    """select entity, release_date, max(period_end) period_end, max(source) source from f1r
where release_date is not null group by 1, 2""",
    "f1r",
)
label_cte("labr", "lrep", "entity, release_date, period_end, source")


def month_labels(s, d):
    return stage(s, d, "month_labels", lambda: L.forward_labels(reports_and_unreleased(s, d), fx.prices(s, d)))


def report_labels(s, d):
    return stage(
        s, d, "report_labels",
        lambda: L.forward_labels(L.label_reports(fx.filed_reports(s, d)), fx.prices(s, d)),
    )


def flagship(s, d):
    lab = L.forward_labels(fx.ship_month_reports(s, d), fx.prices(s, d))
    return lab.select(
        "entity", "release_date", "t1_date", "t63_date", "n_forward_days",
        *[r6(c).alias(c) for c in ("ret", "vol", "sharpe", "sharpe_rf0")], "status",
    )


query(
    "t0_forward_label",
    sql("""select entity, release_date, t1_date, t63_date, n_forward_days, round(ret,6) ret, round(vol,6) vol,
  round(sharpe,6) sharpe, round(sharpe_rf0,6) sharpe_rf0, status from lab""", "lab"),
)(flagship)


def reports_and_unreleased(s, d):
    """Also one report per entity that has not been released."""
    r = fx.ship_month_reports(s, d).select("entity", "release_date")
    return r.unionByName(r.select("entity").distinct().withColumn("release_date", F.lit(None).cast("date")))


@query("t1_first_row_after", sql("select entity, release_date, t1_date from lab union all select distinct entity, null, null from rep", "lab", "rep"))
def t1(s, d):
    return L.first_row_after(reports_and_unreleased(s, d), fx.prices(s, d))


@query(
    "t2_forward_window",
    sql("select entity, release_date, t1_date, t63_date, n_forward_days, status from lab", "lab"),
)
def t2(s, d):
    return month_labels(s, d).select("entity", "release_date", "t1_date", "t63_date", "n_forward_days", "status")


@query("t3_window_return", sql("select entity, release_date, round(ret,6) ret from lab", "lab"))
def t3(s, d):
    return month_labels(s, d).select("entity", "release_date", r6("ret").alias("ret"))


@query("t4_window_vol", sql("select entity, release_date, round(vol,6) vol from lab", "lab"))
def t4(s, d):
    return month_labels(s, d).select("entity", "release_date", r6("vol").alias("vol"))


@query(
    "t5_window_sharpe",
    sql("select entity, release_date, round(sharpe,6) sharpe, round(sharpe_rf0,6) sharpe_rf0, status from lab", "lab"),
)
def t5(s, d):
    return month_labels(s, d).select(
        "entity", "release_date", r6("sharpe").alias("sharpe"), r6("sharpe_rf0").alias("sharpe_rf0"), "status"
    )


@query("t6_label_reports", sql("select entity, release_date, period_end, source from lrep", "lrep"))
def t6(s, d):
    return L.label_reports(fx.filed_reports(s, d)).select("entity", "release_date", "period_end", "source")


@query(
    "t7_label_audit",
    sql("""select count(*) n_ok, max(abs(sharpe - (sharpe_rf0 - risk_free_annual / (vol * sqrt(cast(252 as double)))))) < 1e-9 holds
from lab where status = 'ok'""", "lab"),
)
def t7(s, d):
    return L.label_audit(month_labels(s, d))


@query(
    "t8_label_summary",
    sql("""select status, count(*) n, round(min(sharpe),6) min_sharpe, round(max(sharpe),6) max_sharpe,
 round(avg(sharpe),6) mean_sharpe, round(quantile_cont(sharpe, 0.5),6) median_sharpe from lab group by 1""", "lab"),
)
def t8(s, d):
    out = L.label_summary(month_labels(s, d))
    return out.select("status", "n", *[r6(c).alias(c) for c in out.columns if c.endswith("sharpe")])


@query(
    "t8_without_prices",
    sql("""select distinct o_custkey as entity from orders where o_custkey not in (select entity from f2)""", "f2"),
)
def t8b(s, d):
    from daybook.sources.tables import read_table

    buyers = read_table(s, d, "orders").select(F.col("o_custkey").alias("entity"))
    return L.without_prices(buyers, fx.prices(s, d))


@query(
    "t9_spread_sample",
    sql("""select entity, release_date, source, t1_date, t63_date, round(sharpe,6) sharpe from (
 select *, row_number() over (partition by source order by entity, release_date) - 1 p, greatest(count(*) over (partition by source) // 4, 1) step
 from labr where status = 'ok') where p % step = 0 and p < step * 4""", "labr"),
)
def t9(s, d):
    lab = report_labels(s, d)
    return L.spread_sample(lab, 4).select("entity", "release_date", "source", "t1_date", "t63_date", r6("sharpe").alias("sharpe"))
