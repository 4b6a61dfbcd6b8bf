"""Selection and standardisation queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.operators import select as sl
from daybook.plans import fixtures as fx
from daybook.plans.oracle import cte, sql
from daybook.plans.registry import query
from daybook.session import stage
from daybook.sources import market as mk

cte(
    "fye",
    """select entity, coalesce(first(m order by n desc, m) filter (where m is not null), 12) fye_month from (
 select entity, case when form = '10-K' then cast(month(report_date) as int) end m, count(*) n from fil group by 1, 2) group by 1""",
    "fil",
)
cte(
    "fyr",
    """select fil.*, fye_month, cast(year(report_date) + case when month(report_date) > fye_month then 1 else 0 end as int) fiscal_year
 from fil join fye on fye.entity = fil.entity""",
    "fil", "fye",
)


@query("p1_fye_month", sql("select entity, fye_month from fye", "fye"))
def p1(s, d):
    return sl.fye_month(fx.filings(s, d))


def fiscal(s, d):
    f = fx.filings(s, d)
    return sl.with_fiscal_year(f, sl.fye_month(f))


@query("p2_fiscal_year", sql("select accession, entity, report_date, fiscal_year from fyr", "fyr"))
def p2(s, d):
    return fiscal(s, d).select("accession", "entity", "report_date", "fiscal_year")


@query(
    "p3_last_n_years",
    sql("""select accession, entity, fiscal_year from (select *, dense_rank() over (partition by entity order by fiscal_year desc) r from fyr) where r <= 3""", "fyr"),
)
def p3(s, d):
    return sl.last_n_years(fiscal(s, d), 3).select("accession", "entity", "fiscal_year")


@query(
    "p4_latest_per_period",
    sql("""select entity, form, report_date, filed, accession from fil
 qualify row_number() over (partition by entity, form, report_date order by filed desc, accession desc) = 1""", "fil"),
)
def p4(s, d):
    return sl.latest_per_period(fx.filings(s, d))


STATEMENT = "case position when 'A' then 'balance_sheet' when 'N' then 'income_statement' else 'cash_flow_statement' end"


def prepared(s, d):
    """F4 with statement type, report date and a third form."""
    f = fx.candidates(s, d)
    last = f.groupBy("accession").agg(F.max("end_date").alias("report_date"))
    form = F.when(F.col("accession") % 11 == 0, "20-F").otherwise(F.col("form"))
    return f.join(last, "accession").withColumn("statement", F.expr(STATEMENT)).withColumn("form", form)


cte(
    "bf",
    f"""select accession, position, entity, form, statement,
 case when miss then null else value end as value, case when miss then null else start_date end start_date,
 case when miss then null else end_date end end_date, case when miss then null else dur end duration_days,
 case when miss then null else source end source, case when miss then null else line_no end line_no,
 case when miss then 'missing'
  when tier = 1 then case when source = 'ixbrl' then 'selected_ixbrl_balance_sheet_exact_report_date' else 'selected_companyfacts_balance_sheet_exact_report_date' end
  when tier = 2 then 'selected_balance_sheet_fallback_latest_instant_check'
  when tier = 3 then 'selected_balance_sheet_fallback_check'
  when tier = 9 then 'selected_no_duration_available_check'
  when tier = 4 and form = '10-K' then 'selected_annual_duration_exact_end_date'
  when tier = 4 and form = '10-Q' then 'selected_quarter_duration_exact_end_date'
  when tier = 4 then 'selected_default_exact_end_date'
  when tier = 5 and form = '10-K' then 'selected_annual_exact_end_date_duration_fallback_check'
  when tier = 5 then 'selected_quarter_exact_end_date_duration_fallback_check'
  when tier = 6 and form = '10-K' then 'selected_annual_duration_without_exact_end_date_check'
  when tier = 6 and form = '10-Q' then 'selected_quarter_duration_without_exact_end_date_check'
  when tier = 6 then 'selected_default_duration_without_exact_end_date_check'
  when form = '10-K' then 'selected_longest_duration_annual_without_exact_end_date_check'
  else 'selected_shortest_duration_quarter_without_exact_end_date_check' end selection_status
from (select *, tier in (5, 7) and form = '10-K' and dur < 300 miss from (
 select *, case when statement = 'balance_sheet' then case when end_date = report_date then 1 when coalesce(dur, 0) = 0 then 2 else 3 end
   when dur is null or dur <= 0 then 9
   else (case when end_date = report_date then 4 else 6 end) + (case when form = '10-K' and dur not between 300 and 450 then 1
      when form = '10-Q' and dur not between 70 and 120 then 1 else 0 end) end tier
 from (select * replace (case when accession % 11 = 0 then '20-F' else form end as form), {STATEMENT} statement,
   max(end_date) over (partition by accession) report_date, cast(end_date - start_date as int) dur from f4))
 qualify row_number() over (partition by accession, position order by tier,
   case when tier in (5,7) then case when form = '10-K' then -dur else dur end else 0 end,
   concept_priority, case source when 'companyfacts' then 1 else 2 end,
   case when tier = 2 then end_date end desc, filed desc, line_no,
   dur nulls first, start_date nulls first, end_date, value) = 1)""",
    "f4",
)


def best_facts(s, d):
    return stage(s, d, "best_facts", lambda: sl.select_best_fact(prepared(s, d)))


@query(
    "p5_select_best_fact",
    sql("select accession, position, round(value,6) as value, start_date, end_date, duration_days, source, line_no, selection_status from bf", "bf"),
)
def p5(s, d):
    return sl.select_best_fact(prepared(s, d)).withColumn("value", r6("value"))


@query(
    "p6_filing_grid",
    sql("""select fil.accession, p.position, fil.form, round(bf.value,6) as value, coalesce(bf.selection_status, 'missing') selection_status
from fil join (values (0,'A'),(0,'N'),(0,'T'),(1,'A'),(1,'R'),(2,'A'),(2,'N'),(2,'R'),(2,'T')) p(grp, position) on p.grp = case when fil.entity = 7 then 2 else fil.entity % 2 end left join bf on bf.accession = fil.accession and bf.position = p.position""", "fil", "bf"),
)
def p6(s, d):
    # what two groups need, and one entity that needs what either does
    e = fx.filings(s, d).select("entity").distinct()
    needs = F.when(F.col("entity") % 2 == 0, F.array(*map(F.lit, "ANT"))).when(F.col("entity") == 7, F.array(*map(F.lit, "ANRT"))).otherwise(F.array(*map(F.lit, "AR")))
    out = sl.filing_grid(fx.filings(s, d), e.select("entity", F.explode(needs).alias("position")), best_facts(s, d))
    return out.select("accession", "position", "form", r6("value").alias("value"), "selection_status")


@query(
    "p7_sign_rules",
    sql("select entity, accession, position, round(case when position = 'capital_expenditure' then abs(value) else value end,6) as value from f1l", "f1l"),
)
def p7(s, d):
    out = sl.sign_rules(fx.facts_long(s, d))
    return out.select("entity", "accession", "position", F.round("value", 6).alias("value"))


RULES = [
    sl.CalcRule("cash_and_cash_equivalents", (("total_assets", 1.0), ("total_debt", -1.0))),
    sl.CalcRule("total_debt", (("short_term_debt", 1.0), ("long_term_debt", 1.0)), missing_components_as_zero=True, require_at_least_one_component=True),
    sl.CalcRule("operating_cash_flow", (("net_income", 1.0), ("capital_expenditure", -1.0)), overwrite_existing=True, missing_components_as_zero=True),
    sl.CalcRule("operating_cash_flow", (("net_income", 2.0),), overwrite_existing=True, group=1),
    sl.CalcRule("operating_cash_flow", (("total_assets", 1.0),), overwrite_existing=True, entity=7),
]
_CALC_TARGETS = {
    "cash_and_cash_equivalents": ("coalesce(cash_and_cash_equivalents, total_assets - td)", "cash_and_cash_equivalents is null and td is not null"),
    "total_debt": ("td", "total_debt is null and td is not null"),
    "operating_cash_flow": ("case when entity = 7 then coalesce(total_assets, operating_cash_flow) when sector = 1 then coalesce(net_income * 2, operating_cash_flow) else coalesce(net_income, 0) - coalesce(capital_expenditure, 0) end", "case when entity = 7 then total_assets is not null when sector = 1 then net_income is not null else true end"),
}
cte(
    "calc",
    " union all ".join(
        f"""select entity, form, period_end, '{p}' as position, {_CALC_TARGETS.get(p, (p, 'false'))[0]} as value,
 {_CALC_TARGETS.get(p, (p, 'false'))[1]} calculated from calcw"""
        for p in fx.POSITIONS
    ),
    "calcw",
)
cte(
    "calcw",
    """select *, case when total_debt is not null then total_debt when short_term_debt is null and long_term_debt is null then null
  else coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) end td from f1""",
    "f1",
)


@query(
    "p8_apply_calculations",
    sql("""select entity, form, period_end, position, round(value,6) as value,
 case when calculated then 'calculated_from_components' when value is null then 'missing' else 'selected' end selection_status from calc""", "calc"),
)
def p8(s, d):
    keys = ["entity", "form", "period_end", "sector"]
    rows = fx.facts_wide(s, d).unpivot(keys, fx.POSITIONS, "position", "value")
    out = sl.apply_calculations(rows, RULES, keys, fx.POSITIONS, group="sector")
    return out.select(*keys[:3], "position", F.round("value", 6).alias("value"), "selection_status")


def quarter_rows(s, d):
    ids = prepared(s, d).select("accession", "position", "entity", "form", "statement").distinct()
    return best_facts(s, d).drop("line_no").join(ids, ["accession", "position"])


@query(
    "p9_decumulate_ytd",
    sql("""select accession, position, round(case when not cum then value when ok then value - pv end,6) as value,
 case when cum and ok then pe else start_date end start_date, case when cum and ok then gap else duration_days end duration_days,
 case when not cum then selection_status when ok then selection_status || '+decumulated' else 'missing' end selection_status
from (select *, flow and duration_days > 130 cum, coalesce(pe is not null and pv is not null and value is not null and gap <= 130, false) ok from (
 select *, lag(value) over w pv, lag(end_date) over w pe, cast(end_date - lag(end_date) over w as int) gap from (
  select b.*, flow, case when flow then year(end_date) + case when month(end_date) > coalesce(fye_month, 12) then 1 else 0 end end fy from (
   select *, coalesce(form = '10-Q' and statement <> 'balance_sheet' and selection_status <> 'missing' and duration_days is not null, false) flow from bf) b
  left join fye on fye.entity = b.entity)
 window w as (partition by flow, entity, position, fy order by end_date, accession)))""", "bf", "fye"),
)
def p9(s, d):
    out = sl.decumulate_ytd(quarter_rows(s, d), sl.fye_month(fx.filings(s, d)))
    return out.select("accession", "position", r6("value").alias("value"), "start_date", "duration_days", "selection_status")


@query("p10_zero_fill", sql("select accession, position, round(coalesce(value, 0.0),6) as value, selection_status from bf", "bf"))
def p10(s, d):
    return sl.zero_fill(best_facts(s, d)).select("accession", "position", r6("value").alias("value"), "selection_status")


def order_periods(s, d):
    f = fx.filings(s, d)
    form = F.when(F.month("filed") == 12, "annual").otherwise("quarterly")
    return f.select("entity", F.col("filed").alias("period_end"), form.alias("form")).distinct()


def order_releases(s, d):
    c = fx.candidates(s, d)
    return c.select("entity", F.col("filed").alias("release_date")).distinct()


cte(
    "mr",
    """select p.entity, p.period_end, p.form, min(r.release_date) release_date, cast(min(r.release_date) - p.period_end as int) lag_days
from (select distinct entity, filed period_end, case when month(filed) = 12 then 'annual' else 'quarterly' end form from fil) p
left join (select distinct entity, filed release_date from f4) r on r.entity = p.entity and r.release_date > p.period_end
  and r.release_date <= p.period_end + case when form = 'annual' then 150 else 120 end group by 1, 2, 3""",
    "fil", "f4",
)


def matched(s, d):
    lag = F.when(F.col("form") == "annual", mk.ANNUAL_MAX_LAG).otherwise(mk.QUARTERLY_MAX_LAG)
    return mk.match_release(order_periods(s, d), order_releases(s, d), lag)


@query("p11_match_release", sql("select * from mr", "mr"))
def p11(s, d):
    return matched(s, d)


@query(
    "p12_drop_empty_periods",
    sql("""select entity, form, period_end, position, selection_status from f1l semi join
 (select distinct entity, form, period_end from f1l where selection_status <> 'missing') k using (entity, form, period_end)""", "f1l"),
)
def p12(s, d):
    return mk.drop_empty_periods(fx.facts_long(s, d), ["entity", "form", "period_end"]).select("entity", "form", "period_end", "position", "selection_status")


@query(
    "p13_duration_from_prior",
    sql("""select entity, form, period_end, dd duration_days, period_end - dd start_date from (
 select *, cast(coalesce(period_end - lag(period_end) over (partition by entity, form order by period_end), case when form = 'annual' then 365 else 92 end) as int) dd
 from (select distinct entity, form, period_end from f1l where selection_status <> 'missing'))""", "f1l"),
)
def p13(s, d):
    kept = mk.drop_empty_periods(fx.facts_long(s, d), ["entity", "form", "period_end"]).select("entity", "form", "period_end").distinct()
    return mk.duration_from_prior(kept)


@query(
    "p14_yoy_partner_count",
    sql("""select entity, count(*) periods, count(*) filter (where exists (select 1 from dp b where b.entity = a.entity and a.e - b.e between 350 and 380)) with_partner
from dp a group by 1""".replace("dp", "(select distinct entity, filed e from fil)"), "fil"),
)
def p14(s, d):
    return mk.yoy_partner_count(order_periods(s, d))


@query(
    "p15_release_flags",
    sql("""select entity, period_end, form, case when release_date is null then 1 else 0 end release_missing,
 coalesce(cast(form = 'annual' and lag_days > 110 as int), 0) long_annual_lag, coalesce(cast(lag_days <= 0 as int), 0) not_after_period_end from mr""", "mr"),
)
def p15(s, d):
    return mk.release_flags(matched(s, d)).select(
        "entity", "period_end", "form", "release_missing", "long_annual_lag", "not_after_period_end"
    )
