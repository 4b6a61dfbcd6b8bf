"""KPI (K) and peer score (C) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import debt_sum, r6, safe_ratio
from daybook.operators import kpi, peers
from daybook.plans import fixtures as fx
from daybook.plans import stages as st
from daybook.plans.oracle import cte, sql
from daybook.plans.registry import query

cte(
    "rw",
    """select *, coalesce(release_date, period_end) report_date from f1r
qualify row_number() over (partition by entity, coalesce(release_date, period_end)
  order by case when form = 'quarterly' then 0 else 1 end, form, period_end) = 1""",
    "f1r",
)
cte(
    "kp",
    "select c.*, p.period_end prior_end, "
    + ", ".join(f"p.{c} prior_{c}" for c in kpi.PRIOR_POSITIONS)
    + """ from rw c left join rw p on p.entity = c.entity and p.form = c.form
 and c.period_end - p.period_end between case when c.form = 'quarterly' then 350 else 330 end
   and case when c.form = 'quarterly' then 381 else 400 end
qualify row_number() over (partition by c.entity, c.report_date order by p.period_end desc nulls last) = 1""",
    "rw",
)
_D = "(case when short_term_debt is null and long_term_debt is null then coalesce(total_debt, 0) else coalesce(short_term_debt,0) + coalesce(long_term_debt,0) end)"
_E = "(case when total_equity > 0 then total_equity end)"


def _gr(c: str, a: bool) -> str:
    den = f"abs(prior_{c})" if a else f"prior_{c}"
    return f"({c} - prior_{c}) / nullif({den}, 0)"


KPI_SQL = {
    "gross_margin": "case when sector <> 0 then gross_profit / nullif(revenue, 0) end",
    "operating_margin": "operating_income / nullif(revenue, 0)",
    "net_margin": "net_income / nullif(revenue, 0)",
    "return_on_assets": "net_income / nullif(total_assets, 0)",
    "return_on_equity": f"net_income / {_E}",
    "revenue_growth_yoy": _gr("revenue", False),
    "operating_income_growth_yoy": _gr("operating_income", True),
    "net_income_growth_yoy": _gr("net_income", True),
    "operating_cash_flow_growth_yoy": _gr("operating_cash_flow", True),
    "operating_cash_flow_margin": "operating_cash_flow / nullif(revenue, 0)",
    "free_cash_flow": "operating_cash_flow - capital_expenditure",
    "free_cash_flow_margin": "(operating_cash_flow - capital_expenditure) / nullif(revenue, 0)",
    "cash_conversion": "operating_cash_flow / nullif(net_income, 0)",
    "debt_to_assets": f"case when sector <> 1 then {_D} / nullif(total_assets, 0) end",
    "net_debt_to_assets": f"case when sector <> 1 then ({_D} - cash_and_cash_equivalents) / nullif(total_assets, 0) end",
    "cash_to_assets": "cash_and_cash_equivalents / nullif(total_assets, 0)",
    "equity_ratio": f"{_E} / nullif(total_assets, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)",
    "operating_income_to_assets": "operating_income / nullif(total_assets, 0)",
    "inventory_turnover": "cost_of_revenue / nullif(inventory, 0)",
    "r_and_d_intensity": "research_and_development / nullif(revenue, 0)",
    "capex_intensity": "capital_expenditure / nullif(revenue, 0)",
    "reinvestment_rate": "(research_and_development + capital_expenditure) / nullif(revenue, 0)",
    "ROIC": f"operating_income * (1 - income_tax / nullif(income_before_tax, 0)) / nullif({_D} + {_E} - cash_and_cash_equivalents, 0)",
    "net_interest_margin": "case when sector = 1 then net_interest_income / nullif(total_assets, 0) end",
    "capital_retention": "case when sector = 1 and form = 'annual' then (retained_earnings - prior_retained_earnings) / nullif(net_income, 0) end",
}
cte(
    "k",
    """select entity, report_date, sector, form, source, period_end, release_date,
  form as frequency, case when form = 'annual' then cast(year(period_end) as varchar)
    else concat(year(period_end), 'Q', quarter(period_end)) end as period, """
    + ", ".join(f'{v} as "{n}"' for n, v in KPI_SQL.items())
    + " from kp",
    "kp",
)
_APPLIES = {"gross_margin": "sector <> 0", "debt_to_assets": "sector <> 1", "net_debt_to_assets": "sector <> 1", "net_interest_margin": "sector = 1", "capital_retention": "sector = 1"}
cte(
    "kl",
    " union all ".join(
        f"""select entity, report_date, sector, form, source, period_end, release_date, frequency, period,
 '{n}' kpi_name, "{n}" as value, case when "{n}" is null then 0 else 1 end computable from k where {_APPLIES.get(n, 'true')}"""
        for n in KPI_SQL
    ),
    "k",
)
cte(
    "pc",
    """select *, (rank() over (partition by sector, frequency, period, kpi_name order by o) - 1
   + 0.5 * count(*) over (partition by sector, frequency, period, kpi_name, o))
   / count(*) over (partition by sector, frequency, period, kpi_name) pct
from (select *, case when kpi_name in ('debt_to_assets','net_debt_to_assets') then -value else value end o
  from kl where value is not null)""",
    "kl",
)
_RULES = ", ".join(
    f"({sec}, '{sub}', '{k}')" for sec, subs in st.SECTOR_RULES.items() for sub, ks in subs.items() for k in ks
)
cte("rules", f"select * from (values {_RULES}) v(sector, sub_score, kpi_name)")
cte(
    "subs",
    "select entity, report_date, "
    + ", ".join(f"round(avg(pct) filter (where sub_score = '{x}'), 12) {x}_score" for x in peers.SUBSCORES)
    + " from pc join rules using (sector, kpi_name) group by 1, 2",
    "pc", "rules",
)
_N = " + ".join(f"case when {x}_score is null then 0 else 1 end" for x in peers.SUBSCORES)
_S = " + ".join(f"coalesce({x}_score, 0)" for x in peers.SUBSCORES)
cte(
    "sc",
    f"""select *, round(({_S}) / nullif({_N}, 0), 12) financial_score from (
 select k.entity, k.report_date, sector, form, source, period_end, release_date, frequency, period,
   count(*) over (partition by sector, frequency, period) peer_group_size, """
    + ", ".join(f"{x}_score" for x in peers.SUBSCORES)
    + " from k left join subs on subs.entity = k.entity and subs.report_date = k.report_date)",
    "k", "subs",
)

KEYS = ["entity", "report_date"]


@query("k1_effective_date", sql("select entity, form, period_end, release_date, coalesce(release_date, period_end) report_date from f1r", "f1r"))
def k1(s, d):
    return kpi.with_effective_date(fx.filed_reports(s, d)).select("entity", "form", "period_end", "release_date", "report_date")


@query(
    "k2_resolve_collision",
    sql("""select entity, release_date report_date, form, period_end from f1 qualify row_number() over
 (partition by entity, release_date order by case when form = 'quarterly' then 0 else 1 end, form, period_end) = 1""", "f1"),
)
def k2(s, d):
    dated = kpi.with_effective_date(fx.facts_wide(s, d))
    return kpi.resolve_collision(dated).select("entity", "report_date", "form", "period_end")


@query("k3_positions_map", sql("select entity, form, period_end, " + ", ".join(f"round({p},6) {p}" for p in fx.POSITIONS) + " from f1", "f1"))
def k3(s, d):
    out = kpi.positions_map(fx.facts_long(s, d), ["entity", "form", "period_end"], fx.POSITIONS)
    return out.select("entity", "form", "period_end", *[r6(p).alias(p) for p in fx.POSITIONS])


@query("k4_yoy_prior", sql("select entity, report_date, form, period_end, prior_end, round(prior_revenue,6) prior_revenue from kp", "kp"))
def k4(s, d):
    return kpi.with_prior(kpi.resolve_collision(kpi.with_effective_date(fx.filed_reports(s, d)))).select(
        *KEYS, "form", "period_end", "prior_end", r6("prior_revenue").alias("prior_revenue")
    )


@query(
    "k5_safe_ratio",
    sql(f"""select entity, form, period_end, round(net_income / nullif(cash_and_cash_equivalents, 0),6) to_cash,
 round(net_income / {_E},6) to_equity from f1""", "f1"),
)
def k5(s, d):
    from daybook.functions.exprs import positive

    return fx.facts_wide(s, d).select(
        "entity", "form", "period_end",
        r6(safe_ratio("net_income", "cash_and_cash_equivalents")).alias("to_cash"),
        r6(F.col("net_income") / positive("total_equity")).alias("to_equity"),
    )


@query("k6_debt_sum", sql(f"select entity, form, period_end, round({_D},6) debt from f1", "f1"))
def k6(s, d):
    return fx.facts_wide(s, d).select(
        "entity", "form", "period_end", r6(debt_sum("short_term_debt", "long_term_debt", "total_debt")).alias("debt")
    )


def _family(name: str, cols: list[str]) -> None:
    body = "select entity, report_date, " + ", ".join(f'round("{c}",6) as "{c}"' for c in cols) + " from k"

    @query(name, sql(body, "k"))
    def run(s, d):
        return kpi.compute_kpis(st.reports(s, d), st.energy(), st.bank(), KEYS).select(
            *KEYS, *[r6(c).alias(c) for c in cols]
        )


_family("k7_growth", kpi.GROWTH)
_family("k8_profitability", kpi.PROFITABILITY)
_family("k9_cash_flow", kpi.CASH_FLOW)
_family("k10_leverage", kpi.LEVERAGE)
_family("k11_efficiency", kpi.EFFICIENCY)
_family("k12_investment", kpi.INVESTMENT)
_family("k13_roic", kpi.CAPITAL)
_family("k14_bank_kpis", kpi.BANK)


@query("k15_to_long", sql("select entity, report_date, kpi_name, round(value,6) as value, computable from kl", "kl"))
def k15(s, d):
    return st.kpis_long(s, d).select(*KEYS, "kpi_name", r6("value").alias("value"), "computable")


@query(
    "k16_kpi_coverage",
    sql("""select kpi_name, cast(sum(computable) as bigint) computable, cast(sum(1 - computable) as bigint) not_computable,
 count(*) total from kl group by 1""", "kl"),
)
def k16(s, d):
    return kpi.kpi_coverage(st.kpis_long(s, d))


@query(
    "k17_latest_report",
    sql("""select entity, report_date, form, period_end, round(revenue,6) revenue from rw
 qualify row_number() over (partition by entity order by report_date desc) = 1""", "rw"),
)
def k17(s, d):
    cols = ["entity", "report_date", "form", "period_end", "revenue"]
    return kpi.latest_report(st.reports(s, d).select(*cols)).withColumn("revenue", r6("revenue"))


@query("c1_frequency_period", sql("select entity, report_date, frequency, period from k", "k"))
def c1(s, d):
    return peers.with_peer_group(st.reports(s, d)).select(*KEYS, "frequency", "period")


@query("c2_peer_group_size", sql("select entity, report_date, peer_group_size from sc", "sc"))
def c2(s, d):
    return peers.peer_group_size(peers.with_peer_group(st.reports(s, d))).select(*KEYS, "peer_group_size")


@query(
    "c3_orient",
    sql("""select entity, report_date, kpi_name, round(case when kpi_name in ('debt_to_assets','net_debt_to_assets')
 then 0 - value else value end, 6) oriented from kl""", "kl"),
)
def c3(s, d):
    v = F.when(F.col("kpi_name").isin(*peers.INVERSE_KPIS), 0 - F.col("value")).otherwise(F.col("value"))
    return st.kpis_long(s, d).select(*KEYS, "kpi_name", r6(v).alias("oriented"))


@query("c4_midrank_percentile", sql("select entity, report_date, kpi_name, round(pct,6) pct from pc", "pc"))
def c4(s, d):
    return peers.peer_percentiles(st.kpis_long(s, d)).select(*KEYS, "kpi_name", r6("pct").alias("pct"))


_SUBCOLS = [f"{x}_score" for x in peers.SUBSCORES]


@query(
    "c5_sub_scores",
    sql("select entity, report_date, " + ", ".join(f"round({c},9) {c}, case when {c} is null then 0 else 1 end {c[:-6]}_computable" for c in _SUBCOLS) + " from sc", "sc"),
)
def c5(s, d):
    spine = st.kpis(s, d).select(*st.REPORT_COLS, "frequency", "period")
    t = peers.score_table(spine, st.percentiles(s, d), peers.rule_table(s, st.SECTOR_RULES), KEYS)
    return t.select(*KEYS, *[F.round(c, 9).alias(c) for c in _SUBCOLS], *[f"{x}_computable" for x in peers.SUBSCORES])


@query("c6_financial_score", sql("select entity, report_date, round(financial_score,6) financial_score from sc", "sc"))
def c6(s, d):
    return st.scores(s, d).select(*KEYS, r6("financial_score").alias("financial_score"))


@query(
    "c7_null_sub_scores",
    sql("select sector, sub_score, count(*) n from (" + " union all ".join(f"select sector, '{c}' sub_score, {c} v from sc" for c in _SUBCOLS) + ") where v is null group by 1, 2", "sc"),
)
def c7a(s, d):
    return peers.null_sub_scores(st.scores(s, d))


cte("gsz", "select sector, frequency, period, count(*) size from sc group by all", "sc")


@query(
    "c7_group_sizes",
    sql("""select count(*) n_groups, min(size) min_size, max(size) max_size, cast(count(*) filter (where size < 5) as bigint) small_groups,
 cast(coalesce(sum(size) filter (where size < 5), 0) as bigint) rows_in_small_groups, quantile_cont(size, 0.5) median_size from gsz""", "gsz"),
)
def c7b(s, d):
    return peers.group_size_summary(st.scores(s, d))


@query("c7_size_histogram", sql("select least(size, 10) size, count(*) n_groups from gsz group by 1", "gsz"))
def c7c(s, d):
    return peers.group_size_histogram(st.scores(s, d))


@query(
    "c7_range_check",
    sql("select count(v) n_values, cast(count(*) filter (where isnan(v)) as bigint) n_nan, cast(count(*) filter (where v < 0 or v > 1) as bigint) n_out_of_range, round(min(v),6) min_v, round(max(v),6) max_v from ("
        + " union all ".join(f"select {c} v from sc" for c in [*_SUBCOLS, "financial_score"]) + ")", "sc"),
)
def c7d(s, d):
    out = peers.score_range_check(st.scores(s, d))
    return out.withColumn("min_v", r6("min_v")).withColumn("max_v", r6("max_v"))


@query(
    "c9_pool_members",
    sql("""select s.entity, s.period, s.source, g.members, g.n_sources from sc s join (
  select period, count(*) members, count(distinct source) n_sources from sc where sector = 2 and frequency = 'annual'
  group by 1 order by members desc, period limit 1) g on g.period = s.period where sector = 2 and frequency = 'annual'""", "sc"),
)
def c9(s, d):
    return peers.largest_pool(st.scores(s, d), 2).select("entity", "period", "source", "members", "n_sources")
