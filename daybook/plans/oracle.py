"""DuckDB side of the checks: shared CTEs, composed into one statement per query."""

from __future__ import annotations

from daybook.plans.fixtures import POSITIONS

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, body)


def sql(body: str, *deps: str) -> str:
    """``body`` behind a WITH clause holding ``deps`` and all they need."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for p in CTES[n][0]:
            add(p)
        order.append(n)

    for n in deps:
        add(n)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order) + "\n" + body


def _m(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(18,6))) as double)"


cte(
    "f1",
    f"""
select l_suppkey entity, n_regionkey sector, form, period_end, period_end + cast(20 + l_suppkey % 40 as int) release_date,
  revenue, revenue - cost_of_revenue gross_profit, cost_of_revenue, research_and_development,
  operating_income, income_tax, income_before_tax, net_income, total_assets, total_equity,
  cash_and_cash_equivalents, short_term_debt, long_term_debt, total_debt, inventory,
  operating_cash_flow, capital_expenditure, net_interest_income, retained_earnings
from (
  select l_suppkey, form, last_day(make_date(y, qn*3, 1)) period_end,
    {_m("ep*(1-d)")} revenue, {_m("ep*d*4")} cost_of_revenue,
    {_m("ep*t*cast(0.5 as double)")} research_and_development,
    {_m("ep*(1-5*d)")} - {_m("ep*t")} operating_income, {_m("ep*t*cast(0.2 as double)")} income_tax,
    {_m("ep*(1-5*d)")} - {_m("ep*t*2")} income_before_tax, {_m("ep*(1-5*d)")} - {_m("ep*t*3")} net_income,
    {_m("ep")}*3 total_assets, {_m("case when rf='R' then -ep else ep end")} total_equity,
    {_m("case when ls='O' then ep end")} cash_and_cash_equivalents,
    {_m("case when rf='A' and q<10 then ep end")} short_term_debt,
    {_m("case when rf='A' and q>=45 then ep end")} long_term_debt,
    {_m("case when q>=48 then ep end")} total_debt, {_m("q")}*100 inventory,
    {_m("case when rf='N' then ep when rf='R' then -ep end")} operating_cash_flow,
    -{_m("case when q>40 then ep end")} capital_expenditure,
    {_m("ep*t")} - {_m("ep*d")} net_interest_income, {_m("ep*(1-d)")}*2 retained_earnings
  from (
    select l_suppkey, y, qn, 'quarterly' form, ep, d, t, q, rf, ls from f1b
    union all select l_suppkey, y, 4 qn, 'annual' form, ep, d, t, q, rf, ls from f1b)
  group by l_suppkey, form, y, qn) w
join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey""",
    "f1b",
)
cte(
    "f1b",
    """select l_suppkey, l_extendedprice ep, l_discount d, l_tax t, l_quantity q, l_returnflag rf, l_linestatus ls,
  cast(year(l_shipdate) as int) y, cast(quarter(l_shipdate) as int) qn from lineitem""",
)
cte(
    "f1l",
    " union all ".join(
        f"""select entity, sector, form, period_end, release_date,
 concat(entity, '-', form, '-', period_end) accession,
 case when entity % 3 = 0 then 'secondary' else 'primary' end source,
 '{p}' as position, coalesce({p}, 0.0) as value,
 case when {p} is null then 'missing' else 'selected' end selection_status from f1"""
        for p in POSITIONS
    ),
    "f1",
)
cte(
    "f1r",
    """select * replace (case when entity % 25 <> 7 then
   case when form = 'annual' then release_date + 15 else release_date end end as release_date),
   case when entity % 3 = 0 then 'secondary' else 'primary' end source from f1""",
    "f1",
)
cte(
    "f2",
    f"""select l_suppkey entity, cast(l_shipdate as date) d,
  {_m("l_extendedprice")} / sum(l_quantity) adjusted_close from lineitem group by 1, 2""",
)
cte(
    "f3",
    """select l_orderkey, l_linenumber, cast(o_orderdate as date) period_end, cast(l_shipdate as date) release_date
from lineitem join orders on o_orderkey = l_orderkey""",
)
cte(
    "f4",
    """select o_custkey entity, l_orderkey accession, l_returnflag as position, l_linenumber line_no,
  1 + l_linenumber % 3 concept_priority, case when l_linestatus='O' then 'companyfacts' else 'ixbrl' end source,
  case when month(o_orderdate)=12 then '10-K' else '10-Q' end form,
  case when l_suppkey % 5 = 0 then null else cast(o_orderdate as date) end start_date,
  cast(l_shipdate as date) end_date, cast(l_shipdate as date) filed, l_extendedprice as value
from lineitem join orders on o_orderkey = l_orderkey""",
)
cte(
    "fil",
    """select o_custkey entity, o_orderkey accession, case when month(o_orderdate)=12 then '10-K' else '10-Q' end form,
  cast(o_orderdate as date) filed, last_day(cast(o_orderdate - interval 1 month as date)) report_date from orders""",
)
cte(
    "f5s",
    """select o_custkey % (select count(*) from supplier) entity, cast(o_orderdate as date) score_date, max((o_orderkey % 5) / cast(4.0 as double)) score,
  max(case when o_orderstatus='F' then 'primary' else 'secondary' end) source
from orders group by 1, 2""",
)
cte(
    "f6",
    """select entity, period, rd, round(y,6) y, round(pred_a,6) pred_a, round(pred_b,6) pred_b, cast(0.5 as double) pred_c
from (select o_custkey entity, year(o_orderdate)*10 + quarter(o_orderdate) period, cast(o_orderdate as date) rd,
  o_totalprice / cast(10000.0 as double) - 10 y, (o_orderkey * 7919 % 1009) / cast(1009.0 as double) pred_a,
  (o_orderkey * 104729 % 997) / cast(997.0 as double) pred_b,
  row_number() over (partition by o_custkey, year(o_orderdate), quarter(o_orderdate) order by o_orderdate desc, o_orderkey desc) k
  from orders) where k = 1""",
)
cte(
    "f7",
    """select d.doc_id, quality as label, round(n_chars / cast(20000.0 as double), 6) score
from documents d join labels l on l.doc_id = d.doc_id""",
)
cte("f9", "select user_id entity, ts, event_id, value from events")
cte(
    "rep",
    "select distinct l_suppkey entity, last_day(cast(l_shipdate as date)) release_date from lineitem",
)
