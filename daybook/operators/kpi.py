"""Ratios and same-period growth from wide reports (one row per report, NULL = missing)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.exprs import debt_sum, growth, positive, safe_ratio

# fixed values: day gaps that count as "one year earlier"
YEAR_AGO = {"quarterly": (350, 381), "annual": (330, 400)}
QUARTERLY_FORMS = ("10-Q", "quarterly")
ANNUAL_FORMS = ("10-K", "annual")

PROFITABILITY = ["gross_margin", "operating_margin", "net_margin", "return_on_assets", "return_on_equity"]
GROWTH = ["revenue_growth_yoy", "operating_income_growth_yoy", "net_income_growth_yoy", "operating_cash_flow_growth_yoy"]
CASH_FLOW = ["operating_cash_flow_margin", "free_cash_flow", "free_cash_flow_margin", "cash_conversion"]
LEVERAGE = ["debt_to_assets", "net_debt_to_assets", "cash_to_assets", "equity_ratio"]
EFFICIENCY = ["asset_turnover", "operating_income_to_assets", "inventory_turnover"]
INVESTMENT = ["r_and_d_intensity", "capex_intensity", "reinvestment_rate"]
CAPITAL = ["ROIC"]
BANK = ["net_interest_margin", "capital_retention"]
KPIS = PROFITABILITY + GROWTH + CASH_FLOW + LEVERAGE + EFFICIENCY + INVESTMENT + CAPITAL + BANK

PRIOR_POSITIONS = ["revenue", "operating_income", "net_income", "operating_cash_flow", "retained_earnings"]


def with_effective_date(df: DataFrame, release: str = "release_date", period_end: str = "period_end", name: str = "report_date") -> DataFrame:
    """Release date, or the period end when there is none (text blanks count as none)."""
    r = F.col(release)
    if dict(df.dtypes)[release] == "string":
        r = F.nullif(F.trim(r), F.lit("")).cast("date")
    return df.withColumn(name, F.coalesce(r, F.col(period_end)))


def resolve_collision(df: DataFrame, keys: Sequence[str] = ("entity", "report_date"), tie: Sequence[str] = ("form", "period_end")) -> DataFrame:
    """One report per key, quarterly forms first. The rank limit prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy((~F.col("form").isin(*QUARTERLY_FORMS)).cast("int"), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def positions_map(facts: DataFrame, keys: Sequence[str], positions: Sequence[str]) -> DataFrame:
    """Long facts to one column per position; a missing position is NULL, a real 0 stays 0."""
    present = F.col("selection_status") != "missing"
    return facts.groupBy(*keys).agg(
        *[F.max(F.when(present & (F.col("position") == p), F.col("value"))).alias(p) for p in positions]
    )


def with_prior(df: DataFrame, cols: Sequence[str] = PRIOR_POSITIONS, entity: str = "entity", form: str = "form", end: str = "period_end") -> DataFrame:
    """Attach the newest report of the same form whose period ended about a year earlier.

    One range frame over the day number per form; adds ``prior_end`` and ``prior_<col>``.
    """
    day = F.unix_date(F.col(end))
    line = Window.partitionBy(entity, form).orderBy(day)
    quarterly = F.col(form).isin(*QUARTERLY_FORMS)
    pack = F.struct(F.col(end).alias("end"), *[F.col(c) for c in cols])
    hits = {
        k: F.max(pack).over(line.rangeBetween(-hi, -lo)) for k, (lo, hi) in YEAR_AGO.items()
    }
    prior = F.when(quarterly, hits["quarterly"]).otherwise(hits["annual"])
    out = df.withColumn("_prior", prior)
    return out.select(
        *df.columns, F.col("_prior.end").alias("prior_end"), *[F.col(f"_prior.{c}").alias(f"prior_{c}") for c in cols]
    )


def kpi_columns(energy: Column, bank: Column, annual: Column) -> dict[str, Column]:
    """KPI name -> expression over the position columns and ``prior_*`` columns."""
    c = F.col
    rev, assets, ni = c("revenue"), c("total_assets"), c("net_income")
    eq = positive("total_equity")
    cash, ocf, capex, rnd = (
        c("cash_and_cash_equivalents"), c("operating_cash_flow"), c("capital_expenditure"), c("research_and_development"),
    )
    oi = c("operating_income")
    debt = debt_sum("short_term_debt", "long_term_debt", "total_debt")
    fcf = ocf - capex
    tax_rate = safe_ratio("income_tax", "income_before_tax")
    retained = safe_ratio(c("retained_earnings") - c("prior_retained_earnings"), ni)
    return {
        "gross_margin": F.when(~energy, safe_ratio("gross_profit", rev)),
        "operating_margin": safe_ratio(oi, rev),
        "net_margin": safe_ratio(ni, rev),
        "return_on_assets": safe_ratio(ni, assets),
        "return_on_equity": ni / eq,
        "revenue_growth_yoy": growth("revenue", "prior_revenue", use_abs=False),
        "operating_income_growth_yoy": growth("operating_income", "prior_operating_income", use_abs=True),
        "net_income_growth_yoy": growth("net_income", "prior_net_income", use_abs=True),
        "operating_cash_flow_growth_yoy": growth("operating_cash_flow", "prior_operating_cash_flow", use_abs=True),
        "operating_cash_flow_margin": safe_ratio(ocf, rev),
        "free_cash_flow": fcf,
        "free_cash_flow_margin": safe_ratio(fcf, rev),
        "cash_conversion": safe_ratio(ocf, ni),
        "debt_to_assets": F.when(~bank, safe_ratio(debt, assets)),
        "net_debt_to_assets": F.when(~bank, safe_ratio(debt - cash, assets)),
        "cash_to_assets": safe_ratio(cash, assets),
        "equity_ratio": safe_ratio(eq, assets),
        "asset_turnover": safe_ratio(rev, assets),
        "operating_income_to_assets": safe_ratio(oi, assets),
        "inventory_turnover": safe_ratio("cost_of_revenue", "inventory"),
        "r_and_d_intensity": safe_ratio(rnd, rev),
        "capex_intensity": safe_ratio(capex, rev),
        "reinvestment_rate": safe_ratio(rnd + capex, rev),
        "ROIC": safe_ratio(oi * (1 - tax_rate), debt + eq - cash),
        "net_interest_margin": F.when(bank, safe_ratio("net_interest_income", assets)),
        "capital_retention": F.when(bank & annual, retained),
    }


def compute_kpis(reports: DataFrame, energy: Column, bank: Column, keep: Sequence[str]) -> DataFrame:
    """Wide KPIs for reports that carry ``prior_*`` columns. One projection, no shuffle."""
    annual = ~F.col("form").isin(*QUARTERLY_FORMS)
    exprs = kpi_columns(energy, bank, annual)
    return reports.select(*keep, *[e.alias(k) for k, e in exprs.items()])


def kpis_to_long(kpis: DataFrame, keep: Sequence[str], energy: Column, bank: Column) -> DataFrame:
    """One row per applicable KPI with a computable flag; other sectors' KPIs have no row."""
    long = kpis.unpivot(list(keep), KPIS, "kpi_name", "value")
    name = F.col("kpi_name")
    applies = (
        F.when(name == "gross_margin", ~energy)
        .when(name.isin("debt_to_assets", "net_debt_to_assets"), ~bank)
        .when(name.isin(*BANK), bank)
        .otherwise(F.lit(True))
    )
    return long.filter(applies).withColumn("computable", F.col("value").isNotNull().cast("int"))


def kpi_coverage(long: DataFrame) -> DataFrame:
    return long.groupBy("kpi_name").agg(
        F.sum("computable").alias("computable"),
        F.sum(1 - F.col("computable")).alias("not_computable"),
        F.count(F.lit(1)).alias("total"),
    )


def latest_report(df: DataFrame, entity: str = "entity", by: Sequence[str] = ("report_date",)) -> DataFrame:
    """Newest row per entity as one aggregate (combines on the map side)."""
    rest = [c for c in df.columns if c != entity and c not in by]
    top = df.groupBy(entity).agg(F.max(F.struct(*by, *rest)).alias("_m"))
    return top.select(entity, *[F.col(f"_m.{c}").alias(c) for c in (*by, *rest)])
