"""Stage tables: reports -> KPIs -> percentiles -> scores -> modelling table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import kpi, peers
from daybook.plans import fixtures as fx
from daybook.session import stage

# the five regions stand in for sectors
ENERGY, BANKS = 0, 1


def energy() -> Column:
    return F.col("sector") == ENERGY


def bank() -> Column:
    return F.col("sector") == BANKS



# fixed values: KPIs behind each sub-score
_GENERAL = {
    "profitability": ["gross_margin", "operating_margin", "net_margin", "return_on_assets"],
    "growth": kpi.GROWTH,
    "cash_flow": ["operating_cash_flow_margin", "free_cash_flow_margin", "cash_conversion"],
    "leverage": kpi.LEVERAGE,
    "efficiency": ["asset_turnover", "operating_income_to_assets", "return_on_assets"],
    "investment": ["r_and_d_intensity", "capex_intensity", "reinvestment_rate"],
}
_STOCKED = {**_GENERAL, "efficiency": ["asset_turnover", "inventory_turnover", "operating_income_to_assets"], "investment": ["capex_intensity", "reinvestment_rate"]}
_ENERGY = {**_GENERAL, "profitability": ["operating_margin", "net_margin", "return_on_assets", "return_on_equity"], "investment": ["capex_intensity", "reinvestment_rate"]}
_BANKS = {
    "profitability": ["return_on_assets", "return_on_equity", "net_interest_margin"],
    "growth": ["revenue_growth_yoy", "net_income_growth_yoy"],
    "cash_flow": ["operating_cash_flow_margin", "cash_conversion"],
    "leverage": ["equity_ratio"],
    "efficiency": ["asset_turnover"],
    "investment": ["capital_retention"],
}
SECTOR_RULES = {0: _ENERGY, 1: _BANKS, 2: _GENERAL, 3: _STOCKED, 4: _GENERAL}

REPORT_KEYS = ["entity", "report_date"]
REPORT_COLS = ["entity", "report_date", "sector", "form", "source", "period_end", "release_date"]


def reports(s: SparkSession, d: str) -> DataFrame:
    """One report per (entity, effective date), with the year-ago report attached."""
    def build():
        dated = kpi.with_effective_date(fx.filed_reports(s, d))
        return kpi.with_prior(kpi.resolve_collision(dated))
    return stage(s, d, "reports", build)


def kpis(s: SparkSession, d: str) -> DataFrame:
    return stage(s, d, "kpis", lambda: peers.with_peer_group(kpi.compute_kpis(reports(s, d), energy(), bank(), REPORT_COLS)))


def kpis_long(s: SparkSession, d: str) -> DataFrame:
    keep = [*REPORT_COLS, "frequency", "period"]
    return kpi.kpis_to_long(kpis(s, d), keep, energy(), bank())


def percentiles(s: SparkSession, d: str) -> DataFrame:
    """What the scores read of the percentiles."""
    return stage(s, d, "percentiles", lambda: peers.peer_percentiles(kpis_long(s, d)).select(*REPORT_KEYS, "sector", "kpi_name", "pct"))


def scores(s: SparkSession, d: str) -> DataFrame:
    def build():
        spine = kpis(s, d).select(*REPORT_COLS, "frequency", "period")
        return peers.score_table(spine, percentiles(s, d), peers.rule_table(s, SECTOR_RULES), REPORT_KEYS)
    return stage(s, d, "scores", build)


def assembled(s: SparkSession, d: str) -> DataFrame:
    """Modelling rows before clipping."""
    from daybook.operators import table
    from daybook.plans.q_label import report_labels

    def build():
        return table.with_flags(
            table.assemble(scores(s, d), kpis(s, d), report_labels(s, d), fx.text_scores(s, d), "secondary")
        )
    return stage(s, d, "assembled", build)


def modelling(s: SparkSession, d: str) -> DataFrame:
    from daybook.operators import table

    return stage(
        s, d, "modelling",
        lambda: table.train_eligible(table.change_features(table.winsorize(assembled(s, d)))),
    )
