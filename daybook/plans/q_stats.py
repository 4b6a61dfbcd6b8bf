"""Exploratory statistics queries (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.functions.ranking import spearman
from daybook.operators import stats, table
from daybook.plans import fixtures as fx
from daybook.plans import stages as st
from daybook.plans.oracle import cte, sql
from daybook.plans.q_table import KEYS
from daybook.plans.registry import query

LEVEL = table.SCORE_FEATURES + table.KPI_FEATURES
CHANGES = [f"{c}_change" for c in table.CHANGE_COLS if c != "blended_score"]
SHAPE_COLS = [*LEVEL, "sharpe", *[f"{c}_raw" for c in table.CLIP_COLS]]


def eligible(s, d):
    return st.modelling(s, d).filter("train_eligible = 1")


def long_sql(cols, src, keep=""):
    k = keep + ", " if keep else ""
    return " union all ".join(f"""select {k}'{c}' feature, "{c}" v from {src}""" for c in cols)


cte("els", long_sql(SHAPE_COLS, "el"), "el")


@query(
    "e1_moments",
    sql("""select feature, count(v) n, round(skewness(v),6) skew, round(kurtosis(v),6) kurtosis, round(min(v),6) "min",
 round(quantile_cont(v,0.5),6) median, round(max(v),6) "max" from els group by 1""", "els"),
)
def e1(s, d):
    out = stats.moments(eligible(s, d), SHAPE_COLS)
    return out.select("feature", "n", *[r6(c).alias(c) for c in ("skew", "kurtosis", "min", "median", "max")])


cte(
    "mdl",
    long_sql(LEVEL, "md", "case when train_eligible = 1 then 'train' else 'prediction_only' end split"),
    "md",
)


@query(
    "e2_histogram",
    sql("""select feature, split, coalesce(cast(least(floor((v - lo) / nullif(hi - lo, 0) * 29), 28) as int), 0) bin, count(*) n
from mdl join (select feature, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi from mdl where v is not null group by 1) b using (feature)
where v between lo and hi group by 1, 2, 3""", "mdl"),
)
def e2(s, d):
    return stats.histogram(stats.cohort_columns(st.modelling(s, d)), LEVEL, "split")


cte(
    "rvc",
    "select * from ("
    + long_sql(table.RATIO_TAILS, "el", "'clipped' series")
    + " union all "
    + " union all ".join(f"""select 'raw' series, '{c}' feature, "{c}_raw" v from el""" for c in table.RATIO_TAILS)
    + ") where v is not null",
    "el",
)


@query(
    "e3_raw_vs_clipped",
    sql("""select feature, series, coalesce(cast(least(floor((v - lo) / nullif(hi - lo, 0) * 60), 59) as int), 0) bin, count(*) n
from rvc join (select feature, p1 - case when p99 > p1 then (p99 - p1) * cast(1.5 as double) else 1 end lo,
    p99 + case when p99 > p1 then (p99 - p1) * cast(1.5 as double) else 1 end hi from (
  select feature, quantile_cont(v, 0.01) p1, quantile_cont(v, 0.99) p99 from rvc where series = 'raw' group by 1)) b using (feature)
where v between lo and hi group by 1, 2, 3""", "rvc"),
)
def e3(s, d):
    return stats.raw_vs_clipped(eligible(s, d), table.RATIO_TAILS)


@query("e3_skews", sql("select feature, series, count(v) n, round(skewness(v),6) skew from rvc group by 1, 2", "rvc"))
def e3b(s, d):
    return stats.raw_vs_clipped_skew(eligible(s, d), table.RATIO_TAILS).withColumn("skew", r6("skew"))


_PAIRS = [(a, b) for i, a in enumerate(LEVEL) for b in LEVEL[i + 1 :]]


def _list(xs):
    return "[" + ", ".join(xs) + "]"


_A = _list(f"'{a}'" for a, _ in _PAIRS)
_B = _list(f"'{b}'" for _, b in _PAIRS)
cte(
    "cm",
    f"""select feat_a, feat_b, n, case when isnan(r) then null else r end r from (select unnest({_A}) feat_a,
 unnest({_B}) feat_b,
 unnest({_list(f'count(*) filter (where "{a}" is not null and "{b}" is not null)' for a, b in _PAIRS)}) n,
 unnest({_list(f'corr("{a}", "{b}")' for a, b in _PAIRS)}) r from el)""",
    "el",
)


@query("e4_corr_matrix", sql("select feat_a, feat_b, n, round(r,6) r from cm", "cm"))
def e4(s, d):
    return stats.corr_matrix(eligible(s, d), LEVEL).withColumn("r", r6("r"))


@query("e5_high_corr_pairs", sql("select feat_a, feat_b, n, round(r,6) r from cm where abs(r) > 0.8", "cm"))
def e5(s, d):
    return stats.high_corr_pairs(stats.corr_matrix(eligible(s, d), LEVEL)).withColumn("r", r6("r"))


cte("ftl", " union all ".join(f"""select '{c}' feature, "{c}" x, sharpe y from el""" for c in LEVEL + CHANGES), "el")
cte(
    "ftr",
    """select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 rx,
 rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 ry
from ftl where x is not null and y is not null""",
    "ftl",
)
cte(
    "ftc",
    """select feature, count(*) n, case when count(*) >= 30 then corr(x, y) end pearson,
 case when count(*) >= 30 then coalesce(case when not isnan(corr(rx, ry)) then corr(rx, ry) end, 0) end spearman, count(*) >= 800 reliable
from ftr group by 1""",
    "ftr",
)


@query(
    "e6_feature_target_corr",
    sql("select feature, n, round(case when not isnan(pearson) then pearson end,6) pearson, round(spearman,6) spearman, reliable from ftc", "ftc"),
)
def e6(s, d):
    out = stats.feature_target_corr(eligible(s, d), LEVEL + CHANGES, "sharpe")
    return out.withColumn("pearson", r6("pearson")).withColumn("spearman", r6("spearman"))


def spearman_sql(by, preds, src="f6"):
    """Spearman of y against each predictor, per ``by`` columns."""
    part = f"partition by {by}" if by else ""
    sep = ", " if by else ""
    return " union all ".join(
        f"""select {by}{sep}'{p}' model, count(*) n,
  round(coalesce(case when not isnan(corr(rx, ry)) then corr(rx, ry) end, 0),6) spearman from (
  select {by}{sep}
    rank() over ({part} order by {p}) + (count(*) over (partition by {by}{sep}{p}) - 1) / 2.0 rx,
    rank() over ({part} order by y) + (count(*) over (partition by {by}{sep}y) - 1) / 2.0 ry from {src})
  {'group by ' + by if by else ''}"""
        for p in preds
    )


PREDS = ["pred_a", "pred_b", "pred_c"]


def long_predictions(s, d):
    f6 = fx.predictions(s, d)
    return f6.unpivot(["entity", "period", "rd", "y"], PREDS, "model", "pred")


@query("e7_spearman_pooled", sql(spearman_sql("", PREDS), "f6"))
def e7(s, d):
    out = spearman(long_predictions(s, d), ["model"], "pred", "y")
    return out.select("model", "n", r6("spearman").alias("spearman"))


@query("e7_spearman_by_period", sql(spearman_sql("period", PREDS), "f6"))
def e7b(s, d):
    out = spearman(long_predictions(s, d), ["period", "model"], "pred", "y")
    return out.select("period", "model", "n", r6("spearman").alias("spearman"))


@query("e8_vif")
def e8(s, d):
    el = eligible(s, d)
    core = [k for k in table.KPI_FEATURES if k not in ("inventory_turnover", "net_interest_margin", "capital_retention", "gross_margin", "debt_to_assets", "net_debt_to_assets")]
    out = stats.vif(el, table.SCORE_FEATURES, "scores").unionByName(stats.vif(el, core, "core_kpis"))
    return out.select("block", "feature", r6("r2").alias("r2"), F.when(F.col("vif") < 1e6, r6("vif")).otherwise(F.col("vif")).alias("vif"), "n_rows", "flag")


_MISS = [*LEVEL, *CHANGES, "sharpe"]


@query(
    "e9_missingness",
    sql("""select feature, round(100.0 * avg(case when v is null then 1 else 0 end),6) pct_missing_all,
 round(100.0 * avg(case when v is null then 1 else 0 end) filter (where train_eligible = 1),6) pct_missing_train,
 round(100.0 * avg(case when v is null then 1 else 0 end) filter (where source = 'primary'),6) pct_missing_domestic,
 round(100.0 * avg(case when v is null then 1 else 0 end) filter (where source <> 'primary'),6) pct_missing_international,
 count(*) filter (where v is null) n_missing_all from (""" + long_sql(_MISS, "md", "train_eligible, source") + ") group by 1", "md"),
)
def e9(s, d):
    cohorts = {
        "train": F.col("train_eligible") == 1,
        "domestic": F.col("source") == "primary",
        "international": F.col("source") != "primary",
    }
    out = stats.missingness(st.modelling(s, d), _MISS, cohorts)
    return out.select("feature", "n_missing_all", *[r6(c).alias(c) for c in out.columns if c.startswith("pct")])


_TS = ["mean", "std", "min", "p05", "p25", "median", "p75", "p95", "max", "skew"]


@query(
    "e10_target_summary",
    sql("""select feature, count(v) n, round(avg(v),6) mean, round(stddev_samp(v),6) std, round(min(v),6) "min", round(max(v),6) "max",
 round(skewness(v),6) skew, round(quantile_cont(v,0.05),6) p05, round(quantile_cont(v,0.25),6) p25, round(quantile_cont(v,0.5),6) median,
 round(quantile_cont(v,0.75),6) p75, round(quantile_cont(v,0.95),6) p95 from (""" + long_sql(["sharpe", "sharpe_raw"], "el") + ") group by 1", "el"),
)
def e10(s, d):
    out = stats.target_summary(eligible(s, d), ["sharpe", "sharpe_raw"])
    return out.select("feature", "n", *[r6(c).alias(c) for c in _TS])


_GS = """count(sharpe) n, round(avg(sharpe),6) mean, round(stddev_samp(sharpe),6) std, round(quantile_cont(sharpe,0.25),6) q1,
 round(quantile_cont(sharpe,0.5),6) median, round(quantile_cont(sharpe,0.75),6) q3 from el group by 1"""


@query("e11_by_sector", sql(f"select sector, {_GS}", "el"))
def e11(s, d):
    out = stats.grouped_summary(eligible(s, d), "sector", "sharpe")
    return out.select("sector", "n", *[r6(c).alias(c) for c in ("mean", "std", "q1", "median", "q3")])


@query("e11_by_frequency", sql(f"select frequency, {_GS}", "el"))
def e11b(s, d):
    out = stats.grouped_summary(eligible(s, d), "frequency", "sharpe")
    return out.select("frequency", "n", *[r6(c).alias(c) for c in ("mean", "std", "q1", "median", "q3")])


@query(
    "e12_lag1_autocorr",
    sql("""select frequency, count(*) n_pairs, round(corr(a, b),6) lag1_pearson from (
 select frequency, lag(sharpe) over (partition by entity, frequency order by report_date) a, sharpe b from el)
 where a is not null and b is not null group by 1 having count(*) >= 30""", "el"),
)
def e12(s, d):
    return stats.lag1_autocorr(eligible(s, d), "sharpe").withColumn("lag1_pearson", r6("lag1_pearson"))


@query(
    "e13_observed_caps",
    sql("select feature, round(min(v),6) lo, round(max(v),6) hi from (" + long_sql(table.CLIP_COLS, "md") + ") group by 1", "md"),
)
def e13(s, d):
    out = stats.observed_caps(st.modelling(s, d), table.CLIP_COLS)
    return out.withColumn("lo", r6("lo")).withColumn("hi", r6("hi"))


@query(
    "e14_cohort_columns",
    sql("""select entity, report_date, case when train_eligible = 1 then 'train' else 'prediction_only' end split,
 case when source = 'primary' then 'domestic' else 'international' end cohort from md""", "md"),
)
def e14(s, d):
    return stats.cohort_columns(st.modelling(s, d)).select(*KEYS, "split", "cohort")
