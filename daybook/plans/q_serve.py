"""Read-side queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.operators import kpi, serve, stats, table
from daybook.operators import metrics as mt
from daybook.plans import fixtures as fx
from daybook.plans import q_learn as qn
from daybook.plans import stages as st
from daybook.plans.oracle import cte, sql
from daybook.plans.q_label import report_labels
from daybook.plans.q_stats import CHANGES, LEVEL, PREDS, eligible, spearman_sql
from daybook.plans.q_table import KEYS
from daybook.plans.registry import query
from daybook.sources.tables import read_table


@query(
    "d1_company_dim",
    sql("select entity, max(sector) sector, max(form) form, max(source) source, max(source) <> 'primary' is_intl from f1l group by 1", "f1l"),
)
def d1(s, d):
    return serve.company_dim(fx.facts_long(s, d), ["sector", "form"])


@query(
    "d2_display_key",
    sql("""select k as key, case when count(*) over (partition by b) > 1 then k else b end display, count(*) over (partition by b) > 1 collides from (
 select k, split_part(k, '.', 1) b from (select distinct split_part(split_part(url, '//', 2), '/', 1) k from pages))"""),
)
def d2(s, d):
    host = F.split_part(F.split_part(F.col("url"), F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return serve.display_key(read_table(s, d, "pages").select(host.alias("key")), "key")


cte(
    "rv",
    """select l.entity, c_name as name, rk as rank, case when rk <= 10 then 'LONG' when rk > n - 10 then 'SHORT' else '' end basket,
 case when l.entity % 50 = 0 then 'No release date' when l.entity % 3 = 0 then 'Prediction-only' else 'Train-eligible' end confidence, pred_a,
 case when l.entity % 50 = 0 then 1 else 0 end no_release_date, case when l.entity % 3 = 0 then 1 else 0 end out_of_training_dist, case when l.entity % 7 = 0 then 1 else 0 end text_missing
from (select *, row_number() over (order by pred_a desc, entity) rk, count(*) over () n from (
  select * from f6 qualify row_number() over (partition by entity order by rd desc) = 1)) l left join customer on c_custkey = l.entity""",
    "f6",
)


def view(s, d):
    latest = kpi.latest_report(fx.predictions(s, d).select("entity", "rd", "pred_a"), by=["rd"]).withColumns(
        {
            "no_release_date": (F.col("entity") % 50 == 0).cast("int"),
            "out_of_training_dist": (F.col("entity") % 3 == 0).cast("int"),
            "text_missing": (F.col("entity") % 7 == 0).cast("int"),
        }
    )
    names = read_table(s, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    return serve.ranking(latest, names, "pred_a")


@query("d3_ranking_view", sql("select entity, name, rank, basket, confidence, pred_a from rv", "rv"))
def d3(s, d):
    return view(s, d).select("entity", "name", "rank", "basket", "confidence", "pred_a")


@query(
    "d4_flag_counts",
    sql("""select count(*) n, cast(sum(out_of_training_dist) as bigint) prediction_only, cast(sum(no_release_date) as bigint) no_release_date,
 count(*) filter (where confidence = 'Train-eligible') train_eligible, cast(sum(text_missing) as bigint) text_missing from rv""", "rv"),
)
def d4(s, d):
    return serve.flag_counts(view(s, d))


@query("d5_book_flags", sql("select basket, count(*) n, cast(sum(out_of_training_dist) as bigint) out_of_sample from rv where basket <> '' group by 1", "rv"))
def d5(s, d):
    return serve.book_flags(view(s, d))


@query(
    "d6_weekly_bars",
    sql("""select entity, cast(date_trunc('week', ts) as date) as week, max(cast(ts as date)) last_day, arg_min(value, (ts, event_id)) as open, max(value) high,
 min(value) low, arg_max(value, (ts, event_id)) as close, count(*) n from f9 group by 1, 2""", "f9"),
)
def d6(s, d):
    return serve.weekly_bars(fx.ticks(s, d))


@query(
    "d7_period_change",
    sql("select entity, round(case when count(*) >= 2 then arg_max(adjusted_close, d) / nullif(arg_min(adjusted_close, d), 0) - 1 end,6) change from f2 group by 1", "f2"),
)
def d7(s, d):
    return serve.period_change(fx.prices(s, d)).withColumn("change", r6("change"))


@query("d8_entity_history", sql("select entity, report_date, frequency, period, round(financial_score,9) financial_score, round(sharpe,6) sharpe from md", "md"))
def d8(s, d):
    out = serve.entity_history(st.modelling(s, d))
    return out.select(*KEYS, "frequency", "period", F.round("financial_score", 9).alias("financial_score"), r6("sharpe").alias("sharpe"))


def bars(s, d):
    return fx.prices(s, d).filter("entity % 3 <> 1").select("entity", "d", (F.col("adjusted_close") * 2).alias("close"))


@query(
    "d9_entity_prices",
    sql("select entity, d, case when entity % 3 <> 1 then adjusted_close * 2 else adjusted_close end as close, case when entity % 3 <> 1 then 'bars' else 'adjusted' end kind from f2", "f2"),
)
def d9(s, d):
    return serve.entity_prices(bars(s, d), fx.prices(s, d))


@query(
    "d10_bar_coverage",
    sql("""select c_custkey entity, coalesce(n, 0) n_rows, n is null is_missing from customer left join (
 select entity, count(*) n from f2 where entity % 3 <> 1 group by 1) b on b.entity = c_custkey""", "f2"),
)
def d10(s, d):
    return serve.bar_coverage(read_table(s, d, "customer").select(F.col("c_custkey").alias("entity")), bars(s, d))


@query(
    "d11_top_features",
    sql("select feature, round(mean_rank,6) mean_rank, round((select max(mean_rank) from rcon) + 1 - mean_rank,6) consensus from rcon order by rcon.mean_rank, feature limit 10", "rcon"),
)
def d11(s, d):
    out = serve.top_consensus(mt.rank_consensus(qn.importances(s, d)))
    return out.select("feature", r6("mean_rank").alias("mean_rank"), r6("consensus").alias("consensus"))


@query(
    "d11_top_per_model",
    sql("select model, feature, round(importance,6) importance from imp qualify row_number() over (partition by model order by imp.importance desc, feature) <= 10", "imp"),
)
def d11b(s, d):
    return serve.top_per_model(qn.importances(s, d)).withColumn("importance", r6("importance"))


@query(
    "d12_top_correlations",
    sql("select feature, n, round(spearman,6) spearman from ftc where reliable order by abs(ftc.spearman) desc, feature limit 15", "ftc"),
)
def d12(s, d):
    corr = stats.feature_target_corr(eligible(s, d), LEVEL + CHANGES, "sharpe")
    return serve.top_correlations(corr).select("feature", "n", r6("spearman").alias("spearman"))


cte("last_sc", "select * from sc qualify row_number() over (partition by entity order by report_date desc) = 1", "sc")


@query(
    "d13_score_profile",
    sql("select entity, score, round(v,9) as value from (" + " union all ".join(f"select entity, '{c}' score, {c} v from last_sc" for c in table.SCORE_FEATURES) + ") where v is not null", "last_sc"),
)
def d13(s, d):
    latest = kpi.latest_report(st.scores(s, d).select(*KEYS, *table.SCORE_FEATURES))
    return serve.score_profile(latest, table.SCORE_FEATURES).withColumn("value", F.round("value", 9))


@query(
    "d14_headline",
    sql("""select count(*) companies, count(distinct sector) sectors, count(*) filter (where source <> 'primary') international,
 (select count(distinct risk_free_annual) from labr) risk_free_rates from (select entity, max(sector) sector, max(source) source from f1r group by 1)""", "f1r", "labr"),
)
def d14(s, d):
    return serve.headline(fx.filed_reports(s, d), report_labels(s, d))


@query("d16_cv_band", sql("select model, round(cv_mean,5) cv_mean, round(cv_mean - cv_std,5) lower, round(cv_mean + cv_std,5) upper from cv", "cv"))
def d16(s, d):
    out = serve.cv_band(qn.cv_results(s, d))
    return out.select("model", *[F.round(c, 5).alias(c) for c in ("cv_mean", "lower", "upper")])


cte(
    "mrg",
    """select model, label, pred from (select f6l.*, case when y >= 0 then 1 else 0 end as label from f6l) where period > 19994""",
    "f6l",
)


cte("f6tr", "select * from f6 where period <= 19994", "f6")
cte("trs", spearman_sql("", PREDS, "f6tr"), "f6tr")


@query(
    "d15_metric_ranges",
    sql("""select round(min(auc),6) min_auc, round(max(auc),6) max_auc, round(avg(auc),6) mean_auc, round(avg(ba),6) mean_balanced_accuracy,
 any_value(ov) overfitter, round(any_value(ts),5) train_spearman from (
 select model, (sum(r) filter (where label = 1) - p * (p + 1) / 2.0) / (p * q) auc,
  (count(*) filter (where label = 1 and pred >= 0.5) / p + count(*) filter (where label = 0 and pred < 0.5) / q) / 2 ba
 from (select *, rank() over (partition by model order by pred) + (count(*) over (partition by model, pred) - 1) / 2.0 r,
   count(*) filter (where label = 1) over (partition by model) p, count(*) filter (where label = 0) over (partition by model) q from mrg) group by model, p, q)
 cross join (select model ov, spearman ts from trs order by spearman desc, model desc limit 1)""", "mrg", "trs"),
)
def d15(s, d):
    from daybook.functions.ranking import spearman

    t = qn.test_long(s, d).withColumn("label", (F.col("y") >= 0).cast("int"))
    m = mt.auc(t, "label", "pred", ["model"]).join(mt.classification_metrics(t, "label", "pred", by=["model"]), "model")
    train = spearman(qn.train_long(s, d), ["model"], "pred", "y").select("model", F.col("spearman").alias("train_spearman"))
    out = serve.metric_ranges(m, train)
    return out.select(*[r6(c).alias(c) for c in ("min_auc", "max_auc", "mean_auc", "mean_balanced_accuracy")], "overfitter", F.round("train_spearman", 5).alias("train_spearman"))
