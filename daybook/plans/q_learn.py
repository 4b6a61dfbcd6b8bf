"""Split, preprocessing and evaluation queries (metric part of L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions.exprs import r6
from daybook.functions.moments import pair_correlation
from daybook.operators import kpi
from daybook.operators import metrics as mt
from daybook.operators import prep
from daybook.plans import fixtures as fx
from daybook.plans.oracle import cte, sql
from daybook.plans.q_stats import CHANGES, LEVEL, PREDS, eligible, long_predictions, spearman_sql
from daybook.plans.q_table import KEYS
from daybook.plans.registry import query
from daybook.plans import stages as st
from daybook.session import stage

SPLIT = "1999-12-31"
SPLIT_PERIOD = 19994


def split_date():
    return F.lit(SPLIT).cast("date")


@query(
    "l1_time_split",
    sql(f"select entity, report_date, case when report_date <= date '{SPLIT}' then 'train_val' else 'test' end as role from el", "el"),
)
def l1(s, d):
    return mt.time_split(eligible(s, d), "report_date", split_date()).select(*KEYS, "role")


@query(
    "l2_latest_rows",
    sql("""select entity, report_date, form, train_eligible from md qualify row_number() over (partition by entity order by report_date desc) = 1""", "md"),
)
def l2(s, d):
    return kpi.latest_report(st.modelling(s, d).select(*KEYS, "form", "train_eligible"))


NAMES = prep.feature_names()
CLIPPED = prep.clipped_names()


def src(c):
    return f"{c}_raw" if c in prep.RATIO_TAILS else c


cte(
    "xf",
    "select entity, report_date, sharpe_raw, report_date <= date '" + SPLIT + "' is_train, "
    + ", ".join(f'"{src(c)}" as "{c}"' for c in prep.LEVELS) + ", " + ", ".join(f'"{c}_change"' for c in prep.LEVELS) + " from el",
    "el",
)


def features(s, d):
    f = prep.build_features(eligible(s, d), [*KEYS, "sharpe_raw"])
    return f.withColumn("is_train", F.col("report_date") <= split_date())


def _r9(cols):
    return ", ".join(f'round("{c}",6) + 0e0 as "{c}"' for c in cols)


def _s9(cols):
    return [(r6(c) + 0.0).alias(c) for c in cols]


@query("l3_build_features", sql(f"select entity, report_date, {_r9(NAMES)} from xf", "xf"))
def l3(s, d):
    return features(s, d).select(*KEYS, *_s9(NAMES))


cte(
    "xb",
    "select " + ", ".join(f'quantile_cont("{c}", 0.01) "lo_{c}", quantile_cont("{c}", 0.99) "hi_{c}"' for c in [*CLIPPED, "sharpe_raw"])
    + " from xf where is_train",
    "xf",
)
cte(
    "xw",
    "select xf.* replace (" + ", ".join(f'case when "{c}" is not null then least(greatest("{c}", "lo_{c}"), "hi_{c}") end as "{c}"' for c in CLIPPED)
    + """), case when sharpe_raw is not null then least(greatest(sharpe_raw, lo_sharpe_raw), hi_sharpe_raw) end y_fit from xf cross join xb""",
    "xf", "xb",
)
cte("xm", "select " + ", ".join(f'quantile_cont("{c}", 0.5) "m_{c}"' for c in NAMES) + " from xw where is_train", "xw")
cte("xi", "select xw.* replace (" + ", ".join(f'coalesce("{c}", "m_{c}") as "{c}"' for c in NAMES) + ") from xw cross join xm", "xw", "xm")
cte("xs", "select " + ", ".join(f'avg("{c}") "a_{c}", stddev_pop("{c}") "s_{c}"' for c in NAMES) + " from xi where is_train", "xi")
cte("xz", "select xi.* replace (" + ", ".join(f'("{c}" - "a_{c}") / "s_{c}" as "{c}"' for c in NAMES) + ") from xi cross join xs", "xi", "xs")


@query("l4_fold_winsorizer", sql(f"select entity, report_date, {_r9(CLIPPED)} from xw", "xw"))
def l4(s, d):
    f = features(s, d)
    model = prep.FoldWinsorizer(inputCols=CLIPPED).fit(f.filter("is_train"))
    return model.transform(f).select(*KEYS, *_s9(CLIPPED))


def prepared(s, d):
    def build():
        f = features(s, d)
        params = prep.fit_frame(f.filter("is_train"), NAMES, CLIPPED, y="sharpe_raw")
        return prep.apply_frame(f, params, NAMES, y="sharpe_raw", keep=[*KEYS, "is_train"])
    return stage(s, d, "prepared", build)


def _spread(df, arr):
    return df.select(*KEYS, *[(r6(F.col(arr)[i]) + 0.0).alias(c) for i, c in enumerate(NAMES)])


@query("l5_median_impute", sql(f"select entity, report_date, {_r9(NAMES)} from xi", "xi"))
def l5(s, d):
    return _spread(prepared(s, d), "x")


@query("l6_standardize", sql(f"select entity, report_date, {_r9(NAMES)} from xz", "xz"))
def l6(s, d):
    return _spread(prepared(s, d), "z")


@query("l7_target_winsorizer", sql("select entity, report_date, round(sharpe_raw,6) sharpe_raw, round(y_fit,6) y_fit from xw", "xw"))
def l7(s, d):
    f = features(s, d).select(*KEYS, "sharpe_raw", "is_train")
    out = prep.clip_target(f, f.filter("is_train"), "sharpe_raw")
    return out.select(*KEYS, r6("sharpe_raw").alias("sharpe_raw"), r6("y_fit").alias("y_fit"))


cte(
    "fo",
    """select f.*, fold, case when pos < st - 21 then 'train' when pos >= st and pos < st + sz then 'test' end as role from (
  select *, row_number() over (order by rd, entity) - 1 pos, count(*) over () n, count(*) over () // 6 sz from f6) f
 join (select unnest(range(5)) fold) g on true join (select 1) z on true, lateral (select n - 5 * sz + fold * sz st) t
 where pos < st - 21 or (pos >= st and pos < st + sz)""",
    "f6",
)


@query("l8_time_folds", sql('select entity, period, cast(fold as int) fold, role from fo', "fo"))
def l8(s, d):
    return mt.time_folds(fx.predictions(s, d), "rd", ["entity"]).select("entity", "period", "fold", "role")


def test_long(s, d):
    return long_predictions(s, d).filter(F.col("period") > SPLIT_PERIOD)


def train_long(s, d):
    return long_predictions(s, d).filter(F.col("period") <= SPLIT_PERIOD)


cte("f6t", f"select * from f6 where period > {SPLIT_PERIOD}", "f6")
cte("f6l", " union all ".join(f"select entity, period, rd, y, '{p}' model, {p} pred from f6" for p in PREDS), "f6")
cte("f6lt", f"select * from f6l where period > {SPLIT_PERIOD}", "f6l")


@query(
    "l16_degenerate",
    sql(f"""select model, round(stddev_pop(pred),6) insample_pred_std, cast(stddev_pop(pred) < 1e-6 as int) degenerate from f6l
 where period <= {SPLIT_PERIOD} group by 1""", "f6l"),
)
def l16(s, d):
    return mt.degenerate(train_long(s, d), "pred").withColumn("insample_pred_std", r6("insample_pred_std"))


cte("fot", "select * from fo where role = 'test'", "fo")
cte("fsp", spearman_sql("fold", PREDS, "fot"), "fot")
cte(
    "cv",
    f"""select model, avg(spearman) cv_mean, stddev_pop(spearman) cv_std, any_value(s) insample_pred_std, any_value(cast(s < 1e-6 as int)) degenerate
 from fsp join (select model, stddev_pop(pred) s from f6l where period <= {SPLIT_PERIOD} group by 1) g using (model) group by 1""",
    "fsp", "f6l",
)


def fold_long(s, d):
    folds = mt.time_folds(fx.predictions(s, d), "rd", ["entity"])
    return folds.unpivot(["entity", "period", "rd", "y", "fold", "role"], PREDS, "model", "pred")


def cv_results(s, d):
    return stage(s, d, "cv_results", lambda: mt.cv_table(fold_long(s, d), train_long(s, d), "pred", "y"))


@query("l8_cv_table", sql("select model, round(cv_mean,5) cv_mean, round(cv_std,5) cv_std, round(insample_pred_std,6) insample_pred_std, degenerate from cv", "cv"))
def l8b(s, d):
    out = mt.cv_table(fold_long(s, d), train_long(s, d), "pred", "y")
    return out.select("model", F.round("cv_mean", 5).alias("cv_mean"), F.round("cv_std", 5).alias("cv_std"), r6("insample_pred_std").alias("insample_pred_std"), "degenerate")


@query(
    "l17_ensemble",
    sql("""select entity, period, round(avg(pred),9) pred from f6lt where model in (select model from cv where degenerate = 0 order by cv_mean desc, model limit 3)
 group by 1, 2""", "f6lt", "cv"),
)
def l17(s, d):
    out = mt.ensemble(test_long(s, d), mt.best_models(cv_results(s, d)), ["entity", "period"])
    return out.withColumn("pred", F.round("pred", 9))


@query(
    "l18_per_period_spearman",
    sql("select model, round(avg(spearman),5) spearman_mean, count(*) n_periods from (" + spearman_sql("period", PREDS, "f6t") + ") where n >= 8 group by 1", "f6t"),
)
def l18(s, d):
    return mt.per_period_spearman(test_long(s, d), "pred", "y").withColumn("spearman_mean", F.round("spearman_mean", 5))


@query(
    "l19_decile_spread",
    sql("""select model, round(avg(y) filter (where p >= n - k),6) top_mean, round(avg(y) filter (where p < k),6) bottom_mean, max(k) k, count(*) n_entities,
 round(avg(y) filter (where p >= n - k) - avg(y) filter (where p < k),6) spread from (
 select *, greatest(1, cast(round_even(n * cast(0.1 as double), 0) as bigint)) k from (
 select *, row_number() over (partition by model order by pred, entity) - 1 p, count(*) over (partition by model) n from (
  select * from f6lt qualify row_number() over (partition by model, entity order by rd desc) = 1))) group by 1""", "f6lt"),
)
def l19(s, d):
    out = mt.decile_spread(test_long(s, d), "pred", "y", by=["model"])
    return out.select("model", r6("top_mean").alias("top_mean"), r6("bottom_mean").alias("bottom_mean"), "k", "n_entities", r6("spread").alias("spread"))


@query(
    "l20_fixed_spread",
    sql("""select model, round(avg(t - b),6) spread_mean, count(*) n_periods from (
 select model, period, avg(y) filter (where dn <= 10) t, avg(y) filter (where up <= 10) b from (
  select *, row_number() over (partition by model, period order by pred, entity) up, row_number() over (partition by model, period order by pred desc, entity desc) dn,
   count(*) over (partition by model, period) n from f6lt) where n >= 20 group by 1, 2) group by 1""", "f6lt"),
)
def l20(s, d):
    return mt.fixed_spread(test_long(s, d), "pred", "y").withColumn("spread_mean", r6("spread_mean"))


@query("l21_rmse", sql("select model, round(sqrt(avg(pow(y - pred, 2))),6) rmse from f6lt group by 1", "f6lt"))
def l21(s, d):
    return mt.rmse(test_long(s, d), "pred", "y").withColumn("rmse", r6("rmse"))


def importances(s, d):
    """Feature importance per 'model': absolute correlation with the label per frequency."""
    long = eligible(s, d).unpivot(["frequency", "sharpe"], LEVEL + CHANGES, "feature", "x")
    g = long.groupBy("frequency", "feature").agg(pair_correlation(F.col("x"), F.col("sharpe")).alias("r"))
    imp = F.round(F.abs("r"), 8)
    return g.select(F.col("frequency").alias("model"), "feature", imp.alias("importance")).filter("importance is not null")


cte(
    "imp",
    "select model, feature, round(abs(r), 8) importance from ("
    + " union all ".join(f"""select frequency model, '{c}' feature, corr("{c}", sharpe) r from el group by 1""" for c in LEVEL + CHANGES)
    + ") where r is not null and not isnan(r)",
    "el",
)
cte(
    "rcon",
    """select feature, avg(rank) mean_rank, count(*) n_models from (select *, rank() over (partition by model order by importance desc)
  + (count(*) over (partition by model, importance) - 1) / 2.0 as rank from imp) group by 1""",
    "imp",
)


@query("l28_rank_consensus", sql("select feature, round(mean_rank,6) mean_rank, n_models from rcon", "rcon"))
def l28(s, d):
    return mt.rank_consensus(importances(s, d)).withColumn("mean_rank", r6("mean_rank"))


@query(
    "l29_tercile_label",
    sql(f"""select entity, period, case when y >= hi then 1 when y <= lo then 0 end as label from f6 cross join (
 select quantile_cont(y, 1.0/3) lo, quantile_cont(y, 2.0/3) hi from f6 where period <= {SPLIT_PERIOD})""", "f6"),
)
def l29(s, d):
    f = fx.predictions(s, d)
    return mt.tercile_label(f, f.filter(F.col("period") <= SPLIT_PERIOD), "y").select("entity", "period", "label")


@query(
    "l30_within_period_tercile",
    sql(f"""select entity, f6.period, case when y >= hi then 1 when y <= lo then 0 end as label from f6 left join (
 select period, quantile_cont(y, 1.0/3) lo, quantile_cont(y, 2.0/3) hi from f6 group by 1 having count(*) >= 9) b on b.period = f6.period""", "f6"),
)
def l30(s, d):
    f = fx.predictions(s, d).withColumn("side", F.col("period") <= SPLIT_PERIOD)
    return mt.within_period_tercile(f, "y", ["side", "period"]).select("entity", "period", "label")


@query(
    "l33_auc",
    sql("""select count(*) filter (where label = 1) n_pos, count(*) filter (where label = 0) n_neg,
 round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0)
  / (count(*) filter (where label = 1) * count(*) filter (where label = 0)),6) auc
from (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 r from f7)""", "f7"),
)
def l33(s, d):
    return mt.auc(fx.scored_labels(s, d), "label", "score").withColumn("auc", r6("auc"))


cte(
    "cmx",
    """select count(*) filter (where score < 0.1 and label = 0) tn, count(*) filter (where score >= 0.1 and label = 0) fp,
 count(*) filter (where score < 0.1 and label = 1) fn, count(*) filter (where score >= 0.1 and label = 1) tp from f7""",
    "f7",
)


@query(
    "l34_classification_metrics",
    sql("""select tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn),6) accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2,6) balanced_accuracy,
 round(tp / (tp + fp),6) "precision", round(tp / (tp + fn),6) recall, round(2 * tp / (2 * tp + fp + fn),6) f1,
 round(greatest((tp + fn) / (tp + tn + fp + fn), 1 - (tp + fn) / (tp + tn + fp + fn)),6) majority_baseline from cmx""", "cmx"),
)
def l34(s, d):
    out = mt.classification_metrics(fx.scored_labels(s, d), "label", "score", 0.1)
    return out.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in out.columns[4:]])


@query(
    "l35_roc_curve",
    sql("""select distinct score threshold, round((select count(*) from f7 b where b.label = 0 and b.score >= a.score) / (select count(*) from f7 where label = 0),6) fpr,
 round((select count(*) from f7 b where b.label = 1 and b.score >= a.score) / (select count(*) from f7 where label = 1),6) tpr from f7 a""", "f7"),
)
def l35(s, d):
    out = mt.roc_curve(fx.scored_labels(s, d), "label", "score")
    return out.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("l36_select_model", sql("select model, round(cv_mean,5) cv_mean from cv where degenerate = 0 order by cv.cv_mean desc, model limit 1", "cv"))
def l36(s, d):
    return mt.select_model(cv_results(s, d)).withColumn("cv_mean", F.round("cv_mean", 5))


@query(
    "l37_target_std",
    sql(f"select round(stddev_samp(sharpe_raw),6) target_std, count(*) n from el where report_date <= date '{SPLIT}'", "el"),
)
def l37(s, d):
    return eligible(s, d).filter(F.col("report_date") <= split_date()).agg(
        r6(F.stddev_samp("sharpe_raw")).alias("target_std"), F.count(F.lit(1)).alias("n")
    )


def test_metrics(s, d):
    """Pooled Spearman and RMSE on the test side, ensemble included."""
    from daybook.functions.ranking import spearman

    t = test_long(s, d)
    ens = mt.ensemble(t, mt.best_models(cv_results(s, d)), ["entity", "period", "rd", "y"]).withColumn("model", F.lit("ensemble"))
    both = t.unionByName(ens)
    return spearman(both, ["model"], "pred", "y").select("model", F.col("spearman").alias("test_spearman")).join(mt.rmse(both, "pred", "y"), "model")


cte(
    "f6e",
    """select entity, period, rd, y, avg(pred) ensemble from f6lt where model in (select model from cv where degenerate = 0 order by cv_mean desc, model limit 3)
 group by 1, 2, 3, 4""",
    "f6lt", "cv",
)
cte("f6te", "select f6t.*, f6e.ensemble from f6t join f6e using (entity, period)", "f6t", "f6e")
cte(
    "tmx",
    "select s.model, spearman test_spearman, rmse from (" + spearman_sql("", [*PREDS, "ensemble"], "f6te") + """) s join (
  select model, sqrt(avg(pow(y - pred, 2))) rmse from (select model, y, pred from f6lt union all select 'ensemble', y, ensemble from f6te) group by 1) r using (model)""",
    "f6te", "f6lt",
)


@query(
    "l38_model_table",
    sql("""select coalesce(cv.model, t.model) model, round(cv_mean,5) cv_mean, degenerate, round(test_spearman,5) test_spearman, round(rmse,6) rmse,
 case when coalesce(cv.model, t.model) like 'ensemble%' then 0 else 1 end row_order from cv full join tmx t on t.model = cv.model""", "cv", "tmx"),
)
def l38(s, d):
    out = mt.model_table(cv_results(s, d), test_metrics(s, d))
    return out.select("model", F.round("cv_mean", 5).alias("cv_mean"), "degenerate", F.round("test_spearman", 5).alias("test_spearman"), r6("rmse").alias("rmse"), "row_order")
