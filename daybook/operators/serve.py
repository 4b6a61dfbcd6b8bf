"""Read-side queries over the finished tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.exprs import flag
from daybook.functions.ranking import order_positions


def company_dim(facts: DataFrame, attributes: Sequence[str], entity: str = "entity", home: str = "primary") -> DataFrame:
    out = facts.groupBy(entity).agg(*[F.max(a).alias(a) for a in attributes], F.max("source").alias("source"))
    return out.withColumn("is_intl", F.col("source") != home)


def display_key(keys: DataFrame, key: str) -> DataFrame:
    """Text before the first dot; keys that would collide all keep their full text."""
    d = keys.select(key).distinct().withColumn("_base", F.substring_index(key, ".", 1))
    n = d.groupBy("_base").agg(F.count(F.lit(1)).alias("_n"))
    out = d.join(n, "_base")
    return out.select(key, F.when(F.col("_n") > 1, F.col(key)).otherwise(F.col("_base")).alias("display"), (F.col("_n") > 1).alias("collides"))


def ranking(latest: DataFrame, names: DataFrame, pred: str = "pred", k: int = 10, entity: str = "entity") -> DataFrame:
    """Dense order 1..n by prediction with basket and confidence tier."""
    neg = latest.withColumn("_neg", -F.col(pred))
    pos = order_positions(neg, [], ["_neg", entity], "_pos").drop("_neg")
    rank = F.col("_pos") + 1
    tier = F.when(F.col("no_release_date") == 1, "No release date").when(F.col("out_of_training_dist") == 1, "Prediction-only").otherwise("Train-eligible")
    basket = F.when(rank <= k, "LONG").when(rank > F.col("_pos_n") - k, "SHORT").otherwise("")
    out = pos.withColumns({"rank": rank, "basket": basket, "confidence": tier}).drop("_pos", "_pos_n")
    return out.join(names, entity, "left")


def flag_counts(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count(F.lit(1)).alias("n"), F.sum("out_of_training_dist").alias("prediction_only"),
        F.sum("no_release_date").alias("no_release_date"), F.sum(flag(F.col("confidence") == "Train-eligible")).alias("train_eligible"),
        F.sum("text_missing").alias("text_missing"),
    )


def book_flags(view: DataFrame) -> DataFrame:
    return view.filter("basket <> ''").groupBy("basket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("out_of_training_dist").alias("out_of_sample")
    )


def weekly_bars(ticks: DataFrame, entity: str = "entity", ts: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """Monday-to-Sunday bars dated by the last traded day."""
    key = F.struct(ts, tie)
    return ticks.groupBy(entity, F.to_date(F.date_trunc("week", ts)).alias("week")).agg(
        F.max(F.to_date(ts)).alias("last_day"), F.min_by(value, key).alias("open"), F.max(value).alias("high"),
        F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count(F.lit(1)).alias("n"),
    )


def period_change(prices: DataFrame, entity: str = "entity", day: str = "d", close: str = "adjusted_close") -> DataFrame:
    g = prices.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(close, day).alias("_a"), F.max_by(close, day).alias("_b")
    )
    change = F.col("_b") / F.nullif(F.col("_a"), F.lit(0.0)) - 1
    return g.select(entity, F.when(F.col("_n") >= 2, change).alias("change"))


def entity_history(md: DataFrame, entity: object | None = None) -> DataFrame:
    """Modelling rows in release order, of one entity or of all."""
    out = md if entity is None else md.filter(F.col("entity") == F.lit(entity))
    return out.orderBy("entity", "report_date")


def entity_prices(bars: DataFrame, prices: DataFrame, entity: object | None = None) -> DataFrame:
    """Raw bars, or adjusted closes for entities without any bar."""
    if entity is not None:
        bars, prices = bars.filter(F.col("entity") == F.lit(entity)), prices.filter(F.col("entity") == F.lit(entity))
    rest = prices.join(bars.select("entity").distinct(), "entity", "left_anti")
    a = bars.select("entity", "d", "close", F.lit("bars").alias("kind"))
    b = rest.select("entity", "d", F.col("adjusted_close").alias("close"), F.lit("adjusted").alias("kind"))
    return a.unionByName(b)


def bar_coverage(universe: DataFrame, bars: DataFrame) -> DataFrame:
    n = bars.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))
    out = universe.join(n, "entity", "left")
    return out.select("entity", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNull().alias("is_missing"))


def top_consensus(consensus: DataFrame, n: int = 10) -> DataFrame:
    """Smallest mean ranks, inverted against the worst rank of all features."""
    worst = consensus.agg(F.max("mean_rank").alias("_w"))  # one row
    out = consensus.crossJoin(F.broadcast(worst)).withColumn("consensus", F.col("_w") + 1 - F.col("mean_rank"))
    return out.orderBy("mean_rank", "feature").limit(n).select("feature", "mean_rank", "consensus")


def top_per_model(importances: DataFrame, n: int = 10) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("model").orderBy(F.abs("importance").desc(), "feature")
    return importances.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def top_correlations(corr: DataFrame, n: int = 15) -> DataFrame:
    return corr.filter("reliable").orderBy(F.abs("spearman").desc(), "feature").limit(n)


def score_profile(latest: DataFrame, cols: Sequence[str], entity: str = "entity") -> DataFrame:
    return latest.unpivot([entity], list(cols), "score", "value").filter(F.col("value").isNotNull())


def headline(facts: DataFrame, labels: DataFrame, home: str = "primary") -> DataFrame:
    """Distinct entities, sectors, foreign entities and risk-free rates."""
    per = facts.groupBy("entity").agg(F.max("sector").alias("sector"), F.max("source").alias("source"))
    a = per.agg(
        F.count(F.lit(1)).alias("companies"), F.count_distinct("sector").alias("sectors"), F.count_if(F.col("source") != home).alias("international")
    )
    return a.crossJoin(labels.agg(F.count_distinct("risk_free_annual").alias("risk_free_rates")))  # two single rows


def cv_band(cv: DataFrame) -> DataFrame:
    return cv.withColumns({"lower": F.col("cv_mean") - F.col("cv_std"), "upper": F.col("cv_mean") + F.col("cv_std")})


def metric_ranges(metrics: DataFrame, train: DataFrame) -> DataFrame:
    """AUC range, mean balanced accuracy and the model with the largest training correlation."""
    a = metrics.agg(
        F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"), F.avg("auc").alias("mean_auc"),
        F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
    )
    b = train.agg(F.max(F.struct("train_spearman", "model")).alias("m")).select(F.col("m.model").alias("overfitter"), F.col("m.train_spearman").alias("train_spearman"))
    return a.crossJoin(b)  # two single rows
