"""Peer-group percentiles and the scores built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.exprs import mean_present, period_label
from daybook.functions.ranking import quantiles, row_counts
from daybook.operators.kpi import ANNUAL_FORMS

# fixed values
SUBSCORES = ["profitability", "growth", "cash_flow", "leverage", "efficiency", "investment"]
INVERSE_KPIS = ["debt_to_assets", "net_debt_to_assets"]
GROUP = ["sector", "frequency", "period"]


def with_peer_group(df: DataFrame, form: str = "form", end: str = "period_end") -> DataFrame:
    freq = F.when(F.col(form).isin(*ANNUAL_FORMS), "annual").otherwise("quarterly")
    return df.withColumn("frequency", freq).withColumn("period", period_label("frequency", end))


def peer_group_size(reports: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Reports per peer group on every row: one small aggregate joined back."""
    n = reports.groupBy(*group).agg(F.count(F.lit(1)).alias("peer_group_size"))
    return reports.join(n, list(group))


def orient(name: Column, value: Column) -> Column:
    return F.when(name.isin(*INVERSE_KPIS), -value).otherwise(value)


def peer_percentiles(long: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Mid-rank percentile of every computable KPI inside its peer group."""
    keys = [*group, "kpi_name"]
    v = long.filter(F.col("value").isNotNull()).withColumn("oriented", orient(F.col("kpi_name"), F.col("value")))
    first = [*keys, "oriented"]
    pct = (F.col("below_n") + 0.5 * F.col("n")) / F.col("total_n")
    return row_counts(v, keys, "oriented").select(*first, *[c for c in v.columns if c not in first], pct.alias("pct"))


def rule_table(spark, rules: Mapping[object, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Sector -> sub-score -> KPI list as rows; as small as the literal it comes from."""
    rows = [(sec, sub, k) for sec, subs in rules.items() for sub, ks in subs.items() for k in ks]
    return F.broadcast(spark.createDataFrame(rows, "sector int, sub_score string, kpi_name string"))  # a literal


def sub_scores(pct: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the available percentiles per sub-score.

    Means are cut at 12 decimals so that summation order cannot break ties between reports.
    """
    hit = pct.join(rules, ["sector", "kpi_name"])
    return hit.groupBy(*keys).agg(
        *[F.round(F.avg(F.when(F.col("sub_score") == s, F.col("pct"))), 12).alias(f"{s}_score") for s in SUBSCORES]
    )


def score_table(reports: DataFrame, pct: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report spine with group size, six sub-scores, their flags and the mean score."""
    subs = sub_scores(pct, rules, keys)
    names = [f"{s}_score" for s in SUBSCORES]
    out = peer_group_size(reports).join(subs, list(keys), "left")
    out = out.withColumn("financial_score", F.round(mean_present(names), 12))
    for s in [*SUBSCORES, "financial"]:
        out = out.withColumn(f"{s}_computable", F.col(f"{s}_score").isNotNull().cast("int"))
    return out


def null_sub_scores(scores: DataFrame) -> DataFrame:
    long = scores.unpivot(["sector"], [f"{s}_score" for s in SUBSCORES], "sub_score", "v")
    return long.filter(F.col("v").isNull()).groupBy("sector", "sub_score").agg(F.count(F.lit(1)).alias("n"))


def group_size_summary(scores: DataFrame) -> DataFrame:
    g = scores.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
    med = quantiles(g, [], "size", {"median_size": 0.5})
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.sum((F.col("size") < 5).cast("int")).alias("small_groups"),
        F.sum(F.when(F.col("size") < 5, F.col("size")).otherwise(0)).alias("rows_in_small_groups"),
    ).crossJoin(med)


def group_size_histogram(scores: DataFrame, cap: int = 10) -> DataFrame:
    g = scores.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy(F.least("size", F.lit(cap)).alias("size")).agg(F.count(F.lit(1)).alias("n_groups"))


def score_range_check(scores: DataFrame) -> DataFrame:
    cols = [f"{s}_score" for s in SUBSCORES] + ["financial_score"]
    long = scores.unpivot(["sector"], cols, "score", "v")
    return long.agg(
        F.count("v").alias("n_values"),
        F.sum(F.isnan("v").cast("int")).alias("n_nan"),
        F.sum(((F.col("v") < 0) | (F.col("v") > 1)).cast("int")).alias("n_out_of_range"),
        F.min("v").alias("min_v"), F.max("v").alias("max_v"),
    )


def blend(fin: Column, text: Column, w: float = 0.5) -> Column:
    return F.when(fin.isNotNull() & text.isNotNull(), fin * w + text * (1 - w)).otherwise(fin)


def largest_pool(reports: DataFrame, sector: object, frequency: str = "annual") -> DataFrame:
    """Members of the largest peer group of a sector, one row each with the source count."""
    own = reports.filter((F.col("sector") == F.lit(sector)) & (F.col("frequency") == frequency))
    sizes = own.groupBy("period").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("source").alias("n_sources")
    )
    # one row: biggest group, earliest period on ties
    top = sizes.agg(F.min(F.struct((-F.col("members")).alias("neg"), "period", "n_sources")).alias("m")).select(
        F.col("m.period").alias("period"), (-F.col("m.neg")).alias("members"), F.col("m.n_sources").alias("n_sources")
    )
    return own.select("entity", "period", "source").join(top, "period")
