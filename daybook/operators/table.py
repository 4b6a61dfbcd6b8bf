"""The leak-free modelling table: as-of joins, clipping, changes, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.exprs import clip, flag
from daybook.functions.ranking import quantiles
from daybook.operators.kpi import KPIS
from daybook.operators.peers import SUBSCORES, blend

# fixed values
SCORE_FEATURES = [f"{s}_score" for s in SUBSCORES] + ["financial_score"]
KPI_FEATURES = [k for k in KPIS if k != "free_cash_flow"]
RATIO_TAILS = [
    "ROIC", "cash_conversion", "revenue_growth_yoy", "operating_income_growth_yoy",
    "net_income_growth_yoy", "operating_cash_flow_growth_yoy",
]
TEXT_FEATURES = ["text_score", "blended_score"]
CHANGE_COLS = SCORE_FEATURES + TEXT_FEATURES + KPI_FEATURES
LABEL_COLS = ["ret", "vol", "sharpe"]
CLIP_COLS = RATIO_TAILS + ["sharpe"]
KEYS = ["entity", "report_date"]


def pivot_kpis(long: DataFrame, keys: Sequence[str] = KEYS, kpis: Sequence[str] = KPI_FEATURES) -> DataFrame:
    """Long KPIs to columns; conditional aggregates combine on the map side."""
    ok = F.col("computable") == 1
    return long.groupBy(*keys).agg(
        *[F.max(F.when(ok & (F.col("kpi_name") == k), F.col("value"))).alias(k) for k in kpis]
    )


def asof_score(spine: DataFrame, scores: DataFrame, fallback_source: str, entity: str = "entity", at: str = "report_date", day: str = "score_date", value: str = "score") -> DataFrame:
    """Score of the same day, else the newest ``fallback_source`` score filed on or before.

    The days that are asked for and the scores share one time line per entity, scores before reports on the same day; a
    growing frame carries the last score forward. ``scores`` holds one row per (entity, day), so a line is bounded by the
    calendar, however many reports there are.
    """
    r = spine.filter(F.col(at).isNotNull()).select(F.col(entity).alias("_e"), F.col(at).alias("_t")).distinct().withColumn("_is_row", F.lit(1))
    sc = scores.select(
        F.col(entity).alias("_e"), F.col(day).alias("_t"), F.lit(0).alias("_is_row"),
        F.struct(F.col(day).alias("d"), F.col(value).alias("v")).alias("_any"),
        F.when(F.col("source") == fallback_source, F.struct(F.col(day).alias("d"), F.col(value).alias("v"))).alias("_fb"),
    )
    w = Window.partitionBy("_e").orderBy("_t", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    line = (
        r.unionByName(sc, allowMissingColumns=True)
        .withColumn("_any", F.last("_any", ignorenulls=True).over(w))
        .withColumn("_fb", F.last("_fb", ignorenulls=True).over(w))
        .filter("_is_row = 1")
    )
    met = F.col(entity).eqNullSafe(F.col("_e")) & (F.col(at) == F.col("_t"))
    hit = spine.join(line.select("_e", "_t", "_any", "_fb"), met, "left")
    exact = F.col("_any.d") == F.col(at)
    kind = F.when(exact, "exact").when(F.col("_fb").isNotNull(), "asof")
    return hit.select(
        *spine.columns,
        F.when(exact, F.col("_any.v")).otherwise(F.col("_fb.v")).alias("text_score"),
        kind.alias("text_match"),
        F.when(exact, F.col("_any.d")).otherwise(F.col("_fb.d")).alias("text_asof_date"),
    )


def assemble(scores: DataFrame, kpis: DataFrame, labels: DataFrame, text: DataFrame, fallback_source: str) -> DataFrame:
    """Scores as spine; KPIs and labels by exact key, text score as of the report date."""
    spine = scores.select(
        *KEYS, "sector", "source", "form", "frequency", "period", "period_end", "release_date",
        "peer_group_size", *SCORE_FEATURES,
    )
    wide = kpis.select(*KEYS, *KPI_FEATURES)
    lab = labels.select("entity", F.col("release_date").alias("report_date"), *LABEL_COLS)
    out = spine.join(wide, KEYS, "left").join(lab, KEYS, "left")
    return asof_score(out, text, fallback_source).withColumn(
        "blended_score", blend(F.col("financial_score"), F.col("text_score"))
    )


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "target_missing": flag(F.col("sharpe").isNull()),
            "text_missing": flag(F.col("text_score").isNull()),
            "no_release_date": flag(F.col("release_date").isNull()),
        }
    )


def clip_bounds(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(feature, lo, hi): exact percentiles over the non-NULL values."""
    return quantiles(df.unpivot([], list(cols), "feature", "v"), ["feature"], "v", {"lo": lo, "hi": hi})


def bounds_row(bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bounds as a single row: two columns per feature."""
    aggs: list[Column] = []
    for c in cols:
        own = F.col("feature") == c
        aggs += [F.max(F.when(own, F.col("lo"))).alias(f"_lo_{c}"), F.max(F.when(own, F.col("hi"))).alias(f"_hi_{c}")]
    return bounds.agg(*aggs)


def winsorize(df: DataFrame, cols: Sequence[str] = CLIP_COLS) -> DataFrame:
    """Clip each column at its own bounds; ``<col>_raw`` keeps the original."""
    one = bounds_row(clip_bounds(df, cols), cols)
    wide = df.crossJoin(F.broadcast(one))  # exactly one row
    clipped = {c: clip(c, f"_lo_{c}", f"_hi_{c}") for c in cols}
    return wide.select(
        *[clipped[c].alias(c) if c in clipped else F.col(c) for c in df.columns],
        *[F.col(c).alias(f"{c}_raw") for c in cols],
    )


def winsor_report(df: DataFrame, cols: Sequence[str] = CLIP_COLS) -> DataFrame:
    long = df.unpivot([], list(cols), "feature", "v").filter(F.col("v").isNotNull())
    # one row of bounds per listed column
    hit = long.join(F.broadcast(clip_bounds(df, cols)), "feature")
    return hit.groupBy("feature").agg(
        F.count("v").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum((F.col("v") < F.col("lo")).cast("long")).alias("capped_lo"),
        F.sum((F.col("v") > F.col("hi")).cast("long")).alias("capped_hi"),
    )


def change_features(df: DataFrame, cols: Sequence[str] = CHANGE_COLS, at: str = "report_date") -> DataFrame:
    """Value minus the previous report of the same frequency; also first_obs and prior date."""
    w = Window.partitionBy("entity", "frequency").orderBy(at)
    return df.select(
        *df.columns,
        F.lag(at).over(w).alias("prior_release_date"),
        flag(F.lag(at).over(w).isNull()).alias("first_obs"),
        *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_change") for c in cols],
    )


def _usable() -> Column:
    return (F.col("target_missing") == 0) & (F.col("first_obs") == 0)


def train_eligible(df: DataFrame, floor: int = 6) -> DataFrame:
    """Flag usable rows of entities with at least ``floor`` of them; rows are kept."""
    per = df.groupBy("entity").agg(F.sum(flag(_usable())).alias("_usable"))
    out = df.join(per, "entity")
    return out.withColumn("train_eligible", flag((F.col("_usable") >= floor) & _usable())).drop("_usable")


def observation_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flag(F.col("target_missing") == 0)).alias("with_target"),
        F.sum(flag(F.col("first_obs") == 0)).alias("with_change"),
        F.sum(flag(_usable())).alias("usable"),
    )


def observation_histogram(df: DataFrame) -> DataFrame:
    return observation_counts(df).groupBy("usable").agg(F.count(F.lit(1)).alias("companies"))


def floor_sensitivity(df: DataFrame, floors: Sequence[int] = (1, 2, 3, 4, 5, 6, 8, 10)) -> DataFrame:
    """Entities and rows kept per floor; each entity is listed under the floors it passes."""
    passed = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: f <= F.col("usable"))
    kept = observation_counts(df).select("usable", F.explode(passed).alias("floor"))
    return kept.groupBy("floor").agg(F.count(F.lit(1)).alias("companies"), F.sum("usable").alias("usable_rows"))


def coverage_by_match(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("text_match", F.lit("missing")).alias("match")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag(F.col("text_asof_date") > F.col("report_date"))).alias("after_report"),
        F.count_distinct("entity").alias("entities"),
    )


def missing_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.sum("text_missing").alias("n_missing"))


def nan_scan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    hits = [F.sum(flag(F.isnan(c))) for c in cols]
    return df.agg(F.count(F.lit(1)).alias("rows"), sum(hits[1:], hits[0]).alias("nan_cells"))


def build(scores: DataFrame, kpis: DataFrame, labels: DataFrame, text: DataFrame, fallback_source: str = "secondary", floor: int = 6) -> DataFrame:
    raw = with_flags(assemble(scores, kpis, labels, text, fallback_source))
    return train_eligible(change_features(winsorize(raw)), floor)
