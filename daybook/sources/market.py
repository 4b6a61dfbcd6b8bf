"""Statement matrices, release stamps and price histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
QUARTERLY_MAX_LAG = 120
ANNUAL_MAX_LAG = 150
ANNUAL_LONG_LAG = 110
NOMINAL_DURATION = {"annual": 365, "quarterly": 92}
GAP_CALENDAR_DAYS = 14


def norm_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s", ""))


def unpivot_statements(matrix: DataFrame, keys: Sequence[str], period_cols: Mapping[str, Column], labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Statement matrix (label x period) to one row per key, period and expected position.

    The first non-NULL value among a position's ordered labels wins; none gives 0 with
    status ``missing``.
    """
    spark = matrix.sparkSession
    long = matrix.select(
        *keys,
        norm_label(F.col("label")).alias("_label"),
        F.explode(F.array(*[F.struct(e.alias("period_end"), F.col(c).alias("v")) for c, e in period_cols.items()])).alias("_x"),
    ).select(*keys, "_label", "_x.period_end", "_x.v").filter(F.col("period_end").isNotNull())
    ranked = spark.createDataFrame(
        [("".join(lb.lower().split()), p, i) for p, lbs in labels.items() for i, lb in enumerate(lbs)],
        "_label string, position string, _rank int",
    )
    found = long.filter(F.col("v").isNotNull()).join(ranked, "_label")
    best = found.groupBy(*keys, "period_end", "position").agg(F.min_by("v", "_rank").alias("v"))
    grid = long.select(*keys, "period_end").distinct().select(
        "*", F.explode(F.array(*[F.lit(p) for p in labels])).alias("position")
    )
    out = grid.join(best, [*keys, "period_end", "position"], "left")
    return out.select(
        *keys, "period_end", "position", F.coalesce("v", F.lit(0.0)).alias("value"),
        F.when(F.col("v").isNull(), "missing").otherwise("selected").alias("selection_status"),
    )


def union_period_ends(parts: Sequence[DataFrame], keys: Sequence[str], end: str = "period_end") -> DataFrame:
    out = parts[0].select(*keys, end)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, end))
    return out.distinct()


def release_dates(stamps: DataFrame, entity: str, ts: str, as_of: Column, tz: str = "UTC") -> DataFrame:
    """Distinct past release dates in UTC."""
    utc = F.to_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return stamps.select(entity, F.to_date(utc).alias("release_date")).filter(F.col("release_date") <= as_of).distinct()


def price_rows(history: DataFrame, entity: str, ts: str, close: str, tie: Sequence[str] = ()) -> DataFrame:
    """One close per (entity, day): NULL closes dropped, time of day cut off."""
    h = history.filter(F.col(close).isNotNull())
    return h.groupBy(entity, F.to_date(ts).alias("d")).agg(
        F.max_by(close, F.struct(ts, *tie)).alias("adjusted_close")
    )


def price_universe(facts: DataFrame) -> DataFrame:
    """Source and earliest report date per entity, and the common start of prices."""
    per = facts.groupBy("entity").agg(
        F.max("source").alias("source"), F.min(F.coalesce("release_date", "period_end")).alias("earliest_release")
    )
    start = per.agg(F.trunc(F.min("earliest_release"), "year").alias("start_date"))
    return per.crossJoin(F.broadcast(start))  # exactly one row


def drop_empty_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods without a single present position are left out."""
    kept = rows.filter(F.col("selection_status") != "missing").select(*keys).distinct()
    return rows.join(kept, list(keys), "left_semi")


def duration_from_prior(periods: DataFrame, entity: str = "entity", form: str = "form", end: str = "period_end") -> DataFrame:
    """Days since the previous kept period of the same form; nominal for the first one."""
    w = Window.partitionBy(entity, form).orderBy(end)
    nominal = F.when(F.col(form) == "annual", NOMINAL_DURATION["annual"]).otherwise(NOMINAL_DURATION["quarterly"])
    days = F.coalesce(F.datediff(end, F.lag(end).over(w)), nominal)
    return periods.withColumn("duration_days", days).withColumn("start_date", F.date_sub(end, F.col("duration_days")))


def match_release(periods: DataFrame, releases: DataFrame, max_lag: Column, entity: str = "entity", end: str = "period_end", release: str = "release_date") -> DataFrame:
    """Earliest release in (period end, period end + max_lag], with the lag in days."""
    from daybook.operators.label import first_row_after

    p = periods.withColumn("_max", max_lag)
    hit = first_row_after(p, releases, entity, end, release)
    lag = F.datediff("t1_date", end)
    ok = lag <= F.col("_max")
    return hit.select(*periods.columns, F.when(ok, F.col("t1_date")).alias(release), F.when(ok, lag).alias("lag_days"))


def yoy_partner_count(periods: DataFrame, entity: str = "entity", end: str = "period_end", lo: int = 350, hi: int = 380) -> DataFrame:
    """Periods per entity that have another one ``lo``..``hi`` days earlier."""
    day = F.unix_date(F.col(end))
    w = Window.partitionBy(entity).orderBy(day).rangeBetween(-hi, -lo)
    marked = periods.select(entity, end).distinct().withColumn("_has", F.count(F.lit(1)).over(w) > 0)
    return marked.groupBy(entity).agg(
        F.count(F.lit(1)).alias("periods"), F.sum(F.col("_has").cast("long")).alias("with_partner")
    )


def release_flags(df: DataFrame, end: str = "period_end", release: str = "release_date", form: str = "form") -> DataFrame:
    lag = F.datediff(release, end)
    return df.withColumns(
        {
            "release_missing": F.col(release).isNull().cast("int"),
            "long_annual_lag": F.coalesce(((F.col(form) == "annual") & (lag > ANNUAL_LONG_LAG)).cast("int"), F.lit(0)),
            "not_after_period_end": F.coalesce((lag <= 0).cast("int"), F.lit(0)),
        }
    )


def largest_gap(prices: DataFrame, entity: str = "entity", day: str = "d", limit: int = GAP_CALENDAR_DAYS) -> DataFrame:
    """Largest calendar gap between consecutive rows and where; earliest on ties."""
    w = Window.partitionBy(entity).orderBy(day)
    steps = prices.select(entity, day, F.lag(day).over(w).alias("_from")).withColumn("_gap", F.datediff(day, "_from"))
    top = steps.filter(F.col("_gap").isNotNull()).groupBy(entity).agg(
        F.max(F.struct("_gap", (-F.unix_date("_from")).alias("neg"), F.col("_from").alias("f"), F.col(day).alias("t"))).alias("m")
    )
    return top.select(
        entity, F.col("m._gap").alias("gap_days"), F.col("m.f").alias("gap_from"), F.col("m.t").alias("gap_to"),
        (F.col("m._gap") > limit).alias("flagged"),
    )


def price_coverage(prices: DataFrame, universe: DataFrame, entity: str = "entity", day: str = "d") -> DataFrame:
    """First, last and number of rows per entity with the review flags."""
    per = prices.groupBy(entity).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_rows"),
        F.max("currency").alias("price_currency"),
    )
    out = universe.join(per, entity, "left")
    return out.select(
        entity, "first_day", "last_day", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.col("n_rows").isNull().alias("is_empty"),
        F.coalesce(F.upper("price_currency") != F.upper("reporting_currency"), F.lit(False)).alias("currency_mismatch"),
        F.coalesce(F.col("first_day") > F.col("earliest_release"), F.lit(False)).alias("starts_late"),
    )
