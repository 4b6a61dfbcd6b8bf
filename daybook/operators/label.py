"""Forward-window labels that start strictly after a release date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
WINDOW_ROWS = 63
TRADING_DAYS = 252
RISK_FREE_ANNUAL = 0.02


def _next_row(reports: DataFrame, rows: DataFrame, entity: str, at: str, day: str, payload: Column) -> DataFrame:
    """Forward as-of: attach ``payload`` of the first row with ``day`` > ``at``.

    The days that are asked for and the rows are laid out on one descending time line, so each day only needs the last
    row seen so far: a growing frame, no inequality join. An entity's line holds one row per calendar day and side, however
    many reports fall on a day; the reports then meet their day in a join, which AQE splits where one entity has many.
    A NULL date has no later row.
    """
    r = reports.filter(F.col(at).isNotNull()).select(F.col(entity).alias("_e"), F.col(at).alias("_t")).distinct()
    p = rows.filter(F.col(day).isNotNull()).select(F.col(entity).alias("_e"), F.col(day).alias("_t"), F.lit(1).alias("_is_row"), payload.alias("_hit"))
    both = r.withColumn("_is_row", F.lit(0)).unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("_e").orderBy(F.col("_t").desc(), F.col("_is_row")).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).filter(F.col("_is_row") == 0)
    met = F.col(entity).eqNullSafe(F.col("_e")) & (F.col(at) == F.col("_t"))
    return reports.join(hit.select("_e", "_t", "_hit"), met, "left").drop("_e", "_t")


def first_row_after(reports: DataFrame, prices: DataFrame, entity: str = "entity", release: str = "release_date", day: str = "d") -> DataFrame:
    """First price day strictly after the release, on the entity's own calendar."""
    hit = _next_row(reports, prices, entity, release, day, F.struct(F.col(day).alias("d")))
    return hit.select(*reports.columns, F.col("_hit.d").alias("t1_date"))


def price_windows(prices: DataFrame, n: int = WINDOW_ROWS, entity: str = "entity", day: str = "d", close: str = "adjusted_close") -> DataFrame:
    """Per price row: what a window of ``n`` rows starting there looks like."""
    line = Window.partitionBy(entity).orderBy(day)
    # the first return of the window is against its first price, so returns start one row on
    moves = line.rowsBetween(1, n - 1)
    left = F.count(F.lit(1)).over(Window.partitionBy(entity)) - F.row_number().over(line) + 1
    daily = prices.withColumn("_ret", F.col(close) / F.nullif(F.lag(close).over(line), F.lit(0.0)) - 1)
    return daily.select(
        entity,
        F.col(day),
        left.alias("n_rows"),
        F.lead(day, n - 1).over(line).alias("last_day"),
        F.col(close).alias("first_close"),
        F.lead(close, n - 1).over(line).alias("last_close"),
        F.avg("_ret").over(moves).alias("mean_ret"),
        F.stddev_samp("_ret").over(moves).alias("sd_ret"),
    )


def forward_labels(reports: DataFrame, prices: DataFrame, n: int = WINDOW_ROWS, rf: float = RISK_FREE_ANNUAL, entity: str = "entity", release: str = "release_date", day: str = "d", close: str = "adjusted_close") -> DataFrame:
    """Return, volatility and Sharpe over rows t+1 .. t+n after each release.

    Reports of entities without any price row are left out, as they have no calendar, and so are
    reports without a release date.
    """
    stats = price_windows(prices, n, entity, day, close)
    names = [c for c in stats.columns if c != entity]
    payload = F.struct(*[F.col(c) for c in names])
    known = reports.filter(F.col(release).isNotNull()).join(prices.select(entity).distinct(), entity, "left_semi")
    hit = _next_row(known, stats, entity, release, day, payload)
    got = {c: F.col(f"_hit.{c}") for c in names}
    full = F.coalesce(got["n_rows"], F.lit(0)) >= n
    vol, per_day = got["sd_ret"], F.lit(rf) / F.lit(float(TRADING_DAYS))
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    live = full & (vol > 0)
    return hit.select(
        *reports.columns,
        got[day].alias("t1_date"),
        F.when(full, got["last_day"]).alias("t63_date"),
        F.least(F.coalesce(got["n_rows"], F.lit(0)), F.lit(n)).cast("int").alias("n_forward_days"),
        F.when(full, got["last_close"] / got["first_close"] - 1).alias("ret"),
        F.when(full, vol).alias("vol"),
        F.when(live, (got["mean_ret"] - per_day) / vol * year).alias("sharpe"),
        F.when(live, got["mean_ret"] / vol * year).alias("sharpe_rf0"),
        F.lit(rf).alias("risk_free_annual"),
        F.when(~full, "insufficient_window")
        .when(vol > 0, "ok")
        .otherwise("zero_volatility")
        .alias("status"),
    )


def label_reports(facts: DataFrame, entity: str = "entity", release: str = "release_date") -> DataFrame:
    """Distinct (entity, release) with the newest period end and source; NULL releases excluded."""
    return (
        facts.filter(F.col(release).isNotNull())
        .groupBy(entity, release)
        .agg(F.max("period_end").alias("period_end"), F.max("source").alias("source"))
    )


def label_audit(labels: DataFrame) -> DataFrame:
    """Largest gap of the identity sharpe = sharpe_rf0 - rf / (vol * sqrt(252))."""
    ok = labels.filter(F.col("status") == "ok")
    gap = F.abs(
        F.col("sharpe")
        - (F.col("sharpe_rf0") - F.col("risk_free_annual") / (F.col("vol") * F.sqrt(F.lit(float(TRADING_DAYS)))))
    )
    return ok.agg(F.count(F.lit(1)).alias("n_ok"), (F.max(gap) < 1e-9).alias("holds"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Per status: count and the spread of the label (median exact)."""
    from daybook.functions.ranking import quantiles

    agg = labels.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("sharpe").alias("min_sharpe"),
        F.max("sharpe").alias("max_sharpe"), F.avg("sharpe").alias("mean_sharpe"),
    )
    med = quantiles(labels, ["status"], "sharpe", {"median_sharpe": 0.5})
    return agg.join(med, "status", "left")


def without_prices(reports: DataFrame, prices: DataFrame, entity: str = "entity") -> DataFrame:
    return reports.select(entity).distinct().join(prices.select(entity).distinct(), entity, "left_anti")


def spread_sample(labels: DataFrame, n: int, group: str = "source", by: tuple[str, ...] = ("entity", "_day")) -> DataFrame:
    """``n`` evenly spaced rows per group, for review."""
    from daybook.functions.ranking import order_positions

    ok = labels.filter(F.col("status") == "ok").withColumn("_day", F.unix_date("release_date"))
    at = order_positions(ok, [group], list(by), "_pos")
    step = F.greatest(F.floor(F.col("_pos_n") / n), F.lit(1))
    pick = (F.col("_pos") % step == 0) & (F.col("_pos") < step * n)
    return at.filter(pick).drop("_day", "_pos", "_pos_n")
