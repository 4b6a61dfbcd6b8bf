"""Top-k / bottom-k book: legs, turnover, costs, equity and its statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
LEG = 10
MIN_NAMES = 2 * LEG
COST_BPS = (0.0, 5.0, 10.0)
PERIODS_PER_YEAR = 252 / 63
RF_PERIOD = 0.02 / PERIODS_PER_YEAR


def universe(df: DataFrame, after: Column, at: str = "rd", ret: str = "ret") -> DataFrame:
    """Rows after the split with a label, quarterly, and not an entity's first observation."""
    return df.filter((F.col(at) > after) & (F.col("frequency") == "quarterly") & F.col(ret).isNotNull() & (F.col("first_obs") == 0))


def eligible_periods(uni: DataFrame, minimum: int = MIN_NAMES) -> DataFrame:
    """Periods with enough names and their index in time; one row per period."""
    n = uni.groupBy("period").agg(F.count(F.lit(1)).alias("n_universe")).filter(F.col("n_universe") >= minimum)
    return n.withColumn("period_idx", F.row_number().over(Window.orderBy("period")))


def legs(uni: DataFrame, periods: DataFrame, k: int = LEG, pred: str = "pred", tie: str = "entity") -> DataFrame:
    """The k best and k worst names per period; map tasks keep at most k rows per leg."""
    down = Window.partitionBy("period").orderBy(F.col(pred).desc(), F.col(tie))
    up = Window.partitionBy("period").orderBy(F.col(pred), F.col(tie).desc())
    def leg(w, name):
        r = uni.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
        return r.withColumn("leg", F.lit(name))
    both = leg(down, "long").unionByName(leg(up, "short"))
    return both.join(periods.select("period", "period_idx"), "period")


def holdings(book: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return book.select("period", "leg", "entity", "pred", "ret", *extra)


def leg_returns(book: DataFrame, uni: DataFrame, periods: DataFrame, intl: str = "intl") -> DataFrame:
    """Mean return per leg and the spread; universe and foreign-name counts."""
    long, short = F.col("leg") == "long", F.col("leg") == "short"
    per = book.groupBy("period", "period_idx").agg(
        F.avg(F.when(long, F.col("ret"))).alias("long_ret"), F.avg(F.when(short, F.col("ret"))).alias("short_ret"),
        F.sum(F.when(long, F.col(intl)).otherwise(0)).alias("intl_in_long"),
        F.sum(F.when(short, F.col(intl)).otherwise(0)).alias("intl_in_short"),
    )
    n = uni.groupBy("period").agg(F.count(F.lit(1)).alias("n_universe"), F.sum(intl).alias("n_intl"))
    return per.join(n, "period").withColumn("gross_ls", F.col("long_ret") - F.col("short_ret"))


def turnover(book: DataFrame, k: int = LEG) -> DataFrame:
    """(1/k) x names that entered or left, both legs, per period; the first book counts in full."""
    now = book.select("leg", "entity", "period_idx")
    was = now.withColumn("period_idx", F.col("period_idx") + 1)
    last = book.agg(F.max("period_idx").alias("_last"))  # one row
    both = now.withColumn("_a", F.lit(1)).join(was.withColumn("_b", F.lit(1)), ["leg", "entity", "period_idx"], "full_outer")
    moved = both.filter(F.col("_a").isNull() | F.col("_b").isNull()).crossJoin(F.broadcast(last)).filter(F.col("period_idx") <= F.col("_last"))
    n = moved.groupBy("period_idx").agg(F.count(F.lit(1)).alias("_n"))
    all_p = book.select("period", "period_idx").distinct()
    return all_p.join(n, "period_idx", "left").select(
        "period", "period_idx", (F.coalesce("_n", F.lit(0)) / F.lit(float(k))).alias("traded_notional")
    )


def net_returns(per: DataFrame, costs: Sequence[float] = COST_BPS) -> DataFrame:
    """Spread after costs for every cost level."""
    grid = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps")
    out = per.select("*", grid)
    return out.withColumn("net", F.col("gross_ls") - F.col("cost_bps") / 1e4 * F.col("traded_notional"))


def equity_curve(net: DataFrame, r: str = "net", by: Sequence[str] = ("cost_bps",), at: str = "period_idx") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("equity", F.product(F.col(r) + 1).over(w))


def max_drawdown(eq: DataFrame, by: Sequence[str] = ("cost_bps",), at: str = "period_idx", include_start: bool = False) -> DataFrame:
    """Deepest fall from the running peak; the starting 1.0 counts only on request."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    if include_start:
        peak = F.greatest(peak, F.lit(1.0))
    return eq.withColumn("_dd", F.col("equity") / peak - 1).groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))


def strategy_summary(net: DataFrame, by: Sequence[str] = ("cost_bps",)) -> DataFrame:
    """Cumulative and mean return with the annualised Sharpe, self-financing and funded."""
    year = float(PERIODS_PER_YEAR) ** 0.5
    sd = F.nullif(F.stddev_samp("net"), F.lit(0.0))
    funded = F.col("net") - RF_PERIOD
    return net.groupBy(*by).agg(
        (F.product(F.col("net") + 1) - 1).alias("cum_return"), F.avg("net").alias("mean_period"),
        (F.avg("net") / sd * year).alias("ann_sharpe"),
        (F.avg(funded) / F.nullif(F.stddev_samp(funded), F.lit(0.0)) * year).alias("ann_sharpe_funded"),
        F.count(F.lit(1)).alias("n_rebalances"),
    )


def context_returns(per: DataFrame, uni: DataFrame) -> DataFrame:
    """Compounded long leg, short leg and equal-weight universe."""
    bench = uni.groupBy("period").agg(F.avg("ret").alias("bench"))
    return per.join(bench, "period").agg(
        (F.product(F.col("long_ret") + 1) - 1).alias("long_leg"), (F.product(F.col("short_ret") + 1) - 1).alias("short_leg"),
        (F.product(F.col("bench") + 1) - 1).alias("universe"),
    )


def spread_test(per: DataFrame, r: str = "gross_ls") -> DataFrame:
    n = F.count(r)
    sd = F.stddev_samp(r)
    t = F.when(sd > 0, F.avg(r) / (sd / F.sqrt(n))).otherwise(0.0)
    pos = F.count_if(F.col(r) > 0)
    return per.agg(
        n.alias("n"), F.avg(r).alias("mean"), sd.alias("std"), t.alias("t_stat"), pos.alias("n_positive"),
        ((pos > 0) & (pos < n)).alias("flips_sign"),
    )


def tidy_equity(per: DataFrame, net: DataFrame, cost: float = 10.0) -> DataFrame:
    """Cumulative series in long form, each from a start point of 0."""
    base = per.select("period_idx", F.col("period").cast("string").alias("point"), "long_ret", "short_ret").join(
        net.filter(F.col("cost_bps") == cost).select("period_idx", "net"), "period_idx"
    )
    long = base.unpivot(["period_idx", "point"], ["long_ret", "short_ret", "net"], "series", "r")
    start = long.select("series").distinct().select(F.lit(0).alias("period_idx"), F.lit("Start").alias("point"), "series", F.lit(0.0).alias("r"))
    line = equity_curve(long.unionByName(start), "r", ("series",))
    return line.select("series", "period_idx", "point", (F.col("equity") - 1).alias("cumulative"))
