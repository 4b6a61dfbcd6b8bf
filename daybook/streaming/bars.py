"""Weekly bars as a stream: tumbling Monday weeks, late rows dropped past the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_weekly_bars(ticks: DataFrame, entity: str = "entity", ts: str = "ts", tie: str = "event_id", value: str = "value", delay: str = "7 days") -> DataFrame:
    """Same columns as the batch bars; a week is emitted once the watermark passes its end.

    The epoch was a Thursday, so weeks start four days after it. State is one row per entity
    and open week.
    """
    key = F.struct(ts, tie)
    g = ticks.withWatermark(ts, delay).groupBy(entity, F.window(ts, "7 days", startTime="4 days"))
    bars = g.agg(
        F.max(F.to_date(ts)).alias("last_day"), F.min_by(value, key).alias("open"), F.max(value).alias("high"),
        F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count(F.lit(1)).alias("n"),
    )
    return bars.select(entity, F.to_date("window.start").alias("week"), "last_day", "open", "high", "low", "close", "n")
