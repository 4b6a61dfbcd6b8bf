"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_start(df: DataFrame, key: list[str], bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same key that come before in (bucket, order).

    A key's rows are cut by ``bucket``, so a key with a third of all rows spreads over as many tasks as it
    has buckets; only one row per (key, bucket) meets in the window that adds the buckets up.
    Keys must not be NULL. Rows that tie in the whole order follow one another in any order.
    """
    sums = df.groupBy(*key, bucket).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, [*key, bucket])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .drop("_base")
    )


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
