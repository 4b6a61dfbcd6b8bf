"""Connected components of a graph that no task has to hold: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that is not the least of its component; root is the least.

    Each round points the larger neighbours of a node to its least neighbour, then the smaller ones. Minima combine
    before the shuffle, so a hub costs one row per task; the number of rounds grows with the logarithm of the nodes.
    Every round is a written table, so a lost executor costs a part of one round.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        now = materialize(now, "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        on = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        now = low.select("a", F.col("m").alias("b")).union(on.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
