"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into m segments and posted under each of them. A step (r, s) looks up, for every open query, the postings
whose segment s differs from the query's in exactly r bits; steps go through the segments, then to the next radius. After
it, a code that has not been met differs by more than r in the segments up to s and by r at least in the others, so by
more than m * r + s (s from 0) in all; a query is done once its k-th distance is no larger.

Defined cases: a NULL code takes no part; equal codes are one posting with their k + 1 least ids, which is all that can be
among the k nearest; a query's own id is never among its results; ties go to the smaller id; fewer rows than k give all;
NULL ids take no part; rows that repeat count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.session import materialize

K = 10
BITS = 64


def sign_code(vector: Column) -> Column:
    """64-bit code: bit i is set if the i-th component is positive. NULL for vectors that are NULL, empty or longer than 64,
    or hold NULL or non-finite components."""
    good = F.size(vector).between(1, BITS) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    bit = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.when(good, F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, bits): segments so wide that a posting list holds about eight of ``count`` codes. Wider ones need more
    lookups, narrower ones meet more codes in vain; there the two are about even."""
    m = min(8, max(3, round(BITS / max(1, math.log2(max(count, 2)) - 3))))
    edge = [BITS * i // m for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(m)]


def segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def best(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each ``by``; Spark limits them before the shuffle too."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def nearest(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``codes``: id, code. ``queries``: query_id, code. Gives query_id, rank (from 1), id, distance."""
    spark = codes.sparkSession
    codes = codes.filter("id is not null and code is not null").distinct()
    few = best(codes, "code", ["id"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    posted = materialize(few, "hamming-codes")
    size = posted.agg(F.count("*").alias("codes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    cut = segments(size.codes)
    posts = posted.select("code", "ids", F.inline(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("code"), *c).alias("key")) for s, c in enumerate(cut)])))
    posts = materialize(posts, "hamming-posts")

    asked = queries.filter("query_id is not null and code is not null").distinct()
    none = F.array().cast(f"array<struct<distance:int,id:{codes.schema['id'].dataType.simpleString()}>>")
    state = materialize(asked.select(F.col("code").alias("q")).distinct(), "hamming-open").withColumn("top", none)
    done, m, widest = [], len(cut), max(w for _, w in cut)
    # radii 0 and 1 are few lookups, so they take all segments at once
    steps = [(0, range(m)), (1, range(m))] + [(r, [s]) for r in range(2, widest + 1) for s in range(m) if r <= cut[s][1]]
    for r, segs in steps:
        # bounded by the widths of the segments alone: some thousand masks
        masks = spark.createDataFrame([(s, sum(1 << b for b in c)) for s in segs for c in combinations(range(cut[s][1]), r)], "seg int, flip long")
        # a code beyond the k-th distance of a query can't come into its list any more
        worst = F.coalesce(F.get("top", F.lit(k))["distance"], F.lit(BITS)).alias("worst")
        each = state.select("q", worst, F.explode(F.array(*[F.lit(s) for s in segs])).alias("seg")).join(F.broadcast(masks), "seg")
        own = F.coalesce(*[F.when(F.col("seg") == s, segment(F.col("q"), *cut[s])) for s in segs])
        probes = each.select("q", "worst", F.col("seg").alias("_seg"), own.bitwiseXOR(F.col("flip")).alias("_key"))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        # a code is taken where it is met first: smallest radius, then first segment
        gap = [F.bit_count(segment(F.col("q").bitwiseXOR(F.col("code")), *c)) for c in cut]
        first = F.lit(True)
        for s in range(m):
            first = first & F.when(F.col("seg") > s, gap[s] > r).when(F.col("seg") < s, gap[s] >= r).otherwise(F.lit(True))
        # probes are far more rows than Spark expects of their query rows, so neither side is to be broadcast
        on = (F.col("_seg") == F.col("seg")) & (F.col("_key") == F.col("key")) & (distance <= F.col("worst")) & first
        hits = probes.hint("merge").join(posts, on).select("q", "ids", distance.alias("distance"))
        # the k + 1 nearest ids are among those of the k + 1 nearest codes; one more than k, as one may be the query itself
        codes_kept = best(hits.withColumn("least", F.get("ids", F.lit(0))), "q", ["distance", "least"], k + 1)
        near = codes_kept.select("q", "distance", F.explode("ids").alias("id"))
        new = best(near, "q", ["distance", "id"], k + 1).groupBy("q").agg(F.collect_list(F.struct("distance", "id")).alias("new"))
        top = F.slice(F.array_sort(F.concat("top", F.coalesce("new", none))), 1, k + 1)
        sure = m * r + segs[-1]
        state = state.join(new, "q", "left").select("q", top.alias("top"))
        covered = (F.size("top") > k) & (F.get("top", F.lit(k))["distance"] <= sure)
        state = materialize(state.withColumn("full", covered | (F.size("top") == size.ids)), "hamming-state")
        done.append(state.filter("full"))
        state = state.filter("not full").select("q", "top")
        if state.isEmpty():
            break
    got = state.select("q", "top")  # fewer rows than k, or all radii searched
    for d in done:
        got = got.unionByName(d.select("q", "top"))
    every = asked.join(got, asked["code"] == got["q"]).select("query_id", F.inline("top")).filter("id <> query_id")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
